import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from millrace.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, bucket int, copies int"


def test_targets_share_the_excess():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": pytest.approx(500 / 3), "c": pytest.approx(250 / 3)}
    goal = mixing.targets({None: 10, "b": 1000, "a": 1})
    assert goal["a"] == 2.0 and sum(goal.values()) == pytest.approx(1.5 * 1011)
    assert goal[None] == pytest.approx(20.0) or goal[None] < 20  # weighs 1, as third
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_targets_against_repeated_sharing():
    rng = random.Random(1)
    for _ in range(200):
        sizes = {f"s{i:02d}": rng.choice([0, rng.randint(1, 2000)]) for i in range(rng.randint(1, 12))}
        goal = mixing.targets(sizes)
        assert all(goal[s] <= 2 * n + 1e-9 for s, n in sizes.items())
        assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        level = {goal[s] / weight[s] for s in sizes if goal[s] < 2 * sizes[s] - 1e-6}
        assert not level or max(level) - min(level) < 1e-6 * max(1, max(level))  # those below the stop share by weight
        if level:
            assert all(2 * sizes[s] / weight[s] <= max(level) + 1e-6 for s in sizes if goal[s] >= 2 * sizes[s] - 1e-6)


def test_a_step_keeps_words_and_expectations():
    rng = random.Random(2)
    for _ in range(300):
        a, b, p, q = rng.randint(1, 99), rng.randint(1, 99), rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99)
        mean = [0.0, 0.0]
        n = 400
        for k in range(n):
            x, y = mixing.pair(a, p, b, q, (k + 0.5) / n)
            assert x in (0.0, 1.0) or y in (0.0, 1.0)
            assert 0 <= x <= 1 and 0 <= y <= 1 and x * a + y * b == pytest.approx(p * a + q * b)
            mean[0] += x / n
            mean[1] += y / n
        assert mean == [pytest.approx(p, abs=0.02), pytest.approx(q, abs=0.02)]


def rows(seed=3, n=900):
    rng = random.Random(seed)
    out = [(i, "w " * rng.choice([0, 1, 5, 30, rng.randint(1, 300)]), rng.choice(["hot"] * 6 + ["b", "c", "d", None, "é"])) for i in range(n)]
    return [*out, (None, "x y", "b"), (5000, None, "c"), (5001, "z " * 3000, "hot"), (1, "dup", "b"), (1, "dup", "b")]


@pytest.mark.parametrize("bucket", [4096, 20])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    data = rows()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA).repartition(7)
    got = mixing.mix_documents(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size, str(r.source)) for r in got) == sorted((d or -1, size(t), str(s)) for d, t, s in data)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 2 * r.size
    goal = mixing.targets(sizes)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6
    assert {(r.source, r.source_size, r.target) for r in got} == {(s, sizes[s], goal[s]) for s in sizes}
    again = mixing.mix_documents(df.repartition(3)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_copies_take_the_rows(spark):
    data = rows(4, 300)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA)
    out = mixing.mixed_copies(df)
    assert out.columns == df.columns
    want = sum(r.taken for r in mixing.mix_documents(df).collect())
    got = out.collect()
    assert sum(len((r.text or "").split()) for r in got) == want
    assert all(len((r.text or "").split()) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_documents(df).collect() == [] and mixing.mixed_copies(df).collect() == []
    assert mixing.targets({"a": 4}, share=Fraction(1)) == {"a": 4.0}
