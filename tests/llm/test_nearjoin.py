import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import graph, nearjoin

SCHEMA = "doc_id long, text string, tie int, node int, lang string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    words = WORDS.findall(text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components(nodes, edges):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def brute(rows):
    """(id, text) -> class id, copies, links, by all pairs."""
    sets = sorted({grams(t) for _, t in rows if grams(t)}, key=sorted)
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    links = Counter(x for e in near for x in e)
    of = components(range(len(sets)), near)
    index = {s: k for k, s in enumerate(sets)}
    ids = defaultdict(list)
    for d, t in rows:
        if grams(t) and d is not None:
            ids[of[index[grams(t)]]].append(d)
    copies = Counter(grams(t) for _, t in rows)
    out = []
    for d, t in rows:
        s = grams(t)
        out.append((d, min(ids[of[index[s]]], default=None), copies[s], links[index[s]]) if s else (d, d, 1, 0))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(n // 6):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([2, 5, 9, 40, 120, 300]))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            other = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                other[rng.randrange(len(other))] = f"w{rng.randint(0, 3000)}"
            rows.append((len(rows), " ".join(other)))
            if rng.random() < 0.3:
                words = other  # chains: near to the last, not to the first
    rows += [(9000, None), (9001, ""), (9002, " \n"), (None, rows[0][1]), (3, rows[3][1]), (None, "only a null id here now"), (9003, "a b"), (9004, "a b")]
    rows += [(9005, "long " + " ".join(str(i) for i in range(30_000))), (9006, " ".join(str(i) for i in range(30_000)))]
    return rows


KEY = lambda r: tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("seed,block,large", [(1, 512, 8192), (2, 3, 8192), (4, 3, 2), (5, 512, 1)])
def test_against_all_pairs(spark, seed, block, large):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2, "en") for r in rows], SCHEMA).repartition(5)
    got = nearjoin.near_duplicates(df, block_nodes=block, large_nodes=large).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in got), key=KEY) == sorted(brute(rows), key=KEY)


def test_first_of_each_class_stays(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, 1, 2, "en") for r in rows], SCHEMA)
    kept = nearjoin.keep_first(df)
    assert kept.columns == df.columns
    got = Counter(r.doc_id for r in kept.collect())
    want = brute(rows)
    bare = Counter(d for d, t in rows if not grams(t))
    classes = {c for (d, c, *_), (_, t) in zip(want, rows, strict=True) if grams(t)}
    # a class with a null id has it first; else its smallest id stays
    nulls = {c for (d, c, *_), (_, t) in zip(want, rows, strict=True) if grams(t) and d is None}
    assert got == Counter(c for c in classes - nulls) + bare + Counter({None: len(nulls)})


def test_posterior_bounds():
    looks = nearjoin.least_matches((4, 5), 1e-6, 48, 240)
    assert [n for n, _ in looks] == [48, 96, 144, 192, 240]
    rng = np.random.default_rng(1)
    for n, m in looks:  # a pair at the threshold is hardly ever dropped, one at 0.3 nearly always
        assert (rng.binomial(n, 0.8, 200_000) < m).mean() < 1e-4
    assert (rng.binomial(96, 0.3, 10_000) < looks[1][1]).mean() > 0.99


def test_minhash_estimates():
    """Mean and spread of the share of equal values are those of independent draws."""
    rng = np.random.default_rng(7)
    for n in (20, 300):
        shares = []
        for _ in range(400):
            grams = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            k = n // 10
            shares.append((nearjoin.minhash(grams[: n - k]) == nearjoin.minhash(grams[k:])).mean())
        assert np.mean(shares) == pytest.approx(0.8, abs=0.01)
        assert np.std(shares) == pytest.approx((0.16 / 240) ** 0.5, rel=0.15)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (400, 400)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == components({x for e in edges for x in e}, edges)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shared_grams_both_ways():
    rng = np.random.default_rng(2)
    for universe in (60, 100_000):  # matrices, or pair by pair
        sets = [np.unique(rng.integers(0, universe, 40).astype(np.uint64)) for _ in range(30)]
        a, b = nearjoin.Block.of(list(range(12)), sets[:12]), nearjoin.Block.of(list(range(18)), sets[12:])
        for p, q, second in ((a, b, sets[12:]), (a, a, sets[:12])):
            xs, ys = (v.ravel() for v in np.meshgrid(np.arange(12), np.arange(len(second)), indexing="ij"))
            want = [len(np.intersect1d(sets[x], second[y])) for x, y in zip(xs, ys, strict=True)]
            assert nearjoin.shared_grams(p, q, xs, ys).tolist() == want
            assert nearjoin.shared_grams(p, q, xs[:3], ys[:3]).tolist() == want[:3]


def test_rows_of_a_large_group_are_linear(spark, monkeypatch):
    """One group of near copies in blocks of 20: rows that come out of its tasks grow with n, its links with n**2."""
    counted = []
    keep = nearjoin.materialize

    def spy(df, name):
        out = keep(df, name)
        counted.append((name, out.count()))
        return out

    monkeypatch.setattr(nearjoin, "materialize", spy)
    base = [f"w{i}" for i in range(400)]
    for n in (60, 240):
        rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(n)]
        counted.clear()
        out = nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_nodes=20).collect()
        assert {r.class_id for r in out} == {0} and {r.n_links for r in out} == {n - 1}
        seen = dict(counted)
        blocks = -(-n // 20)
        assert seen["members"] == n and seen["links"] <= n + blocks and n <= seen["across"] <= n + 2 * blocks**2


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nearjoin.near_duplicates(df).collect() == [] and nearjoin.keep_first(df).collect() == []


@pytest.mark.parametrize("size", [16, 512, 4096])
def test_structured_words_differ(spark, size):
    """Texts that differ in a Thue-Morse word and its complement are neither copies nor linked."""
    words = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(size)) for k in (0, 1)]
    rows = [(k, " ".join([*(f"w{i}" for i in range(17)), word, *(f"v{i}" for i in range(17))])) for k, word in enumerate(words)]
    got = nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in got} == {(0, 0, 1, 0), (1, 1, 1, 0)}
