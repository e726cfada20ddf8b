import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import importance

SCHEMA = "doc_id long, text string, score int, rank string, id long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def features(text, longest):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent, least, buckets, longest=1):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t in rows for f in features(t, longest))
    t = Counter(of(f) for x in target for f in features(x, longest))
    many, few = sum(s.values()), sum(t.values())
    out = []
    for doc, text in rows:
        own = [math.floor(1000 * math.log((t[b] + 1) * (many + buckets) / ((s[b] + 1) * (few + buckets)))) for b in map(of, features(text, longest))]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, None, len(words_of(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def corpus(seed, n=200):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "GAMMA7", "naïve", "東京", "x1", "ÀB", "don't", "a\x1cb", "q_r", "42"] + [f"w{i}" for i in range(50)]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    rows += [(None, None), (500, ""), (501, " .;\n"), (502, "word " * 20_000), (3, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    rows += [(600, "many copies of one row " * 5)] * 100
    return rows, [" ".join(rng.choice(vocabulary[:6]) for _ in range(30)) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize("seed,percent,least,buckets,longest", [(1, 10, 20, 10_000, 1), (2, 37, 0, 64, 1), (3, 100, 5, 1 << 16, 2), (4, 50, 25, 100, 3)])
def test_against_brute_force(spark, seed, percent, least, buckets, longest):
    rows, target = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, item_id long")
    got = importance.resample(df, aims, percent, least, buckets, longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(rows, target, percent, least, buckets, longest)


def test_streams_hold_every_feature(spark):
    rows, _ = corpus(5)
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    streams = importance.write_streams(df)
    found = Counter()
    for r in streams.collect():
        data, low = np.frombuffer(r.stream, "<u2"), 0
        for doc, end in zip(r.ids, r.ends, strict=True):
            found[doc, tuple(data[low:end].tolist())] += 1
            low = end
        assert low == len(data)
    assert found == Counter((d, tuple(zlib.crc32(w.encode()) % 10_000 for w in words_of(t))) for d, t in rows)
    counts = importance.bucket_counts(streams)
    assert counts.sum() == sum(len(words_of(t)) for _, t in rows)


def test_gather_and_run_lengths():
    rng = np.random.default_rng(1)
    stream = rng.integers(0, 7, 1000).astype("<u2")
    values, times = importance.run_lengths(stream)
    assert dict(zip(values.tolist(), times.tolist(), strict=True)) == Counter(stream.tolist())
    ends = np.array([0, 0, 400, 400, 1000, 1000])
    gains = np.array([-5, 3, 0, 11, -7, 2, 1])
    sizes, weights = importance.gathered(gains, stream, ends)
    assert sizes.tolist() == [0, 0, 400, 0, 600, 0]
    assert weights.tolist() == [0, 0, int(gains[stream[:400]].sum()) // 400, 0, int(gains[stream[400:]].sum()) // 600, 0]
    assert [len(x) for x in importance.run_lengths(stream[:0])] == [0, 0]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).collect() == []
    alone = spark.createDataFrame([(1, "one two three " * 10)], "doc_id long, text string")
    (row,) = importance.resample(alone, none, percent=100).collect()
    assert Counter([tuple(row)]) == brute([(1, "one two three " * 10)], [], 100, 20, 10_000)
    with pytest.raises(ValueError):
        importance.resample(alone, none, buckets=1 << 17)
