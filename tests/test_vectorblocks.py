"""All queries against all vectors, pair by pair in Python."""

import math

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import vectorblocks


def rows():
    rng = np.random.default_rng(4)
    out = [(i, [float(v) for v in rng.integers(-9, 9, 6) / 8]) for i in range(60)]
    out += [(100, out[7][1]), (101, [v * (1 + 1e-9) for v in out[7][1]]), (102, [0.0] * 6), (103, None), (104, [1.0] * 5), (105, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (106, []), (None, out[3][1])]
    return out + [(200 + i, out[7][1]) for i in range(20)]


def whole(v):
    return v is not None and None not in v


def test_pairs_and_order(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, "key long, v array<double>").repartition(3)
    queries = df.filter("key in (7, 20, 102, 103)")
    asked = [r for r in data if r[0] in (7, 20, 102, 103)]
    want, scores = {}, {}
    for k, q in asked:
        for n, x in data:
            dot = cos = l2 = None
            if whole(q) and whole(x) and len(q) == len(x):
                dot, size = sum(a * b for a, b in zip(q, x, strict=True)), math.hypot(*q) * math.hypot(*x)
                cos, l2 = (dot / size if size else None), math.dist(q, x)
            want[k, n] = (dot, cos, l2)
            if n not in (None, k):
                scores.setdefault(k, []).append((-math.inf if cos is None else round(cos, 6), -n))
    got = {(r.query_id, r.key): (r.dot, r.cos, r.l2) for r in vectorblocks.similarities(df, queries, "key", "v").collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        for a, b, step in zip(values, got[k], (1e-4, 1e-6, 1e-5), strict=True):
            assert a is b is None or abs(a - b) <= 0.51 * step
    found = vectorblocks.nearest(df, queries, "key", "v", 5)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # pairs aren't rows of a join
    best = {}
    for r in found.collect():
        best.setdefault(r.query_id, []).append((-math.inf if r.score is None else r.score, -r.key))
    for k, values in scores.items():
        assert sorted(best[k])[-5:] == sorted(values)[-5:]


def test_blocks_are_bounded_and_whole(spark):
    df = spark.range(1000).select("id", F.array(F.col("id").cast("float"), F.lit(1.0)).alias("v")).coalesce(2)
    found = vectorblocks.blocks(df, "id", "v", 64, "t").collect()
    ids = [np.frombuffer(r.ids, np.int64) for r in found]
    assert max(map(len, ids)) == 64 and sorted(np.concatenate(ids)) == list(range(1000))
    for r, i in zip(found, ids, strict=True):
        assert (np.frombuffer(r.data).reshape(-1, 2)[:, 0] == i).all()
    assert vectorblocks.similarities(df.limit(0), df.limit(0), "id", "v").count() == 0


def test_rounding():
    assert vectorblocks.rounded(np.array([0.5, -0.5, 2.5, 0.49999999999999994, -0.0]), 0).tolist() == [1, -1, 3, 0, 0]
