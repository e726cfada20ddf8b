"""The vector index against brute force: recall, rows of every kind, blocks of a hot list."""

import numpy as np
import pytest

from millrace.operators import vectorindex


def clustered(n, size=32, clusters=40, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, size))
    own = rng.integers(0, clusters, n)
    own[: n // 3] = 0  # one cluster with a third of all rows
    return centers[own] + 0.3 * rng.normal(size=(n, size))


def frame(spark, x):
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "key long, v array<float>, id string").repartition(4)


def brute(x, q, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit[q], 6)
    score[q] = -2
    return set(np.lexsort((np.arange(len(x)), -score))[:k].tolist())


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_recall_with_few_lists(spark, block):
    x = clustered(3000)
    df = frame(spark, x)
    model = vectorindex.fit(df, "key", "v", 32, lists=40)
    index = vectorindex.build(df, model, "key", "v", block_rows=block)
    stored = index.collect()
    assert sorted(i for r in stored for i in r.ids) == list(range(3000))
    assert all(len(r.codes) == 16 * len(r.ids) for r in stored)
    assert max(model.blocks.values()) > 1 if block == 50 else max(model.blocks.values()) == 1
    queries = df.filter("key % 100 = 0")
    found = vectorindex.search(df, queries, index, model, 10, 8, 60, "key", "v").collect()
    hits = sum(r.key in brute(x, r.query_id, 10) for r in found)
    assert len(found) == 300 and hits >= 0.9 * 300
    sizes = dict.fromkeys(range(40), 0)
    for r in stored:
        sizes[r.list] += len(r.ids)
    assert sum(sorted(sizes.values())[-8:]) < 3000  # no query looks at all rows
    exact = vectorindex.exact_neighbours(df, queries, 10, "key", "v").collect()
    assert len(exact) == 300 and all(r.id in brute(x, r.query, 10) for r in exact)


def test_rows_that_cannot_be_compared(spark):
    x = clustered(200)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 32), (902, [1.0] * 31), (903, [float("nan")] * 32), (904, [float("inf")] * 32), (905, [None] * 32), (906, []), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "key long, v array<float>")
    model = vectorindex.fit(df, "key", "v", 32)
    index = vectorindex.build(df, model, "key", "v")
    assert sorted(i for r in index.collect() for i in r.ids) == sorted([0, *range(200)])
    found = vectorindex.search(df, df.filter("key in (7, 900, 901, 903)"), index, model, 5, 20, 30, "key", "v").collect()
    assert {r.query_id for r in found} == {7} and sorted(r.place for r in found) == [1, 2, 3, 4, 5]


def test_empty(spark):
    df = spark.createDataFrame([], "key long, v array<float>")
    model = vectorindex.fit(df, "key", "v", 32)
    index = vectorindex.build(df, model, "key", "v")
    assert vectorindex.search(df, df, index, model, 5, 20, 30, "key", "v").collect() == []
    assert vectorindex.recall(vectorindex.search(df, df, index, model, 5, 2, 3, "key", "v"), vectorindex.exact_neighbours(df, df, 3, "key", "v"), "key").first().wanted == 0


def test_finer_codes_keep_more(spark):
    """Without clusters, codes of 32 bytes keep the true ones among fewer candidates than codes of 16."""
    x = np.random.default_rng(2).normal(size=(3000, 64))
    df = frame(spark, x)
    queries, hits = df.filter("key % 100 = 0"), {}
    for parts in (16, 32):
        model = vectorindex.fit(df, "key", "v", 64, lists=4, subspaces=parts)
        index = vectorindex.build(df, model, "key", "v")
        found = vectorindex.search(df, queries, index, model, 10, 4, 20, "key", "v").collect()
        hits[parts] = sum(r.key in brute(x, r.query_id, 10) for r in found)
    assert hits[32] >= 0.9 * 300 and hits[32] > hits[16]
