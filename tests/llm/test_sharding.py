import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import sharding

SCHEMA = "doc_id long, text string, size int, shard string, nr int, key string"


def lpt(sizes, shards):
    heap = [(0, j) for j in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, j = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, j))
    return sorted(load for load, _ in heap)


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, "é" * rng.randint(0, 600)) for i in range(n)]
    rows += [(1000 + i, "the same text " * 9) for i in range(n // 2)]  # a third of all rows
    rows += [(None, None)] * 30 + [(7, ""), (7, ""), (8, None), (9, "z" * 50_000), (None, "z" * 50_000)]
    return rows


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows
    )
    slots, loads = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    places = defaultdict(set)  # a text is told by its size and checksum here
    for r in got:
        places[r.size, r.text_crc32].add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    return loads


@pytest.mark.parametrize("seed,shards", [(1, 7), (2, 40), (3, 1)])
def test_loads_are_those_of_the_heap(spark, seed, shards):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x", 2, "k") for r in rows], SCHEMA).repartition(5)
    loads = check(rows, sharding.assign_shards(df, shards).collect(), shards)
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    assert sorted(loads[j] for j in range(shards)) == lpt(groups.values(), shards)


@pytest.mark.parametrize("seed", range(20))
def test_runs_of_a_size_are_dealt_as_one_by_one(seed):
    rng = random.Random(seed)
    shards = rng.randint(1, 9)
    sizes = Counter(rng.choice([16, 17, 100, 4000, rng.randint(16, 4095)]) for _ in range(rng.randint(1, 400)))
    runs, loads = sharding.longest_first([(s, n, s * n) for s, n in sizes.items()], shards)
    assert sorted(loads) == lpt(sizes.elements(), shards)
    for s, n in sizes.items():
        ranks = sorted((low, high) for size, low, high, _ in runs if size == s)
        assert ranks[0][0] == 0 and ranks[-1][1] == n and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:], strict=False))


def test_classes_of_large_groups_stay_near(spark):
    rng = random.Random(5)
    rows = [(i, str(i) + "x" * int(rng.paretovariate(0.8) * 5000)) for i in range(200)]
    rows = [(i, t[:300_000]) for i, t in rows]
    loads = check(rows, sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect(), 8)
    best = lpt([len(t) + 16 for _, t in rows], 8)
    assert max(loads.values()) <= best[-1] * (1 + 1 / 1024)
    sizes = spark.range(1, 1 << 16).selectExpr("id * id * 7 as size")
    classes = sizes.select("size", sharding._class_of("size").alias("class")).collect()
    assert all(0 <= r.size - r["class"] <= r.size / 2048 and (r.size >= 4096 or r.size == r["class"]) for r in classes)
    assert len({r["class"] for r in classes}) < 4096 + 2048 * 24


def test_shards_as_files(spark, tmp_path):
    df = spark.createDataFrame([(d, t, 1, 2, "k") for d, t in corpus(4, 60)], "doc_id long, text string, size int, nr int, key string")
    sharding.write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select(df.columns).collect())) == Counter(map(tuple, df.collect()))
    assert back.groupBy("text").agg({"shard": "min"}).count() == back.select("text", "shard").distinct().count()


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.assign_shards(empty, 4).collect() == []
    with pytest.raises(ValueError):
        sharding.assign_shards(empty, 0)
