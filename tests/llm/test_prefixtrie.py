import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import prefixtrie, scans

SCHEMA = "conv_id long, turn int, role string, text string, depth int, m long, d string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in convs.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    children, saved, leaves = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, who in members.items():
        own_saved = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += children[p] == 0
    return Counter(
        (
            who[0],
            len(p),
            members[p[:-1]][0] if p else None,
            len(who),
            children[p],
            leaves[p],
            saved[p],
            hashlib.sha256(",".join(str(c) for c in who if len(paths[c]) == len(p)).encode()).hexdigest(),
        )
        for p, who in members.items()
    )


def corpus(seed, n=150):
    rng = random.Random(seed)
    says = ["hello there", "a  b c", "", None, "the same\tquestion again", "x"] + [f"word{i} and more" for i in range(8)]
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue  # bases that are missing, too
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(says)) for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.4:
            turns = [("system", "one opening that very many share"), *turns[1:]]
        numbers = list(range(len(turns)))
        if rng.random() < 0.3:
            numbers = [rng.choice([None, 0, 1, 2]) for _ in turns]  # ties and nulls
        rows += [(c * rng.choice([1, 1, 1]), k, *t) for k, t in zip(numbers, turns, strict=True)]
    rows += [(1000 + c, k, "user", f"turn {k}") for c in range(40) for k in range(c)]  # each is a prefix of the next
    rows += [(2000, k, "user", "again and again") for k in range(600)]  # a third of all rows
    rows += [(None, 0, "user", "nobody's"), (3000, 0, "user", "long " * 50_000), rows[0], rows[0]]
    return rows


@pytest.fixture
def many_parts(spark):
    """Partitions stay as small as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed,primes,chunk", [(1, prefixtrie.PRIMES, 1 << 16), (2, (7, 3), 8), (3, (2, 2), 1)])
def test_against_brute_force(spark, many_parts, seed, primes, chunk):
    """Tiny primes make fingerprints collide, tiny chunks cut the lists of ends."""
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(7)
    got = prefixtrie.prefix_trie(df, primes=primes, chunk_bytes=chunk)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.prefix_trie(empty).collect() == []
    c = next(x for x in range(21, 40) if zlib.crc32(str(x).encode()) % 4)  # takes turns from a base that isn't there
    rows = [(c, 0, "user", "lost")]
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert Counter(map(tuple, got)) == brute(rows) and len(got) == 1


def test_scan_over_partitions(spark, many_parts):
    """A key that fills several partitions has the running values of one."""
    rng = np.random.default_rng(2)
    rows = [(1, k, int(v)) for k, v in enumerate(rng.integers(-(1 << 62), 1 << 62, 400))] + [(x, 0, x) for x in range(2, 50)] + [(0, 5, -3)]
    df = spark.createDataFrame(rows, "k long, t long, v long").repartition(4)
    prime, base = 2_147_483_647, 48_271
    columns = {"total": scans.Sum("small"), "f": scans.Fingerprint("v", base, prime)}
    df = df.withColumn("small", F.col("v") % 1000)
    got = scans.scan(df, "k", [F.col("k"), F.desc("t")], columns, "test").collect()
    dealt = df.repartitionByRange(F.col("k"), F.desc("t")).withColumn("part", F.spark_partition_id())
    assert dealt.filter("k = 1").select("part").distinct().count() > 2
    want = []
    for k in {r[0] for r in rows}:
        place = total = f = 0
        for _, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            place, before = place + 1, f
            small = int(np.fmod(v, 1000))
            total, f = total + small, (f + v % (1 << 64) % prime * pow(base, place, prime)) % prime
            want.append((k, t, v, small, place, total, f, before))
    assert Counter(map(tuple, got)) == Counter(want)


def test_tree_sums(spark):
    rng = random.Random(1)
    up = {m: rng.choice([None, *range(max(0, m - 3), m)]) if m else None for m in range(60)}
    up[40] = 39
    rows = [(m, u, m + 1) for m, u in up.items()]
    got = prefixtrie.tree_sums(spark.createDataFrame(rows, "m long, up long, v long"), ["v"]).collect()
    want = Counter()
    for m in up:
        x = m
        while x is not None:
            want[x] += m + 1
            x = up[x]
    assert {r.m: r.v for r in got} == dict(want)
