"""The exact set join against all pairs, and how few pairs it looks at."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.operators import setjoin


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]  # some tokens are in most sets
    sets = [set(rng.choices(vocabulary, weights, k=rng.randint(1, 12))) for _ in range(n)]
    for i in range(0, n, 4):
        near = set(sets[rng.randrange(n)])
        near ^= {rng.choice(vocabulary)}
        sets[i] = near or {"t0"}
    return sets


@pytest.mark.parametrize("seed,t", [(1, Fraction(1, 2)), (2, Fraction(4, 5)), (3, Fraction(1)), (4, Fraction(1, 10)), (5, Fraction(2, 3))])
def test_against_all_pairs(spark, seed, t):
    sets = corpus(seed)
    rows = [(i, w, "x") for i, s in enumerate(sets) for w in s]
    rows += [(0, next(iter(sets[0])), "x"), (None, "t1", "x"), (999, None, "x")]  # a repeat, and nulls
    df = spark.createDataFrame(rows, "id long, w string, node string").repartition(4)
    got = setjoin.set_join(df, "id", "w", t).collect()
    want = {}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            share = Fraction(len(a & sets[j]), len(a | sets[j]))
            if share >= t:
                want[i, j] = float(share)
    assert {(r.id_a, r.id_b): r.similarity for r in got} == want and len(got) == len(want)


def test_few_candidates(spark):
    """Two tokens that all sets have bring no pairs together."""
    rng = random.Random(6)
    rows = [(i, w) for i in range(400) for w in {"common", "frequent", *(f"r{rng.randrange(4000)}" for _ in range(8))}]
    sets = setjoin.token_sets(spark.createDataFrame(rows, "id long, w string"), "id", "w")
    counted = []
    assert setjoin.similar_sets(sets, Fraction(4, 5), counted).count() == 0
    assert counted[0] < 400 * 399 // 2 // 100


def test_copies_are_one_node_and_empty(spark):
    rows = [(i, w) for i in range(50) for w in "abc"] + [(100, "a"), (100, "b")]
    df = spark.createDataFrame(rows, "id long, w string")
    sets = setjoin.token_sets(df, "id", "w")
    assert sorted(len(r.ids) for r in sets.collect()) == [1, 50]
    (link,) = setjoin.similar_sets(sets, Fraction(2, 3)).collect()
    assert (link.shared, {link.size_a, link.size_b}) == (2, {2, 3})
    assert setjoin.set_join(df.limit(0), "id", "w", Fraction(1, 2)).collect() == []
    with pytest.raises(ValueError):
        setjoin.similar_sets(sets, Fraction(0))


def test_pairs_that_differ_too_much_end_where_they_meet(spark):
    """Tokens that are all alike in frequency bring most pairs together; few of those are near, and few others pass."""
    rng = random.Random(7)
    sets = [frozenset(rng.sample(range(60), rng.randint(3, 6))) for _ in range(500)]
    df = spark.createDataFrame([(i, w) for i, s in enumerate(sets) for w in s], "id long, w long")
    counted = []
    nodes = setjoin.token_sets(df, "id", "w")
    links = setjoin.similar_sets(nodes, Fraction(1, 2), counted).count()
    different = sorted(set(sets), key=sorted)
    pairs = [(a, b) for i, a in enumerate(different) for b in different[i + 1 :]]
    assert links == sum(2 * len(a & b) >= len(a | b) for a, b in pairs) > 50
    assert links <= counted[0] < 10 * links


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(9, 10)])
def test_sets_of_more_tokens_than_a_signature_has_bits(spark, t):
    rng = random.Random(8)
    sets = [set(rng.sample(range(400), rng.randint(40, 150))) for _ in range(30)]
    for k in (2, 8, 20, 30, 45, 60):
        sets += [s ^ set(rng.sample(range(400), k)) for s in sets[:8]]
    df = spark.createDataFrame([(i, f"t{w}") for i, s in enumerate(sets) for w in s], "id long, w string").repartition(3)
    got = {(r.id_a, r.id_b): r.similarity for r in setjoin.set_join(df, "id", "w", t).collect()}
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and Fraction(len(a & b), len(a | b)) >= t}
    assert got == want and len(want) > 10


def test_signatures_differ_in_no_more_bits_than_sets_in_tokens(spark):
    rng = random.Random(9)
    rows = [(rng.sample(range(300), rng.randint(0, 100)), rng.sample(range(300), rng.randint(0, 100))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", *(setjoin.signature(F.col(c)).alias(f"of_{c}") for c in "ab"))
    for r in df.collect():
        assert ((r.of_a ^ r.of_b) & (2**64 - 1)).bit_count() <= len(set(r.a) ^ set(r.b))


def test_tokens_that_a_collation_makes_equal(spark):
    rows = [(i, f"{'kK'[i % 2]}{w}") for i, ws in enumerate(["abc", "abd", "abc", "xyz", "xyb"]) for w in ws]
    df = spark.createDataFrame(rows, "id long, w string").selectExpr("id", "w collate UTF8_LCASE AS w")
    got = {(r.id_a, r.id_b): r.similarity for r in setjoin.set_join(df, "id", "w", Fraction(1, 2)).collect()}
    assert got == {(0, 1): 0.5, (0, 2): 1.0, (1, 2): 0.5, (3, 4): 0.5}
