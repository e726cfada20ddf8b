"""Exact similarity join of sets, by prefixes in a global order of tokens (after Xiao et al. 2008, PPJoin).

Tokens are ordered from rare to frequent. Sets whose Jaccard similarity reaches
t must share a token of their prefixes, the first |x| - ceil(t |x|) + 1 tokens,
so only prefixes are joined, and frequent tokens are seldom in one. A pair must
also be alike in length, and what is left of both sets behind the shared token
must be enough. A signature of 64 bits, which travels with each prefix token,
says how many tokens differ at least (after Sandes et al. 2020, bitmap filter),
so pairs that differ too much end where they meet: they are neither shuffled nor
joined with their sets. What passes is compared whole.

Equal sets are one node; links between nodes are found once, however many copies
they have.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import written


def _least(n: Column, t: Fraction) -> Column:
    """ceil(t n), in whole numbers."""
    return F.floor((n * t.numerator + (t.denominator - 1)) / t.denominator).cast("long")


def token_sets(df: DataFrame, id_col: str, token_col: str) -> DataFrame:
    """``node, size, tokens`` and the ``ids`` of each distinct set; the rarest tokens first.

    The rows are (id, token) pairs. Nulls are left out, repeated pairs count
    once, and an id without tokens has no set. A set is one row, so its tokens
    must fit a row; tokens and ids may be of any type that has an order.
    """
    pairs = df.select(F.col(id_col).alias("id"), F.col(token_col).alias("token")).filter("id is not null and token is not null").distinct()
    pairs = written(pairs, "pairs")
    often = pairs.groupBy("token").agg(F.count("*").alias("times"))
    # the order is by frequency, then token; once the tokens stand in it, their frequencies aren't kept
    rank = F.struct("times", "token")
    # tokens that a collation makes equal become one of them, as they must have one bit in signatures
    ranked = pairs.withColumnRenamed("token", "as_read").join(often, F.col("as_read") == F.col("token"))
    sets = ranked.groupBy("id").agg(F.array_sort(F.collect_list(rank)).getField("token").alias("tokens"))
    sets = sets.groupBy("tokens").agg(F.collect_list("id").alias("ids"))
    return written(sets.select(F.monotonically_increasing_id().alias("node"), F.size("tokens").cast("long").alias("size"), "tokens", "ids"), "sets")


def signature(tokens: Column) -> Column:
    """A long with a bit for each of 64 classes of tokens: whether an odd number of the set's tokens are in it.

    Shared tokens cancel out, so two sets' signatures differ in at most as many bits as there are tokens in one of them only.
    """
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(bit(x)))


def candidate_pairs(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """``a, b`` (a < b): pairs of nodes that pass the prefix, length, position and signature filters."""
    prefix = F.col("size") - _least(F.col("size"), threshold) + 1
    # the place of the token, from 1, and the token; the signature is made once a set, below the explosion
    heads = sets.select("node", "size", signature(F.col("tokens")).alias("bits"), F.slice("tokens", F.lit(1), prefix.cast("int")).alias("head"))
    heads = heads.select("node", "size", "bits", F.posexplode("head").alias("at", "token"))
    heads = heads.select("node", "size", "bits", (F.col("at") + 1).alias("at"), "token")
    x, y = heads.select(*(F.col(c).alias(f"{c}_x") for c in heads.columns)), heads.select(*(F.col(c).alias(f"{c}_y") for c in heads.columns))
    short, long_ = F.least("size_x", "size_y"), F.greatest("size_x", "size_y")
    alike = short >= _least(long_, threshold)
    # |x and y| >= t (|x| + |y|) / (1 + t)
    needed = _least(F.col("size_x") + F.col("size_y"), threshold / (1 + threshold))
    left = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y")) + F.least("at_x", "at_y")
    # |x and y| = (|x| + |y| - tokens in one only) / 2
    near = F.bit_count(F.col("bits_x").bitwiseXOR(F.col("bits_y"))) <= F.col("size_x") + F.col("size_y") - 2 * needed
    met = x.join(y, (F.col("token_x") == F.col("token_y")) & (F.col("node_x") < F.col("node_y")) & alike & (left >= needed) & near)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def similar_sets(sets: DataFrame, threshold: Fraction, counted: list[int] | None = None) -> DataFrame:
    """``a, b, shared, size_a, size_b`` of all pairs of nodes with a Jaccard similarity of ``threshold`` at least."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    pairs = candidate_pairs(sets, threshold)
    if counted is not None:
        pairs = written(pairs, "candidates")
        counted.append(pairs.count())
    one = sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("tokens").alias("tokens_a"))
    other = sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(one, "a").join(other, "b").withColumn("shared", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long"))
    enough = F.col("shared") * threshold.denominator >= (F.col("size_a") + F.col("size_b") - F.col("shared")) * threshold.numerator
    return both.filter(enough).select("a", "b", "shared", "size_a", "size_b")


def set_join(df: DataFrame, id_col: str, token_col: str, threshold: Fraction) -> DataFrame:
    """``id_a, id_b, similarity`` (id_a < id_b) of all pairs of ids whose sets of tokens are that similar.

    Copies are paired too, so n ids with one set give n (n - 1) / 2 rows; where that
    is too many, use :func:`token_sets` and :func:`similar_sets`, which don't.
    """
    sets = token_sets(df, id_col, token_col)
    links = similar_sets(sets, threshold)
    ids = sets.select("node", F.explode("ids").alias("id"))
    apart = links.join(ids.select(F.col("node").alias("a"), F.col("id").alias("p")), "a").join(ids.select(F.col("node").alias("b"), F.col("id").alias("q")), "b")
    similarity = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    apart = apart.select("p", "q", similarity.alias("similarity"))
    same = ids.select("node", F.col("id").alias("p")).join(ids.select("node", F.col("id").alias("q")), "node").filter("p < q")
    both = apart.unionAll(same.select("p", "q", F.lit(1.0)))
    return both.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "similarity")
