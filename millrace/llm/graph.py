"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import discard, materialize


#: A key is heavy that has so many rows at least, or one in so many of all.
HEAVY_ROWS, HEAVY_PART = 64, 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with a table that has one row for each key and the number ``n`` of rows of that key.

    Keys with a thousandth of all ``total`` rows or more are broadcast, a
    thousand of them at most, so that no task gets all rows of one key; the
    others are shuffled. Keys aren't null.
    """
    least = max(HEAVY_ROWS, total // HEAVY_PART)
    heavy, light = F.broadcast(table.filter(F.col(n) >= least)), table.filter(F.col(n) < least)
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys)
    return rows.join(heavy, keys).unionByName(rest)


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``a`` and its number of rows; summed before the shuffle, so a hub is no burden."""
    return edges.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Larger neighbours of a node move to the smallest of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).withColumn("least", F.least("a", "least"))
    return join_counted(both.filter("b > a"), least, ["a"], total).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Edges lead downwards."""
    least = _least(edges)
    moved = join_counted(edges, least, ["a"], total).select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return moved.unionAll(least.select("a", F.col("least").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of the edges ``a, b`` (long); a component is named by its smallest node.

    Large-star and small-star steps (Kiveris et al. 2014) alternate until the
    edges are stars around the smallest nodes. Each round is a written table;
    what the driver sees of it is a count and a checksum, and the round before is deleted. Edges of a node to
    itself, repeated edges and an empty table are allowed.
    """
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    current = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark, before = seen, current
        stars = materialize(_large_star(current, 2 * seen[0]), "stars")
        current = materialize(_small_star(stars, seen[0]), "edges")
        discard(before, stars)
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    hubs = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    return stars.unionAll(hubs).unionAll(alone).groupBy("node").agg(F.min("component").alias("component"))
