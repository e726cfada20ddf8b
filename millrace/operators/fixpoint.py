"""Recursive queries over tables, semi-naively: each round joins only the rows that the last one has found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import release, shared_dir

#: Tables of single rounds that are gathered into one before more are made.
GATHER = 8


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], rounds: int | None = None, round_col: str = "round") -> DataFrame:
    """All rows that follow from ``seed``: those of ``seed``, and what ``step`` makes of rows found, until nothing is new.

    ``step`` gets the rows that the last round found and returns rows of the
    same columns. A row is new if no row so far has its ``keys``; of rows alike
    in the keys the first by all columns stays. ``round_col`` counts the rounds, 0 for ``seed``.

    Every round is a table in the shared folder, so a lost executor costs a
    round at most, and plans stay small. Null keys equal each other. An empty
    seed gives no rows. ``rounds`` ends a search that needs no end; None goes on
    until no row is new.
    """
    spark, columns = seed.sparkSession, seed.columns
    if round_col in columns:
        raise ValueError(f"there is a column {round_col}")

    def one_each(df: DataFrame) -> DataFrame:
        rest = [c for c in columns if c not in keys]
        if not rest:
            return df.select(*columns).distinct()
        best = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_rest"))  # combined before its shuffle
        return best.select(*(F.col(c) if c in keys else F.col("_rest")[c].alias(c) for c in columns))

    def same(a: DataFrame, b: DataFrame) -> Column:
        on: Column = F.lit(True)
        for k in keys:
            on = on & a[k].eqNullSafe(b[f"_known_{k}"])
        return on

    delta, path = _written(one_each(seed).withColumn(round_col, F.lit(0)), "round")
    tables, paths, number = [delta], [path], 0
    while not delta.isEmpty() and (rounds is None or number < rounds):
        number += 1
        known = tables[0]
        for t in tables[1:]:
            known = known.unionAll(t)
        grown = one_each(step(delta.drop(round_col)))
        held = known.select(*(F.col(k).alias(f"_known_{k}") for k in keys))
        new = grown.join(held, same(grown, held), "left_anti").withColumn(round_col, F.lit(number))
        delta, path = _written(new, "round")
        tables.append(delta)
        paths.append(path)
        if len(tables) > GATHER:
            gathered = tables[0]
            for t in tables[1:-1]:
                gathered = gathered.unionAll(t)
            whole, whole_path = _written(gathered, "known")
            for old in paths[:-1]:
                release(spark, old)
            tables, paths = [whole, delta], [whole_path, path]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def reachable(edges: DataFrame, origins: DataFrame, source: str, target: str, origin: str) -> DataFrame:
    """``origin, node, hops``: what each origin reaches along the edges, itself included, by the fewest hops.

    Edges with a null end lead nowhere; null origins are left out. Repeated
    edges, loops and cycles are allowed.
    """
    links = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a is not null and b is not null").distinct()
    links = _written(links, "edges")[0]
    seed = origins.select(F.col(origin).alias("origin"), F.col(origin).alias("node")).filter("origin is not null").distinct()

    def step(found: DataFrame) -> DataFrame:
        return found.join(links, found["node"] == links["a"]).select("origin", F.col("b").alias("node"))

    return fixpoint(seed, step, ["origin", "node"], round_col="hops").select(F.col("origin").alias(origin), "node", F.col("hops").cast("long").alias("hops"))
