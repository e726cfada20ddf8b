"""Relational helpers: top rows of groups, pivots, and exact statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.frames import frame_aggregates
from millrace.operators.joins import free_name


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark limits groups before the shuffle (WindowGroupLimit)."""
    rank = free_name("_rank", df)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k).drop(rank)


def latest_per_key(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """``columns`` of the latest row of each key, by an aggregate that combines before the shuffle."""
    best = F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col("_best").getField(c).alias(c) for c in columns))


def pivot(df: DataFrame, keys: list[str], by: str, values: list, agg: Column) -> DataFrame:
    """A column for each of ``values``; they are named, so no extra job looks for them."""
    return df.groupBy(*keys).pivot(by, values).agg(agg)


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def sessionize(df: DataFrame, keys: list[str], ts: str, gap: str, name: str = "session") -> DataFrame:
    """Number the sessions of each key, in column ``name``: a session ends where the next row is ``gap`` or more later."""
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    order = Window.partitionBy(*keys).orderBy(ts)
    opens = (F.col(ts) >= F.lag(ts).over(order) + F.expr(f"INTERVAL {gap}")).cast("int")
    return df.withColumn(name, F.sum(F.coalesce(opens, F.lit(0))).over(order))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows of each of ``bins`` equal steps; below and above in bins 0 and ``bins`` + 1."""
    return df.groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def groups_frame(
    df: DataFrame, agg: Callable[[Column], Column], value: str, name: str, keys: list[str], order: str, low: int, high: int
) -> DataFrame:
    """An aggregate over a GROUPS frame: ``low`` to ``high`` groups of equal ``order`` from the row's own, which is 0.

    Groups are numbered by their dense rank, so the frame is a range of numbers.
    ``agg`` is an aggregate function such as ``F.sum``. Nulls in ``order`` are a
    group, the first.
    """
    rank = free_name("_group", df)
    numbered = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    frame = Window.partitionBy(*keys).orderBy(rank).rangeBetween(low, high)
    return numbered.withColumn(name, agg(F.col(value)).over(frame)).drop(rank)


def sum_excluding(df: DataFrame, value: str, name: str, keys: list[str], order: str, exclude: str) -> DataFrame:
    """The sum of ``value`` over a key without the current row, its group of equal ``order``, or its ties.

    Null where nothing is left to add, as SQL has it. ``exclude``: "row", "group" or "ties".
    """
    kinds = {"row": "current row", "group": "group", "ties": "ties"}
    if exclude not in kinds:
        raise ValueError("exclude is row, group or ties")
    return frame_aggregates(df, keys, order, {name: ("sum", value)}, None, None, kinds[exclude])
