"""GROUPS frames with every kind of EXCLUDE, for any aggregate that can be merged.

Spark has neither. A frame without the excluded rows is the union of a left
part, a right part, and what stays of the row's own group. Groups are aggregated
first, so the left and right parts are frames over a row for each group, which
rows take from a join; peers before and behind the row are running aggregates
in two orders. The parts' aggregates are merged; nothing is subtracted, so NaN,
infinities and digits are those of the rows that are left. No window holds a
key's rows, and none starts anew for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import free_name
from millrace.operators.skew import join_groups
from millrace.storage import written

KINDS = ("no others", "current row", "group", "ties")


def _add(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


#: How the parts' values of an aggregate become one; avg is made of sum and count.
MERGE = {"sum": (F.sum, _add), "count": (F.count, _add), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def frame_aggregates(
    df: DataFrame,
    keys: list[str],
    order: str,
    aggregates: dict[str, tuple[str, str]],
    low: int | None = None,
    high: int | None = None,
    exclude: str = "no others",
) -> DataFrame:
    """``df`` with aggregates, ``name: (function, column)``, over GROUPS BETWEEN ``low`` AND ``high`` with an EXCLUDE.

    ``low`` and ``high`` count groups of equal ``order`` from the row's own, which is 0;
    None is unbounded. The functions are sum, count, min, max and avg.

    * Nulls in ``order`` are a group, the first. Null values don't count; an
      aggregate of nothing is null, and a count 0. Null keys are a key.
    * NaN is larger than all numbers for min and max, and spreads in sums, as it does in SQL.
    * Peers are in no order; which of them come before a row makes no difference.
    """
    return all_frame_aggregates(df, keys, order, [(aggregates, low, high, exclude)])


def all_frame_aggregates(
    df: DataFrame, keys: list[str], order: str, frames: list[tuple[dict[str, tuple[str, str]], int | None, int | None, str]]
) -> DataFrame:
    """:func:`frame_aggregates` for several frames ``(aggregates, low, high, exclude)`` over the same groups, which are made once."""
    for aggregates, low, high, exclude in frames:
        if exclude not in KINDS:
            raise ValueError(f"exclude is one of {', '.join(KINDS)}")
        if low is not None and high is not None and low > high:
            raise ValueError("the frame ends before it begins")
        if bad := {kind for kind, _ in aggregates.values()} - {*MERGE, "avg"}:
            raise ValueError(f"no way to merge {', '.join(sorted(bad))}")
    names = [n for aggregates, *_ in frames for n in aggregates]
    parts = {"avg": ("sum", "count")}
    wanted = dict.fromkeys((k, c) for aggregates, *_ in frames for kind, c in aggregates.values() for k in parts.get(kind, (kind,)))
    kinds = {w: df.select(MERGE[w[0]][0](w[1]).alias("x")).schema["x"].dataType for w in wanted}
    taken = df.select("*", *(F.lit(0).alias(n) for n in names if n not in df.columns))
    n, row = free_name("_n", taken), free_name("_row", taken)
    held = {w: free_name(f"_part{i}", taken) for i, w in enumerate(wanted)}
    groups = written(df.groupBy(*keys, order).agg(F.count("*").alias(n), *(MERGE[k][0](c).alias(held[k, c]) for k, c in wanted)), "groups")
    up = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())
    down = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())

    def total(w: tuple[str, str], first: int | None, last: int | None) -> Column:
        """Over the groups from ``first`` to ``last``."""
        window = up.rowsBetween(Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)
        if last is None and first is not None:  # from the end, as a running aggregate
            window = down.rowsBetween(Window.unboundedPreceding, -first)
        again = F.sum if w[0] == "count" else MERGE[w[0]][0]
        out = again(F.col(held[w])).over(window)
        return (F.coalesce(out, F.lit(0)) if w[0] == "count" else out).cast(kinds[w])

    sides: dict[str, Column] = {}  # of the groups, by column
    peers: dict[str, Column] = {}  # of the rows, by column
    results = {}
    before = Window.partitionBy(*keys, order).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys, order).orderBy(F.desc(row)).rowsBetween(Window.unboundedPreceding, -1)

    def of_frame(w: tuple[str, str], low: int | None, high: int | None, exclude: str) -> Column:
        kind, column = w
        found = []

        def add(to: dict[str, Column], value: Column) -> None:
            name = free_name(f"_value{len(sides) + len(peers)}", taken)
            to[name] = value
            found.append(F.col(name))

        own = (low is None or low <= 0) and (high is None or high >= 0)
        if exclude == "no others":
            add(sides, total(w, low, high))
        else:
            if low is None or low < 0:
                add(sides, total(w, low, -1 if high is None else min(high, -1)))
            if high is None or high > 0:
                add(sides, total(w, 1 if low is None else max(low, 1), high))
            if own and exclude == "current row":
                for window in (before, behind):
                    add(peers, MERGE[kind][0](F.col(column)).over(window))
            elif own and exclude == "ties":
                found.append((F.col(column).isNotNull().cast("long") if kind == "count" else F.col(column)).cast(kinds[w]))
        out = None
        for value in found:
            out = value if out is None else MERGE[kind][1](out, value)
        if out is None:
            out = F.lit(0).cast("long") if kind == "count" else F.lit(None).cast(kinds[w])
        return out

    for aggregates, low, high, exclude in frames:
        for name, (kind, column) in aggregates.items():
            if kind == "avg":
                results[name] = of_frame(("sum", column), low, high, exclude).cast("double") / F.nullif(of_frame(("count", column), low, high, exclude), F.lit(0))
            else:
                results[name] = of_frame((kind, column), low, high, exclude)
    table = written(groups.select(*keys, order, n, *(v.alias(c) for c, v in sides.items())), "sides")
    rows = df.withColumn(row, F.monotonically_increasing_id()) if peers else df
    count = groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    out = join_groups(rows, table, [*keys, order], n, count).withColumns(peers).withColumns(results)
    return out.select(*df.columns, *(c for c in dict.fromkeys(names) if c not in df.columns))
