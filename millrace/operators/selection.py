"""Exact quantiles of groups of any size, by distributed selection.

``percentile`` keeps every distinct value of a group in one buffer. Here a
quantile of a large group is closed in instead:

1. A mergeable sketch of the values between the present bounds gives new ones,
   a step of its grid to both sides of the wanted ranks.
2. An exact count of the rows below and between them tells whether they hold the
   ranks; if not, which the sketch's error bound excludes, they are made anew
   with a finer sketch.
3. Rows equal to a bound are counted and settled. Those strictly between are
   written, and the same is done with them, until a group's are so few that
   they fit one task.

Each round leaves about one row in sixty, so 10**12 rows take five, of which
only the first reads the table. Nothing but counts of groups is looked at by
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import join_groups
from millrace.storage import written

#: Rows of a group that one task may get.
FIT = 100_000
#: Steps of the grid by which a sketch divides a group; the sketch is ten times as fine.
GRID = 256


def _grid(x: Column, steps: int, fineness: int) -> Column:
    return F.percentile_approx(x, [k / steps for k in range(steps + 1)], steps * fineness)


def _at(grid: str, step: Column, steps: int) -> Column:
    return F.element_at(F.col(grid), (F.greatest(F.lit(0), F.least(F.lit(steps), step)) + 1).cast("int"))


def _totals(tally: DataFrame, column: str) -> int:
    return tally.agg(F.sum(column)).first()[0] or 0


def _with(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join two tables of groups, null keys included; the keys are those of the left one."""
    right = right.withColumnsRenamed({k: f"s_{k}" for k in names})
    same: Column = F.lit(True)
    for k in names:
        same = same & left[k].eqNullSafe(right[f"s_{k}"])
    return left.join(right, same, how).drop(*(f"s_{k}" for k in names))


def _closed_in(rows: DataFrame, live: DataFrame, names: list[str], steps: int, fineness: int) -> tuple[DataFrame, DataFrame]:
    """The ``live`` groups after one round, written, and the rows between their bounds, written.

    Rows equal to a new bound may be very many, so they are counted and left
    out: a rank among them, or next to them, is resolved at once.
    """
    total = _totals(live, "inside")
    between = (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))
    held = join_groups(rows, live.select(*names, "low", "high", "inside"), names, "inside", total).filter(between)
    wanted = _with(live, held.groupBy(*names).agg(_grid(F.col("x"), steps, fineness).alias("grid")), names)
    place = lambda r: (F.col(r) - F.col("below")) / F.col("inside") * steps
    new = {"a": _at("grid", F.floor(place("r0")) - 1, steps), "b": _at("grid", F.ceil(place("r1")) + 1, steps)}
    bounds = written(wanted.withColumns(new).drop("grid"), "bounds")
    near = join_groups(rows, bounds.select(*names, "low", "high", "a", "b", "inside"), names, "inside", total).filter(between)
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    counts = near.groupBy(*names).agg(
        F.count_if(x < a).alias("before"),
        F.count_if(x == a).alias("at_a"),
        F.count_if(x == b).alias("at_b"),
        F.count_if((x >= a) & (x <= b)).alias("held"),
        F.min(F.when((x > a) & (x <= b), x)).alias("next"),
        F.max(F.when((x < b) & (x >= a), x)).alias("last"),
    )
    merged = _with(bounds, counts, names)
    r0, r1 = F.col("r0"), F.col("r1")
    first = F.col("below") + F.col("before")
    inner = first + F.col("at_a")  # ranks below are a, or too low
    outer = first + F.col("held") - F.col("at_b")  # ranks from here are b, or too high
    holds = (first <= r0) & (r1 < first + F.col("held"))
    v0 = F.when(r0 < inner, a).when(r0 >= outer, b).when(r1 >= outer, F.col("last"))
    v1 = F.when(r1 < inner, a).when(r1 >= outer, b).when(r0 < inner, F.col("next"))
    moved = holds & (r0 >= inner) & (r1 < outer)
    change = {"low": F.col("next"), "high": F.col("last"), "below": inner, "inside": outer - inner}
    columns = {"holds": holds, "v0": F.when(holds, v0), "v1": F.when(holds, v1)}
    merged = merged.withColumns(columns | {c: F.when(moved, v).otherwise(F.col(c)) for c, v in change.items()}).select(*live.columns)
    merged = written(merged, "bounds")
    open_ones = merged.filter("v0 is null").select(*names, "low", "high", "inside")
    kept = join_groups(rows, open_ones, names, "inside", _totals(open_ones, "inside")).filter(between)
    return merged, written(kept.select(*names, "x"), "between")


def exact_quantiles(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], fit: int = FIT, steps: int = GRID, trace: list[int] | None = None
) -> DataFrame:
    """``keys`` and, for each name of ``wanted`` (column, fraction), the quantile between its two nearest rows, as a double.

    Equal to ``percentile`` (linear interpolation). ``fit`` bounds the rows of a
    group in one task; ``trace`` gets the number of rows written by each round.

    ``steps`` is 8 at least: a round keeps about four steps.

    * Null values don't count; a group that has nothing else has null. NaN is
      the largest value. Null keys are a group; no keys make one of the table.
    * An empty table gives no rows, without keys one row of nulls.
    """
    names = [f"k{i}" for i in range(len(keys))]
    entries = [F.struct(F.lit(i).alias("slot"), F.col(column).cast("double").alias("x")) for i, (column, _) in enumerate(wanted.values())]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.inline(F.array(*entries)))
    groups = [*names, "slot"]
    if steps < 8:
        raise ValueError("a round that keeps four steps needs more of them")
    number = F.when(~F.isnan("x"), F.col("x"))
    fraction: Column = F.lit(None)
    for i, (_, p) in enumerate(wanted.values()):
        if not 0 <= p <= 1:
            raise ValueError("a fraction is from 0 to 1")
        fraction = F.when(F.col("slot") == i, F.lit(float(p))).otherwise(fraction)
    state = rows.groupBy(*groups).agg(F.count("x").alias("n"), F.count(number).alias("inside"), F.min(number).alias("low"), F.max(number).alias("high"))
    if not keys:  # the table is a group even if it is empty
        slots = df.sparkSession.createDataFrame([(i,) for i in range(len(wanted))], "slot int")
        state = slots.join(state, "slot", "left").fillna(0, ["n", "inside"])
    place = fraction * (F.col("n") - 1)
    state = state.withColumns({"place": place, "below": F.lit(0).cast("long"), "holds": F.lit(True)})
    # ranks of NaN are looked up among the numbers, and overruled in the end
    top = F.greatest(F.col("inside") - 1, F.lit(0))
    state = state.withColumns({"r0": F.least(F.floor("place"), top), "r1": F.least(F.ceil("place"), top), "numbers": F.col("inside")})
    alone = F.when(F.col("low") == F.col("high"), F.col("low"))  # one value only
    state = written(state.withColumns({"v0": alone, "v1": alone}), "groups")
    closed = (F.col("inside") <= fit) | F.col("v0").isNotNull()
    done, live = state.filter(closed), state.filter(~closed)
    sources = [(rows.filter("not isnan(x)"), done.filter("inside > 0 and v0 is null"))]
    kept, fineness = rows.filter("not isnan(x)"), 10
    while not live.isEmpty():
        bounds, kept = _closed_in(kept, live, groups, steps, fineness)
        if trace is not None:
            trace.append(kept.count())
        if not bounds.filter("not holds").isEmpty():
            fineness *= 10
        sources.append((kept, bounds.filter(closed & F.col("v0").isNull())))
        done = done.unionByName(bounds.filter(closed).select(*done.columns))
        live = bounds.filter(~closed).select(*state.columns)
    found = None
    for source, ready in sources:
        part = _looked_up(source, ready, groups)
        found = part if found is None else found.unionByName(part)
    both = _with(done.withColumnsRenamed({"v0": "known0", "v1": "known1"}), found, groups, "left")
    both = both.withColumns({"v0": F.coalesce("known0", "v0"), "v1": F.coalesce("known1", "v1")})
    value = lambda r, v: F.when(F.col(r) >= F.col("numbers"), F.lit(float("nan"))).otherwise(F.col(v))
    low, high = value("place_low", "v0"), value("place_high", "v1")
    both = both.withColumns({"place_low": F.floor("place"), "place_high": F.ceil("place")})
    # a whole place takes one row only, so that infinite or NaN neighbours don't matter
    mixed = (F.col("place_high") - F.col("place")) * low + (F.col("place") - F.col("place_low")) * high
    both = both.withColumn("value", F.when(F.col("n") > 0, F.when(F.col("place_low") == F.col("place_high"), low).otherwise(mixed)))
    out = both.groupBy(*names).agg(*(F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"v{i}_out") for i in range(len(wanted))))
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), *(F.col(f"v{i}_out").alias(w) for i, w in enumerate(wanted)))


def _looked_up(rows: DataFrame, ready: DataFrame, groups: list[str]) -> DataFrame:
    """The values ``v0`` and ``v1`` of the ranks r0 and r1 of groups whose rows are few, or all equal between the bounds."""
    total = _totals(ready, "inside")
    columns = ["low", "high", "below", "inside", "r0", "r1"]
    near = join_groups(rows, ready.select(*groups, *columns), groups, "inside", total).filter("x >= low and x <= high")
    values = near.groupBy(*groups, "x").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("below", "r0", "r1")))
    upto = F.sum("times").over(Window.partitionBy(*groups).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    values = values.withColumn("upto", upto)  # no more values than fit a task
    at = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("x")))
    return values.groupBy(*groups).agg(at("r0").alias("v0"), at("r1").alias("v1"))
