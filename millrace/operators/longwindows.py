"""Window functions over keys of any length, in two levels.

Rows are range-partitioned by key and order, so a long key is cut into slices,
each of a partition's size, and Spark's own window functions run within slices.
What a slice adds, its rows, distinct order values, sums and last values, is a row
of a small table; running sums over it say what each slice brings along from
those before. Peers, rows of equal order, may stand on both sides of a cut: the
first and last peers of each slice are put together before they are ranked.

At most one key goes on from a partition to the next, so there are no more than
two such slices for a partition, and their tables go to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import written

#: Functions without an argument; with a column; with a column and a number of rows.
RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist")
RUNNING = ("sum", "count", "min", "max", "first", "last")
OFFSETS = ("lag", "lead")


def _sorted(name: str, direction: str) -> Column:
    return F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_first()


def _tile(place: Column, n: Column, tiles: int) -> Column:
    small, extra = F.floor(n / tiles), n % tiles
    wide = extra * (small + 1)
    first = F.floor((place - 1) / (small + 1)) + 1
    return F.when(place <= wide, first).otherwise(extra + F.floor((place - 1 - wide) / F.nullif(small, F.lit(0))) + 1)


def _on(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out: Column = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[f"s_{n}"])
    return out


def _beside(rows: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """Left join with a table that is small by construction, equal nulls matching; a row matches one at most."""
    table = F.broadcast(table.withColumnsRenamed({n: f"s_{n}" for n in names}))
    return rows.join(table, _on(rows, table, names), "left").drop(*(f"s_{n}" for n in names))


def long_windows(df: DataFrame, keys: list[str], order: list[tuple[str, str]], functions: dict[str, tuple]) -> DataFrame:
    """``df`` with a column for each of ``functions``, over windows partitioned by ``keys`` and ordered by ``order``.

    ``order``: (column, "asc" or "desc"); nulls are the smallest. ``functions``:

    * ("row_number",) ("rank",) ("dense_rank",) ("percent_rank",) ("cume_dist",) ("ntile", n)
    * ("lag", column, n) ("lead", column, n)
    * ("sum", column), and count, min, max, first, last likewise: over the rows so far, the own
      one included (ROWS UNBOUNDED PRECEDING); first and last skip nulls

    Where rows tie in ``order``, ranks are those of SQL, and the others take them
    in one and the same arbitrary order. Null keys are a key; no keys make one of the table. An empty
    table gives no rows. Names of ``functions`` must not be columns of ``df``.
    """
    if set(functions) & set(df.columns):
        raise ValueError("a function's name is a column already")
    for f in functions.values():
        if f[0] not in (*RANKS, *RUNNING, *OFFSETS, "ntile"):
            raise ValueError(f"no window function {f[0]}")
    ks, os = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
    values = {n: f"v_{i}" for i, (n, f) in enumerate(functions.items()) if f[0] in (*RUNNING, *OFFSETS)}
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
        *(F.col(c).alias(k) for c, k in zip(keys, ks, strict=True)),
        *(F.col(c).alias(o) for (c, _), o in zip(order, os, strict=True)),
        *(F.col(functions[n][1]).alias(v) for n, v in values.items()),
        F.monotonically_increasing_id().alias("row_id"),
    )
    by = [_sorted(o, d) for o, (_, d) in zip(os, order, strict=True)]
    dealt = rows.repartitionByRange(*(_sorted(k, "asc") for k in ks), *by, F.col("row_id").asc()).withColumn("part", F.spark_partition_id())
    peers, lines = Window.partitionBy(*ks, "part").orderBy(*by), Window.partitionBy(*ks, "part").orderBy(*by, "row_id")
    so_far = lines.rowsBetween(Window.unboundedPreceding, 0)
    local = {
        "place": F.row_number().over(lines).cast("long"),
        "rank": F.rank().over(peers).cast("long"),
        "dense": F.dense_rank().over(peers).cast("long"),
        "upto": F.count("*").over(peers.rangeBetween(Window.unboundedPreceding, 0)),
        "rows": F.count("*").over(Window.partitionBy(*ks, "part")),
    }
    running = {n: functions[n][0] for n in values if functions[n][0] in RUNNING}
    for n, kind in running.items():
        v = F.col(values[n])
        of = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "first": lambda c: F.first(c, True), "last": lambda c: F.last(c, True)}[kind]
        local[f"r_{values[n]}"] = of(v).over(so_far)
    for n in values:
        if functions[n][0] in OFFSETS:
            local[f"r_{values[n]}"] = (F.lag if functions[n][0] == "lag" else F.lead)(values[n], functions[n][2]).over(lines)
    held = written(dealt.withColumns(local).drop(*(values[n] for n in running)), "slices")

    # a row for each slice of a key that has several
    slice_rows = held.filter((F.col("place") == 1) | (F.col("place") == F.col("rows")))
    at = lambda c, first: F.max(F.when((F.col("place") == 1) if first else (F.col("place") == F.col("rows")), c))
    peer = F.struct(F.lit(1).alias("one"), *os)
    slices = slice_rows.groupBy(*ks, "part").agg(
        F.max("rows").alias("rows"),
        at(F.col("dense"), False).alias("dense"),
        at(F.col("upto"), True).alias("head_rows"),
        (F.max("rows") - at(F.col("rank"), False) + 1).alias("tail_rows"),
        F.max_by(peer, F.col("place") == 1).alias("head"),
        F.max_by(peer, F.col("place") == F.col("rows")).alias("tail"),
        *(F.max_by(f"r_{values[n]}", F.col("place") == F.col("rows")).alias(f"t_{values[n]}") for n in running),
    )
    slices = slices.withColumn("parts", F.count("*").over(Window.partitionBy(*ks))).filter("parts > 1").drop("parts")
    chain = Window.partitionBy(*ks).orderBy("part")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce(F.col("head").eqNullSafe(F.lag("tail").over(chain)), F.lit(False)).cast("long")
    slices = slices.withColumn("goes_on", goes_on)
    combine = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "first": lambda c: F.first(c, True), "last": lambda c: F.last(c, True)}
    slices = slices.withColumns(
        {
            "before": F.coalesce(F.sum("rows").over(before), F.lit(0)),
            "dense_before": F.coalesce(F.sum("dense").over(before), F.lit(0)) - F.sum("goes_on").over(chain.rowsBetween(Window.unboundedPreceding, 0)),
            "n": F.sum("rows").over(Window.partitionBy(*ks)),
            **{f"b_{values[n]}": combine[kind](f"t_{values[n]}").over(before) for n, kind in running.items()},
        }
    )
    slices = written(slices, "carried")
    whole_slice = F.col("head_rows") == F.col("rows")
    heads = slices.select(*ks, F.col("head").alias("peer"), F.col("before").alias("start"), F.col("head_rows").alias("size"))
    tails = slices.filter(~whole_slice).select(*ks, F.col("tail").alias("peer"), (F.col("before") + F.col("rows") - F.col("tail_rows")).alias("start"), F.col("tail_rows").alias("size"))
    edges = heads.unionAll(tails).groupBy(*ks, "peer").agg(F.min("start").alias("start"), F.sum("size").alias("size"))
    edges = edges.select(*ks, *(F.col("peer")[o].alias(o) for o in os), "start", "size")

    carried = slices.select(*ks, "part", "before", "dense_before", "n", *(f"b_{values[n]}" for n in running))
    out = _beside(held, carried, [*ks, "part"])
    out = _beside(out, edges, [*ks, *os])
    zero = F.lit(0)
    out = out.withColumns({"n": F.coalesce("n", "rows"), "at": F.col("place") + F.coalesce("before", zero), "cut": F.col("before").isNotNull()})
    rank = F.when(F.col("start").isNotNull(), F.col("start") + 1).otherwise(F.col("rank") + F.coalesce("before", zero))
    upto = F.when(F.col("start").isNotNull(), F.col("start") + F.col("size")).otherwise(F.col("upto") + F.coalesce("before", zero))
    n = F.col("n")
    results: dict[str, Column] = {}
    for name, f in functions.items():
        kind = f[0]
        if kind in OFFSETS:
            out = _reached(out, held, carried, ks, values[name], kind, f[2])
            results[name] = F.col(f"r_{values[name]}")
        elif kind in RUNNING:
            own, prior = F.col(f"r_{values[name]}"), F.col(f"b_{values[name]}")
            both = {
                "sum": F.when(own.isNull(), prior).otherwise(own + F.coalesce(prior, zero)),
                "count": own + F.coalesce(prior, zero),
                "min": F.least(own, prior),
                "max": F.greatest(own, prior),
                "first": F.coalesce(prior, own),
                "last": F.coalesce(own, prior),
            }
            results[name] = both[kind]
        elif kind == "ntile":
            results[name] = _tile(F.col("at"), n, f[1])
        else:
            results[name] = {
                "row_number": F.col("at"),
                "rank": rank,
                "dense_rank": F.col("dense") + F.coalesce("dense_before", zero),
                "percent_rank": F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.0)),
                "cume_dist": upto / n,
            }[kind]
    return out.select(*(F.col("row")[c].alias(c) for c in df.columns), *(v.alias(k) for k, v in results.items()))


def _reached(out: DataFrame, held: DataFrame, carried: DataFrame, ks: list[str], value: str, kind: str, rows: int) -> DataFrame:
    """``out`` with values of ``lag`` or ``lead`` that lie in another slice: a slice's last, or first, few rows are looked up by their place."""
    if rows < 0:
        raise ValueError("lag and lead go over a number of rows")
    edge = F.col("rows") - F.col("place") < rows if kind == "lag" else F.col("place") <= rows
    found = held.filter(edge).select(*ks, "part", "place", F.col(value).alias("there"))
    known = carried.select(*ks, "part", "before")
    table = F.broadcast(known.withColumnsRenamed({n: f"s_{n}" for n in (*ks, "part")}))
    found = found.join(table, _on(found, table, [*ks, "part"])).select(*ks, (F.col("place") + F.col("before")).alias("wanted"), F.struct("there").alias("far"))
    out = out.withColumn("wanted", F.col("at") - rows if kind == "lag" else F.col("at") + rows)
    inside = F.col("place") > rows if kind == "lag" else F.col("rows") - F.col("place") >= rows
    out = _beside(out, found, [*ks, "wanted"])  # a few rows for each slice of a long key
    name = f"r_{value}"
    return out.withColumn(name, F.when(inside | ~F.col("cut"), F.col(name)).otherwise(F.col("far")["there"])).drop("wanted", "far")
