"""Points in intervals of any length, by dyadic covers.

The common domain of points and intervals is divided into 2**bits cells. An
interval is covered by at most 2 * bits nodes of the binary tree over the cells,
however long it is; a point looks at one node of each level that a cover has.
So the join has equalities only, and what passes them is compared exactly.

Near the root there are few nodes, which many points share: points of these
levels are dealt over salts, and the covers' nodes there are repeated for each.
Pairs are counted by node before the join, and nodes with very many are cut
further (:func:`millrace.operators.skew.dealt_join`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import free_name
from millrace.operators.skew import dealt_join
from millrace.storage import written

#: Cells of the domain, as a power of two; a cover has twice as many rows at most.
BITS = 24
#: Levels below and with the root whose nodes are dealt over salts, and their number.
SALTED_LEVELS, SALTS = 5, 8


def _cell(value: Column, low: float, high: float, bits: int) -> Column:
    """The cell of a value in the domain from low to high. It never falls where the value rises."""
    share = F.when(F.lit(high > low), (value.cast("double") - F.lit(low)) / F.lit((high - low) or 1.0)).otherwise(F.lit(0.0))
    top = F.lit((1 << bits) - 1)
    return F.least(top, F.greatest(F.lit(0), F.floor(share * F.lit(float(1 << bits))))).cast("long")


def cover(low: str, high: str, bits: int) -> Column:
    """The nodes ``level, node`` that cover the cells from column ``low`` to ``high``, each cell once.

    At level k, ``a`` is the first node not yet covered and ``b`` the one behind
    the last; an odd ``a`` and an odd ``b`` have a neighbour outside the interval,
    so they, or the node before, are taken here and the rest by larger nodes.
    """
    levels = F.sequence(F.lit(0), F.lit(bits))

    def taken(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        a = F.call_function("shiftright", F.col(low) + size - 1, k)
        b = F.call_function("shiftright", F.col(high) + 1, k)
        node = lambda n, odd: F.struct(k.alias("level"), n.alias("node"), ((a < b) & (odd % 2 == 1)).alias("is_taken"))
        return F.array(node(a, a), node(b - 1, b))

    return F.filter(F.flatten(F.transform(levels, taken)), lambda n: n["is_taken"])


def dyadic_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, how: str = "inner", bits: int = BITS) -> DataFrame:
    """Left rows with the right intervals [low, high] that hold their ``point``; all three are numbers.

    * An interval is at most 2 * ``bits`` rows, and ``SALTS`` for each of them near the root.
    * Points and intervals with a null, NaN points, and intervals with ``low > high`` match nothing; ``how="left"`` keeps such left rows.
    * Infinite bounds reach over the whole domain; infinite points match as they compare.
    * Points in one cell with an end of an interval are told from it by comparing values, so ``bits`` is for speed only.
    """
    if how not in ("inner", "left"):
        raise ValueError("dyadic_join is inner or left")
    if not 1 <= bits <= 32:
        raise ValueError("the domain has from 2 to 2**32 cells")
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    a, b = (df.agg(*(f(finite(c)) for c in cs for f in (F.min, F.max))).first() for df, cs in ((left, [point]), (right, [low, high])))
    known = [v for v in (*a, *b) if v is not None] or [0.0]
    first, last = min(known), max(known)
    names = [free_name(n, left, right) for n in ("_level", "_node", "_salt", "_from", "_to", "_id")]
    level, node, salt, start, end, row = names
    spans = right.filter((F.col(low) <= F.col(high)) & ~F.isnan(F.col(low).cast("double")))
    spans = spans.withColumns({start: _cell(F.col(low), first, last, bits), end: _cell(F.col(high), first, last, bits)})
    listed = spans.withColumn(node, F.explode(cover(start, end, bits))).drop(start, end)
    listed = listed.withColumns({level: F.col(node)["level"], node: F.col(node)["node"]})
    near_root = F.col(level) > bits - SALTED_LEVELS
    salts = F.when(near_root, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    listed = written(listed.withColumn(salt, F.explode(salts)), "covers")
    levels = sorted(r[0] for r in listed.select(level).distinct().collect())  # bits + 1 at most
    points = left.withColumn(row, F.monotonically_increasing_id()) if how == "left" else left
    points = written(points, "points") if how == "left" else points
    asked = points.filter(F.col(point).isNotNull() & ~F.isnan(F.col(point).cast("double")))
    cell = _cell(F.col(point), first, last, bits)
    asked = asked.withColumn(start, cell).withColumn(level, F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>")))
    dealt = F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.lit(SALTS)).cast("int")
    asked = asked.withColumns({node: F.call_function("shiftright", F.col(start), F.col(level)), salt: F.when(near_root, dealt).otherwise(F.lit(0))})
    found = dealt_join(asked.drop(start), listed, [level, node, salt]).filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop(level, node, salt)
    if how == "inner":
        return found.select(*left.columns, *right.columns)
    rest = points.join(found.select(row).distinct(), row, "left_anti").drop(row)
    return found.select(*left.columns, *right.columns).unionByName(rest, allowMissingColumns=True)
