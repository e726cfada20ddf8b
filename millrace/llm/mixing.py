"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is ``r`` times its size would take each of its documents
``r`` times. The whole part of ``r`` is certain; the fraction is a probability
to round. Pairs of documents that both still have a fraction are rounded
together: words move at random from one to the other, in either direction with
the odds that keep both expectations, until one of the two is whole. As *words*
move, not probabilities, the words that the source takes stay the same in every
step, and only the last document that is left with a fraction, which goes to
the nearer whole number, can miss the target, by half its own size at most.

The pairs form a reduction tree. Documents of a source are dealt into buckets
by a hash; a bucket is a stream, largest documents first, that carries at most
one document with a fraction. What buckets are left with is dealt into fewer
buckets, and so on, up to one bucket a source. Memory is constant, a hot source
is dealt over many tasks, and a rerun draws the same random numbers, as they
are hashes of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import WORD_PATTERN, RowBuffer, arrow_schema, materialize, sliced, source_columns

#: Documents that a bucket of the first level holds on average.
BUCKET_DOCS = 4096
#: Buckets of a level that feed one of the next.
FAN_IN = 1024
_EPS = 1e-12
_ROWS = "id long, tie long, source string, size long, source_size long, target double, bucket long, u long, copies long, fraction double"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2)) -> dict[str | None, float]:
    """Target words of each source.

    Sources by code point, null last, weigh ``weights``, repeating, and share
    ``share`` of all words. A target stops at twice its source's size; the
    excess is shared again by weight, until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out: dict[str | None, Fraction] = {}
    left, open_ = share * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return {s: float(t) for s, t in out.items()}


def _uniform(u: int, step: int) -> float:
    """A number in [0, 1) from a row's hash and its place in the chain."""
    z = (u + 0x9E3779B97F4A7C15 * (step + 1)) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((z ^ z >> 31) >> 11) / (1 << 53)


def pair(a: int, p: float, b: int, q: float, draw: float) -> tuple[float, float]:
    """One pivotal step for documents of sizes a, b with fractions p, q; at least one comes out whole.

    p * a + q * b stays, and so do the expectations of p and q.
    """
    up = min((1 - p) * a, q * b)  # words that can go from the second to the first
    down = min(p * a, (1 - q) * b)
    move = up if draw * (up + down) < down else -down
    p, q = p + move / a, q - move / b
    snap = lambda x: 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
    return snap(p), snap(q)


def _chain(schema: pa.Schema, last: bool):
    """Round the rows of each (source, bucket), which come together, as a stream."""
    names = schema.names
    at = {n: names.index(n) for n in ("source", "bucket", "size", "u", "copies", "fraction")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, carry, group, step = RowBuffer(schema), None, None, 0

        def close() -> None:
            if carry is not None:
                if last:  # nobody is left to pair with: the nearer whole number
                    carry[at["copies"]] += int(carry[at["fraction"]] >= 0.5)
                    carry[at["fraction"]] = 0.0
                buffer.add(tuple(carry), 100)

        for batch in sliced(batches, 4096):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = list(row)
                if (row[at["source"]], row[at["bucket"]]) != group:
                    close()
                    carry, group, step = None, (row[at["source"]], row[at["bucket"]]), 0
                if row[at["fraction"]]:
                    if carry is None:
                        carry, row = row, None
                    else:
                        step += 1
                        p, q = pair(
                            carry[at["size"]], carry[at["fraction"]], row[at["size"]], row[at["fraction"]], _uniform(row[at["u"]], step)
                        )
                        carry[at["fraction"]], row[at["fraction"]] = p, q
                        if p in (0.0, 1.0) and q not in (0.0, 1.0):
                            carry, row = row, carry
                        for x in (carry, row):
                            if x[at["fraction"]] == 1.0:
                                x[at["copies"]] += 1
                                x[at["fraction"]] = 0.0
                        if not carry[at["fraction"]]:
                            buffer.add(tuple(carry), 100)
                            carry = None
                if row is not None:
                    buffer.add(tuple(row), 100)
                if buffer.full:
                    yield buffer.take()
        close()
        if buffer.rows:
            yield buffer.take()

    return run


def sizes_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, tie, source, size``: the words of each document, counted in the JVM; null text has none."""
    rows = source_columns(df, id=id_col, source=source_col, text=text_col)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return rows.select("id", F.xxhash64("text").alias("tie"), F.col("source").cast("string").alias("source"), words.alias("size"))


def mix_rows(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), seed: int = 7) -> DataFrame:
    """Decide how often each row of ``id, tie, source, size`` is taken (column ``copies``).

    What goes to the driver is one row a source: sources are the unit that
    weights are given for.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "sizes")
    totals = {r.source: (r.size, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    goal = targets({s: size for s, (size, _) in totals.items()}, weights, share)
    plan = [
        (s, size, goal[s], 1 + n // BUCKET_DOCS, *divmod(goal[s] / size if size else 0.0, 1.0)) for s, (size, n) in totals.items()
    ]
    plan_df = spark.createDataFrame(
        [(*row[:4], int(row[4]), row[5]) for row in plan],
        "plan_source string, source_size long, target double, buckets long, whole long, part double",
    )
    draw = F.xxhash64(F.lit(seed), "id", "tie", "size")
    rounded = (
        rows.join(F.broadcast(plan_df), rows["source"].eqNullSafe(plan_df["plan_source"]))  # one row a source
        .withColumn("u", draw)
        .withColumn("fraction", F.when((F.col("size") == 0) | (F.col("part") < _EPS), 0.0).otherwise(F.col("part")))
        .withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("whole")).cast("long"))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "u"), F.col("buckets")))
        .select("id", "tie", "source", "size", "source_size", "target", "bucket", "u", "copies", "fraction")
    )
    schema = arrow_schema(spark, _ROWS)
    widest = max((row[3] for row in plan), default=1)
    settled: DataFrame | None = None
    while True:
        last = widest == 1
        dealt = rounded.repartition("source", "bucket").sortWithinPartitions(
            "source", "bucket", F.desc("size"), "id", "tie"
        )
        level = dealt.mapInArrow(_chain(schema, last), _ROWS)
        level = level if last else materialize(level, "level")
        done = level if last else level.filter("fraction = 0")
        settled = done if settled is None else settled.unionAll(done)
        if last:
            return settled.drop("bucket", "u", "fraction")
        widest = -(-widest // FAN_IN)
        rounded = level.filter("fraction > 0").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))


def mix_documents(
    df: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: Fraction = Fraction(3, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 7,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every document.

    ``taken`` is ``copies`` times ``size``; copies are 0, 1 or 2 at a share that
    allows no more.

    * Null and empty texts have size 0 and are never taken. Very long texts count whole.
    * A null source is a source, the last in order. Null ids are kept.
    * Repeated rows are rounded each; rows alike in id, text and source are interchangeable.
    * An empty table gives no rows. Further columns are not read.
    """
    mixed = mix_rows(sizes_of(df, id_col, text_col, source_col), weights, share, seed)
    return mixed.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_copies(
    df: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: Fraction = Fraction(3, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 7,
) -> DataFrame:
    """The rows of ``df`` themselves, each as often as the mix takes it.

    * Null and empty texts have no words and aren't taken. Very long texts count whole.
    * A null source is a source, the last in order. Null ids are kept.
    * Rows alike in id, text and source share what they are given as evenly as
      whole numbers allow.
    * An empty table gives no rows. Further columns are carried along.
    """
    keys = ["mix_id", "mix_tie", "mix_source"]
    mixed = mix_rows(sizes_of(df, id_col, text_col, source_col), weights, share, seed)
    given = mixed.groupBy(F.col("id").alias("g_id"), F.col("tie").alias("g_tie"), F.col("source").alias("g_source")).agg(
        F.sum("copies").alias("g_copies"), F.count("*").alias("g_rows")
    )
    columns = df.columns
    body = df.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"),
        F.col(f"`{id_col}`").alias("mix_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("mix_tie"),
        F.col(f"`{source_col}`").cast("string").alias("mix_source"),
    )
    on = [body[b].eqNullSafe(given[g]) for b, g in zip(keys, ("g_id", "g_tie", "g_source"), strict=True)]
    joined = body.join(given.filter("g_copies > 0"), on)
    # rows alike are rare; only they are numbered, which takes another shuffle
    single = joined.filter("g_rows = 1").withColumn("times", F.col("g_copies"))
    order = Window.partitionBy("g_id", "g_tie", "g_source").orderBy("g_tie")
    n, rows = F.col("g_copies"), F.col("g_rows")
    each = F.floor(n / rows) + (F.row_number().over(order) <= F.pmod(n, rows)).cast("long")
    alike = joined.filter("g_rows > 1").withColumn("times", each)
    return (
        single.unionByName(alike)
        .filter("times > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
        .select(*(F.col("row").getField(c).alias(c) for c in columns))
    )
