"""Shards of near equal bytes by longest-processing-time scheduling.

Documents of equal text stay together. The groups, largest first, go each to
the shard that is least loaded so far, through a heap (Graham 1969).

Groups of one size are interchangeable, so the heap needs their numbers, not
the groups: the driver gets a histogram of group sizes and deals whole runs of
one size. Sizes below 4096 bytes are classes of their own; above, a class holds
sizes that agree in their leading 12 bits, and counts with its mean. There are
4096 classes and 2048 for each further doubling, whatever the corpus, and the
loads are off by less than one part in 2048. Groups then take their places in
the dealt runs by ranks that are counted partition by partition.
"""

from __future__ import annotations

import heapq
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import discard, source_columns
from millrace.llm.graph import join_counted
from millrace.llm.ranks import numbered, tagged

#: Leading bits in which the sizes of a class agree.
CLASS_BITS = 12


def longest_first(classes: list[tuple[int, int, int]], shards: int) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """Deal groups of the classes (size class, groups, their bytes); returns runs (class, first rank, end, shard) and the loads.

    Each group goes to the least loaded shard, of equal ones to the first. As
    long as no other shard is less loaded, one takes several groups of a class
    at once; once the loads differ by no more than such a group, all take turns.
    """
    heap = [(0.0, j) for j in range(shards)]
    runs = []
    for size, left, total in sorted(classes, reverse=True):
        mean, given = total / left, dict.fromkeys(range(shards), 0)
        while left:
            if left >= shards and max(heap)[0] - heap[0][0] <= mean:
                turns = left // shards
                heap = [(load + turns * mean, j) for load, j in heap]  # order, and so the heap, stays
                for j in given:
                    given[j] += turns
                left -= turns * shards
                continue
            load, j = heap[0]
            second = min(heap[1:3])[0] if shards > 1 else float("inf")
            k = left if shards == 1 else min(left, max(1, ceil((second - load) / mean)))
            heapq.heapreplace(heap, (load + k * mean, j))
            given[j] += k
            left -= k
        rank = 0
        for j, k in given.items():
            if k:
                runs.append((size, rank, rank + k, j))
                rank += k
    loads = [0.0] * shards
    for load, j in heap:
        loads[j] = load
    return runs, loads


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _class_of(size: str) -> Column:
    """The size without the bits behind its leading ones."""
    drop = f"greatest(0, length(bin({size})) - {CLASS_BITS})"
    return F.expr(f"shiftleft(shiftright({size}, {drop}), {drop})")


def place_groups(slim: DataFrame, shards: int) -> DataFrame:
    """``key, n, shard`` of each group of the rows ``key, size``: equal keys, which have equal sizes, are a group of n rows."""
    spark = slim.sparkSession
    groups = slim.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = tagged(groups.withColumn("class", _class_of("bytes")), "groups")
    # bounded: 4096 classes, and 2048 for each doubling of the size of a group
    found = groups.groupBy("class").agg(F.count("*").alias("groups"), F.sum("bytes").alias("bytes")).collect()
    runs, _ = longest_first([(r["class"], r["groups"], r["bytes"]) for r in found], shards)
    plan = spark.createDataFrame(runs, "class long, low long, high long, shard int")
    placed = numbered(groups, ["class"], "rank").join(F.broadcast(plan), "class")  # at most one row for each class and shard
    return placed.filter("rank >= low and rank < high").select("key", "n", "shard")


def assign_shards(df: DataFrame, shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row of ``df``.

    ``size`` is the text's UTF-8 bytes and ``overhead``; ``law`` is "bytes",
    and ``grown_shard`` null; ``slot`` numbers a shard's rows from 0, gapless.

    * Null texts count as empty, and share a shard with the empty ones.
    * Very long texts count whole; one group may be larger than an even share,
      and then has its shard to itself as far as the rest can be spread.
    * Groups of one size are told apart by their place in the written table;
      which of them goes where makes no difference to the loads.
    * Repeated rows are rows of a group, each with its slot. Null ids are kept.
    * An empty table gives no rows. Further columns are not read.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    rows = source_columns(df, id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    slim = rows.select("id", _text_key(F.col("text")).alias("key"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("crc"))
    slim = tagged(slim, "sizes")
    placed = join_counted(slim.drop("nr"), place_groups(slim, shards), ["key"], slim.count())
    placed = tagged(placed.select("id", "size", "crc", "shard"), "placed")
    discard(slim)
    return numbered(placed, ["shard"], "slot").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, shards: int, overhead: int = 16, text_col: str = "text", shard_col: str = "shard") -> None:
    """Write the rows of ``df``, all columns, as Parquet in a folder for each shard. Equal texts stand in one.

    Nulls, long texts, repeats and empty tables are treated as by
    :func:`assign_shards`. ``shard_col`` must not be a column of ``df``.
    """
    if shard_col in df.columns:
        raise ValueError(f"{shard_col} is a column already")
    text = F.col(f"`{text_col}`")
    body = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), _text_key(text).alias("key"))
    size = (F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(overhead)).cast("long").alias("size")
    slim = tagged(df.select(_text_key(text).alias("key"), size), "sizes")
    placed = join_counted(body, place_groups(slim, shards), ["key"], slim.count())
    out = placed.select(*(F.col("row").getField(c).alias(c) for c in df.columns), F.col("shard").alias(shard_col))
    out.write.partitionBy(shard_col).parquet(path)
