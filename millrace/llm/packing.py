"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

The packing is planned on the histogram of piece lengths, not on the pieces: a
sequence holds ``capacity`` tokens, so there are at most ``capacity`` different
lengths, however many documents there are. The planner sees that histogram
only, and so packs the whole corpus at once instead of shard by shard:

1. *Dominance reduction* (Martello and Toth 1990). Take a length ``s``, longest
   first. If some set of at most three pieces with ``s`` in it can replace any
   other set that a sequence with ``s`` might hold, without making the rest
   worse off, it is fixed for good. Every condition used stays true while
   pieces are removed, so it is applied to all pieces of those lengths in one
   step.
2. *Best fit decreasing* on what remains, again a whole length at a time.

The plan is a list of sequence groups, whose number is bounded by the capacity.
Pieces learn their place from their rank among the pieces of equal length: the
rank is counted within salted slices of a length, so that a length that a third
of all documents share is still dealt over many tasks. A length has at most
MAX_SLICES of them, which grow with the corpus; so what is summed over slices is
bounded.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import map_rows, materialize, source_columns, texts
from millrace.llm.tokenization import encoder, in_slices

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Pieces that one salted slice of a length holds on average, if the length has more, until it has MAX_SLICES.
SLICE_ROWS = 64
MAX_SLICES = 16_384


# ---------------------------------------------------------------- the plan


@dataclass
class Group:
    """``bins`` alike sequences; each holds ``(length, count)`` for every entry, in that order."""

    bins: int
    room: int
    entries: list[tuple[int, int]] = field(default_factory=list)


def _apply(counts: np.ndarray, lengths: list[int]) -> int:
    """Take the set ``lengths`` out as often as it is there; returns how often."""
    need: dict[int, int] = {}
    for s in lengths:
        need[s] = need.get(s, 0) + 1
    times = min(int(counts[s]) // k for s, k in need.items())
    for s, k in need.items():
        counts[s] -= times * k
    return times


def _largest_fitting(counts: np.ndarray, room: int) -> int:
    """The largest length of at most ``room`` that is there, else 0."""
    there = np.flatnonzero(counts[1 : room + 1])
    return int(there[-1]) + 1 if len(there) else 0


def _smallest(counts: np.ndarray, k: int) -> list[int]:
    """The k smallest pieces, or all if there are fewer."""
    out: list[int] = []
    for s in np.flatnonzero(counts)[:k]:
        out += [int(s)] * min(k - len(out), int(counts[s]))
        if len(out) == k:
            break
    return out


def _best_pair(counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """Lengths a >= b of two pieces with the largest sum of at most ``room``; of those the largest a."""
    there = np.flatnonzero(counts[: room + 1])
    best: tuple[int, int, int] | None = None
    for a in there[::-1].tolist():
        k = bisect_left(there, min(a, room - a) + 1) - 1
        if k >= 0 and there[k] == a and counts[a] < 2:
            k -= 1
        if k >= 0 and (best is None or a + int(there[k]) > best[0]):
            best = (a + int(there[k]), a, int(there[k]))
    return best and best[1:]


def _dominating(counts: np.ndarray, s: int, capacity: int) -> list[int] | None:
    """A set with a piece of length s that dominates all others with it, if one is found."""
    counts[s] -= 1  # the piece itself
    try:
        room = capacity - s
        least = _smallest(counts, 3)
        if not least or least[0] > room:
            return [s]
        top = _largest_fitting(counts, room)
        if top == room or len(least) < 2 or least[0] + least[1] > room:
            return [s, top]
        if len(least) == 3 and sum(least) <= room:
            return None  # four pieces may share a sequence: no set of three dominates
        pair = _best_pair(counts, room)
        if pair is None or top >= sum(pair):
            return [s, top]
        a, b = pair
        if a != top:
            return None
        # pieces strictly between a and b: two of them together would escape the comparison
        between = counts.copy()
        between[: b + 1] = 0
        between[a:] = 0
        inner = _smallest(between, 2)
        return [s, a, b] if len(inner) < 2 or sum(inner) > room else None
    finally:
        counts[s] += 1


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[Group]:
    """Fix dominating sets and take them out of ``counts``, until none is found."""
    groups: list[Group] = []
    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while counts[s] and (chosen := _dominating(counts, s, capacity)):
                times = _apply(counts, chosen)
                if not times:  # two pieces of one length were needed, and one is left
                    break
                entries = [(k, chosen.count(k)) for k in dict.fromkeys(chosen)]
                groups.append(Group(times, capacity - sum(chosen), entries))
                changed = True
    return groups


def best_fit(counts: np.ndarray, capacity: int) -> list[Group]:
    """Best fit decreasing, for whole lengths at a time; ``counts`` is used up."""
    by_room: dict[int, list[Group]] = {}
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        for room in sorted(r for r in by_room if r >= s):
            if not left:
                break
            fit = room // s
            for group in by_room.pop(room):
                full = min(group.bins, left // fit)
                rest = left - full * fit if full < group.bins else 0
                parts = [(full, fit), (1 if rest else 0, rest), (group.bins - full - (1 if rest else 0), 0)]
                for bins, k in parts:
                    if bins:
                        entries = [*group.entries, (s, k)] if k else group.entries
                        by_room.setdefault(room - k * s, []).append(Group(bins, room - k * s, list(entries)))
                left -= full * fit + rest
        fit = capacity // s
        full, rest = divmod(left, fit)
        for bins, k in ((full, fit), (1 if rest else 0, rest)):
            if bins:
                by_room.setdefault(capacity - k * s, []).append(Group(bins, capacity - k * s, [(s, k)]))
        counts[s] = 0
    return [g for groups in by_room.values() for g in groups]


def plan_packing(counts: np.ndarray, capacity: int) -> list[Group]:
    """Sequence groups that hold every piece of the histogram ``counts[length]`` once."""
    counts = np.array(counts, np.int64)
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


def placements(groups: list[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end of ranks, first sequence, pieces a sequence, base offset)."""
    rows, used, sequence = [], {}, 0
    for g in groups:
        base = 0
        for length, k in g.entries:
            low = used.get(length, 0)
            used[length] = low + g.bins * k
            rows.append((length, low, used[length], sequence, k, base))
            base += length * k
        sequence += g.bins
    return rows


# ---------------------------------------------------------------- Spark


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, and before them what is over."""
    first = length % capacity
    starts = ([0] if first else []) + list(range(first, length, capacity))
    return [(a, (first if a == 0 and first else capacity)) for a in starts]


def token_pieces(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenize each text, append ``end_id``, and cut what is longer than ``capacity``.

    Null text counts as empty (one piece that holds the end id). ``with_ids``
    adds the ids of the piece as little-endian unsigned 32-bit integers.
    """

    def run(batch: pa.RecordBatch):
        model = encoder(tokenizer_path)
        end = np.array([end_id], "<u4")
        docs, column = batch.column("id").to_pylist(), texts(batch.column("text"))
        for part in in_slices(column):
            for doc, raw in zip(docs[part], model.encode(column[part]), strict=True):
                ids = np.append(np.frombuffer(raw, model.dtype).astype("<u4"), end)
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    row = (doc, piece, start, length, zlib.crc32(data))
                    yield (*row, data) if with_ids else row, 48 + len(data) * with_ids

    return map_rows(source_columns(df, id=id_col, text=text_col), run, PIECES + ", ids binary" * with_ids)


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, start, length, ids_crc32``.

    Every row is placed; rows alike in these columns take different places. The
    lengths are from 1 to ``capacity``. Nulls in the other columns, and further
    columns, whatever their names, are carried along; only ``sequence_id`` and
    ``offset`` must not be there yet. An empty table gives an empty result.
    """
    if {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError("the pieces have places already")
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    # at most one row for each length up to the capacity
    totals = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in totals:
        counts[row.length] = row.n
    spots = placements(plan_packing(counts, capacity))
    spot = spark.createDataFrame(spots, "spot_length int, low long, high long, sequence long, fit long, base long")
    slices = [(r.length, min(MAX_SLICES, 1 + r.n // SLICE_ROWS)) for r in totals]
    slices = spark.createDataFrame(slices, "slice_length int, slices long")
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    order = F.struct(*keys).alias("order")
    rows = pieces.select(F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("row"), "length", order, F.xxhash64(*keys).alias("mark"))
    salted = rows.join(F.broadcast(slices), F.col("length") == F.col("slice_length"))  # a row for each length
    salted = salted.select("row", "length", "order", F.pmod("mark", F.col("slices")).alias("salt"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    lower = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # MAX_SLICES rows at most
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"))
    in_slice = Window.partitionBy("length", "salt").orderBy("order")
    ranked = (
        salted.withColumn("rank", F.row_number().over(in_slice))
        .join(before, ["length", "salt"])
        .withColumn("place", F.col("before") + F.col("rank") - 1)
    )
    near = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    joined = ranked.join(F.broadcast(spot), (F.col("length") == F.col("spot_length")) & near)  # bounded by capacity
    step = F.col("place") - F.col("low")
    return joined.select(
        *(F.col("row").getField(c).alias(c) for c in pieces.columns),
        (F.col("sequence") + F.floor(step / F.col("fit"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(step, F.col("fit")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document, with its place in a packed sequence.

    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    * Null and empty texts: one piece of one token, the end id.
    * Very long texts: cut into pieces of ``capacity`` tokens, the first may be shorter.
    * Repeated rows: each is packed. Ties between pieces of equal length are
      broken by id, piece and checksum.
    * Null ids are kept. An empty table gives no rows. Other columns are not read.
    """
    packed = pack_pieces(token_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col), capacity)
    return packed.withColumn("length", F.col("length").cast("long"))


def sequences(pieces: DataFrame, packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (32-bit little-endian), ``n_tokens``.

    ``pieces`` holds ``ids`` (see :func:`token_pieces`), ``packed`` the places.
    A sequence has at most ``capacity`` pieces, so a group is bounded. Null ids
    match, rows alike take one place each, pieces without a place and an empty
    table give nothing.
    """
    del capacity
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    order = Window.partitionBy(*keys).orderBy(F.lit(1))
    places = packed.withColumn("length", F.col("length").cast("int")).withColumn("copy", F.row_number().over(order))
    data = pieces.withColumn("copy", F.row_number().over(order))
    on = [places[k].eqNullSafe(data[k]) for k in [*keys, "copy"]]
    rows = places.join(data, on).select("sequence_id", "offset", places["length"], "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens")).select(
        "sequence_id",
        "n_tokens",
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"),
    )
