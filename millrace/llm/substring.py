"""Substring dedup: remove words in windows that repeat anywhere in the corpus.

A window is ``window`` consecutive words of one document.

1. *Sketch.* Every window has an anchor, the run of ``gram`` words in it whose
   hash is smallest. Equal windows have equal anchors in equal places, so an
   anchor occurs at least as often as any window that it stands for: counting
   anchors overestimates windows, and there are far fewer of them. Each
   partition makes a count-min sketch of its anchors, sparse and saturated at
   two; the sketches are merged block by block.
2. *Exact count.* Windows whose anchor is estimated to occur twice or more go
   to an exact count by a 128-bit hash. A window that occurs twice has an
   anchor that occurs twice, and count-min never underestimates: none is lost.
   What is kept of the count is the other kind, the windows that turn out to be
   unique, with their places.
3. *Cut.* Documents without a candidate window are done as they are. The others
   are joined with the places of their unique windows, and every word that
   another candidate window covers is removed.

The width of the sketch follows the size of the corpus, five cells for an
anchor, so the share of unique windows that it lets through stays the same. Up
to ``max_cells`` every worker reads it whole. Beyond, it is cut into slices of
that many cells by a hash of the anchor, and no worker needs more than one: the
texts are written with the number of their partition, each partition sends its
distinct anchors to the tasks of their slices, and gets back, as a table, those
that are estimated repeated. The result is the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import (
    RowBuffer,
    arrow_schema,
    frees_between_queries,
    left_join_few,
    map_rows,
    mapped,
    materialize,
    shared_dir,
    sliced,
    source_columns,
    store,
    text_bytes,
)

WINDOW = 35
GRAM = 18
DEPTH = 2
#: Cells of a sketch row that a worker reads at most: bits once merged, so 2**30 of them are 256 MB with two rows.
MAX_CELLS = 1 << 30
MIN_CELLS = 1 << 20
#: Cells of a block, the unit in which sketches are merged.
BLOCK_CELLS = 1 << 16
#: Bytes whose words are hashed together.
SEGMENT_BYTES = 1 << 18

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2**64
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\r\x0b\x0c")] = True


@lru_cache(maxsize=8)
def _powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2**64."""
    ups, downs = np.empty(n, np.uint64), np.empty(n, np.uint64)
    inverse = pow(multiplier, -1, 1 << 64)
    for out, factor in ((ups, multiplier), (downs, inverse)):
        out[0] = 1
        filled = 1
        while filled < n:
            more = min(filled, n - filled)
            out[filled : filled + more] = out[:more] * np.uint64(pow(factor, filled, 1 << 64))
            filled += more
    return ups, downs


def _rolling(words: np.ndarray, k: int, multiplier: int) -> np.ndarray:
    """A hash of each run of k words: a polynomial in the multiplier, modulo 2**64."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    size = 1 << max(12, int(n).bit_length())
    ups, downs = _powers(multiplier, size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * ups[:n], out=sums[1:])
    return (sums[k:] - sums[:-k]) * downs[: n - k + 1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def _segments(data: bytes) -> Iterator[tuple[int, int]]:
    """Parts of a text of about SEGMENT_BYTES, cut where a word ends."""
    low = 0
    while low < len(data):
        high = low + SEGMENT_BYTES
        if high < len(data):
            cut = _SPACE.search(data, high)
            high = cut.start() if cut else len(data)
        yield low, min(high, len(data))
        low = high


#: Words of more bytes are hashed one by one, by xxh3.
LONG_WORD = 16
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Start and odd factor of the two lanes of word hashes.
_LANES = ((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25), (0x6A09E667F3BCC908, 0xD6E8FEB86659FD93))


def _hash_short(data: bytes, starts: np.ndarray, lengths: np.ndarray, lane: int) -> np.ndarray:
    """A 64-bit hash of each word of up to 16 bytes, from its length and its bytes taken eight at a time.

    Each step is one to one in what it takes, and that is mixed into all bits
    before the next: words of one length and up to eight bytes never share a
    hash, others do by chance only.
    """
    start, factor = (np.uint64(x) for x in _LANES[lane])
    eights = np.ndarray((len(data) - 15,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    out = _mix((lengths.astype(np.uint64) ^ start) * factor)
    out = _mix((out ^ (eights[starts] & _LOW_BYTES[np.minimum(lengths, 8)])) * factor)
    more = np.flatnonzero(lengths > 8)
    if len(more):
        rest = eights[starts[more] + 8] & _LOW_BYTES[np.minimum(lengths[more] - 8, 8)]
        out[more] = _mix((out[more] ^ rest) * factor)
    return out


def hash_words(data: bytes, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a text: runs of anything but ASCII white space.

    The two lanes are hashes that don't depend on each other. No hash depends on where
    a text is cut into segments, as they end where words do.
    """
    import xxhash

    parts = []
    for low, high in _segments(data):
        segment = data[low:high] + bytes(16)
        text = np.frombuffer(segment, np.uint8, high - low)
        edges = np.flatnonzero(np.diff(_IS_SPACE[text], prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        hashes = _hash_short(segment, starts, ends - starts, lane)
        for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            digest = xxhash.xxh3_128_intdigest(segment[starts[k] : ends[k]])
            hashes[k] = digest >> 64 * lane & 0xFFFFFFFFFFFFFFFF
        parts.append((hashes, starts + low, ends + low))
    if not parts:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Mixed hashes of all grams, and for each window the place of its anchor (the first smallest)."""
    grams = _mix(_rolling(hashes, gram, _MULTIPLIERS[0]))
    span = window - gram + 1
    if len(grams) < span:
        return grams, np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    places = np.empty(len(views), np.int64)
    for low in range(0, len(views), 1 << 16):  # a copy of the views for a part at a time
        part = views[low : low + (1 << 16)]
        places[low : low + len(part)] = part.argmin(axis=1)
    return grams, places + np.arange(len(views))


def window_hashes(data: bytes, hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window, from two hashes of each word."""
    others = hash_words(data, 1)[0]
    return tuple(_mix(_rolling(h, window, m)).view(np.int64) for h, m in zip((hashes, others), _MULTIPLIERS[:2], strict=True))


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """The slice, of a power of two, that a key belongs to."""
    return _mix(keys ^ np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(slices - 1)


def cells_of(keys: np.ndarray, cells: int, row: int) -> np.ndarray:
    """The cell of each key in a row of its slice of the sketch."""
    h = _mix(keys + np.uint64(0xA0761D6478BD642F * (row + 1) & 0xFFFFFFFFFFFFFFFF))
    return h & np.uint64(cells - 1)


# ---------------------------------------------------------------- the sketch


def sketch_size(n_bytes: int, max_cells: int = MAX_CELLS) -> tuple[int, int]:
    """Cells of a row in a slice, and slices, for so many bytes of text; both powers of two.

    Prose has about six bytes a word and an anchor for ten words: one cell for
    twelve bytes is about five for an anchor.
    """
    cells = max(MIN_CELLS, 1 << (max(1, int(n_bytes) // 12) - 1).bit_length())
    return min(cells, max_cells), max(1, cells // max_cells)


def partition_sketch(keys: np.ndarray, counts: np.ndarray, cells: int, slices: int = 1) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Blocks (row, block, cells counted once, cells counted twice or more) of the sketch of some keys."""
    for row in range(DEPTH):
        spots = cells_of(keys, cells, row) + slice_of(keys, slices) * np.uint64(cells)
        at = np.sort(np.repeat(spots, np.minimum(counts, 2)))
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
        times = np.diff(np.append(first, len(at)))
        at = at[first]
        block = (at // np.uint64(BLOCK_CELLS)).astype(np.int64)
        inner = (at % np.uint64(BLOCK_CELLS)).astype("<u2")
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(at) else []
        for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
            once = times[a:b] == 1
            yield row, int(block[a]), inner[a:b][once].tobytes(), inner[a:b][~once].tobytes()


def anchor_runs(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: the anchor's key, the first window, the number of windows."""
    grams, places = anchors(hashes, window, gram)
    if not len(places):
        return np.empty(0, np.uint64), places, places
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    return grams[places[first]], first, np.diff(np.append(first, len(places)))


def build_sketch(docs: DataFrame, cells: int, slices: int, window: int, gram: int) -> str:
    """Sketch the anchors of all texts; returns the path of the merged blocks (Parquet, a folder for each slice)."""
    spark = docs.sparkSession
    ddl = "row int, block long, once binary, more binary"
    schema = arrow_schema(spark, ddl)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in sliced(batches):
            for data in text_bytes(batch.column("text")):
                keys = anchor_runs(hash_words(data)[0], window, gram)[0]
                if len(keys):
                    found.append(keys)
        if not found:
            return
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        buffer = RowBuffer(schema)
        for row in partition_sketch(keys, counts, cells, slices):
            buffer.add(row, len(row[2]) + len(row[3]) + 16)
            if buffer.full:
                yield buffer.take()
        if buffer.rows:
            yield buffer.take()

    per_slice = max(1, cells // BLOCK_CELLS)

    def merge(key, table):
        count = np.zeros(BLOCK_CELLS, np.int32)
        for once, more in zip(table["once"].to_pylist(), table["more"].to_pylist(), strict=True):
            np.add.at(count, np.frombuffer(once, "<u2"), 1)
            count[np.frombuffer(more, "<u2")] += 2
        bits = np.packbits(count >= 2, bitorder="little").tobytes()
        row, block = key[0].as_py(), key[1].as_py()
        return pa.table(
            {
                "slice": pa.array([block // per_slice], pa.int32()),
                "row": pa.array([row], pa.int32()),
                "block": pa.array([block % per_slice], pa.int32()),
                "bits": [bits],
            }
        )

    path = shared_dir(spark, "sketch")
    blocks = mapped(docs.select("text"), partial, ddl)
    # at most one row a partition and block comes together, of bounded size
    merged = blocks.groupBy("row", "block").applyInArrow(merge, "slice int, row int, block int, bits binary")
    if slices > 1:
        merged = merged.repartition("slice")
    merged.write.partitionBy("slice").parquet(path)
    return path


def _parquet_batches(path: str) -> Iterator[pa.RecordBatch]:
    """The batches below a path of the shared folder; none where there is nothing."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileType

    fs, folder = store(path)
    if fs.get_file_info(folder).type == FileType.Directory:
        yield from ds.dataset(folder, filesystem=fs, format="parquet").to_batches()


@lru_cache(maxsize=1)
def _load_sketch(path: str, cells: int, piece: int = 0) -> np.ndarray:
    """The bits "counted twice or more" of all rows of a slice; kept by a worker process while it needs that slice."""
    bits = np.zeros((DEPTH, cells // 8), np.uint8)
    for batch in _parquet_batches(f"{path}/slice={piece}"):
        for row, block, part in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "bits")), strict=True):
            at = block * (BLOCK_CELLS // 8)
            bits[row, at : at + BLOCK_CELLS // 8] = np.frombuffer(part, np.uint8)
    return bits


@lru_cache(maxsize=2)
def _load_keys(path: str, part: int) -> np.ndarray:
    """The anchors of a partition of the texts that are estimated repeated, sorted."""
    found = [batch.column("key").to_numpy() for batch in _parquet_batches(f"{path}/part={part}")]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _forget() -> None:
    _load_sketch.cache_clear()
    _load_keys.cache_clear()


frees_between_queries(_forget)


def estimated_repeated(keys: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    """Whether the estimate, the least over the rows, is two or more."""
    out = np.ones(len(keys), bool)
    for row in range(DEPTH):
        at = cells_of(keys, cells, row)
        out &= (bits[row][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _held(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys a table, sorted as signed numbers, has."""
    if not len(table):
        return np.zeros(len(keys), bool)
    keys = keys.view(np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


def route_anchors(docs: DataFrame, sketch: str, cells: int, slices: int, window: int, gram: int) -> str:
    """Send the distinct anchors of each partition (column ``part``) to their slices; returns the path of those estimated repeated."""
    spark = docs.sparkSession
    ddl = "slice int, part int, key long"
    schema = arrow_schema(spark, ddl)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, found in waiting.items():
                keys = np.unique(np.concatenate(found))
                columns = [slice_of(keys, slices).astype(np.int32), np.full(len(keys), part, np.int32), keys.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        for batch in sliced(batches):
            for part, data in zip(batch.column("part").to_pylist(), text_bytes(batch.column("text")), strict=True):
                keys = anchor_runs(hash_words(data)[0], window, gram)[0]
                waiting.setdefault(part, []).append(keys)
                size += len(keys)
            if size >= 1_000_000:
                yield from flush()
                waiting.clear()
                size = 0
        if waiting:
            yield from flush()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slice").to_numpy()
            keys = batch.column("key").to_numpy().view(np.uint64)
            keep = np.zeros(len(at), bool)
            for piece in np.unique(at).tolist():  # sorted, so that a slice is read once
                own = np.flatnonzero(at == piece)
                keep[own] = estimated_repeated(keys[own], _load_sketch(sketch, cells, piece), cells)
            yield batch.select(["part", "key"]).filter(pa.array(keep))

    sent = mapped(docs.select("part", "text"), send, ddl).repartition("slice").sortWithinPartitions("slice")
    path = shared_dir(spark, "anchors")
    mapped(sent, look, "part int, key long").repartition("part").write.partitionBy("part").parquet(path)
    return path


def candidates(hashes: np.ndarray, repeated: Callable[[np.ndarray], np.ndarray], window: int, gram: int) -> np.ndarray:
    """Starts of the windows whose anchor is estimated to be repeated."""
    keys, first, n = anchor_runs(hashes, window, gram)
    if not len(keys):
        return first
    return np.flatnonzero(np.repeat(repeated(keys), n))


# ---------------------------------------------------------------- Spark


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows cover."""
    edges = np.zeros(n_words + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + window, n_words), -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeated(
    df: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    max_cells: int = MAX_CELLS,
    id_col: str = "doc_id",
    text_col: str = "text",
    kept: str = "text",
) -> DataFrame:
    """``doc_id, tie, n_words, n_removed, kept``: the words of each text without repeated windows.

    ``kept`` has the words that stay, joined by one blank; ``tie`` is a hash of
    the text that tells rows of one id apart. With ``kept="digest"`` the column has
    the SHA-256 of these words instead, with ``kept="changed"`` it is null where
    nothing is removed; then only texts with a candidate window are shuffled.

    * Null and empty texts, and those shorter than a window: nothing is removed.
    * Very long texts are judged whole. Null ids are kept.
    * Repeated rows: each is a document of its own, so their windows repeat.
    * An empty table gives no rows. Further columns are not read.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram is a part of the window")
    spark = df.sparkSession
    docs = source_columns(df, id=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, slices = sketch_size(n_bytes, max_cells)
    docs = docs.withColumn("part", F.spark_partition_id() if slices > 1 else F.lit(0))
    if slices > 1:
        docs = materialize(docs, "parts")  # the rows of a partition stand together and keep its number
    sketch = build_sketch(docs, cells, slices, window, gram)
    routed = route_anchors(docs, sketch, cells, slices, window, gram) if slices > 1 else ""

    def windows_of(hashes: np.ndarray, part: int) -> np.ndarray:
        if routed:
            return candidates(hashes, lambda keys: _held(keys, _load_keys(routed, part)), window, gram)
        return candidates(hashes, lambda keys: estimated_repeated(keys, _load_sketch(sketch, cells), cells), window, gram)

    ddl = "h1 long, h2 long, n int, id long, tie long, start int"
    schema = arrow_schema(spark, ddl)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order] for c in columns]
            edge = np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
            first = np.flatnonzero(edge)
            times = np.minimum(np.diff(np.append(first, len(edge))), 2).astype(np.int32)
            h1, h2, ids, null, ties, starts = (c[first] for c in columns)
            for low in range(0, len(first), 200_000):
                s = slice(low, low + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[s]),
                        pa.array(h2[s]),
                        pa.array(times[s]),
                        pa.array(ids[s], mask=null[s]),
                        pa.array(ties[s]),
                        pa.array(starts[s]),
                    ],
                    schema=schema,
                )

        for batch in sliced(batches):
            columns = (batch.column(c).to_pylist() for c in ("id", "tie", "part"))
            for doc, tie, part, data in zip(*columns, text_bytes(batch.column("text")), strict=True):
                hashes = hash_words(data)[0]
                starts = windows_of(hashes, part)
                if not len(starts):
                    continue
                h1, h2 = window_hashes(data, hashes, window)
                n = len(starts)
                parts.append(
                    (h1[starts], h2[starts], np.full(n, doc or 0), np.full(n, doc is None), np.full(n, tie), starts.astype(np.int32))
                )
                waiting += n
                if waiting >= 1_000_000:
                    yield from flush()
                    parts, waiting = [], 0
        if parts:
            yield from flush()

    # a window that many documents share is summed before and after the shuffle
    unique = (
        mapped(docs, emit, ddl)
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("n"), F.first("id").alias("id"), F.first("tie").alias("tie"), F.first("start").alias("start"))
        .filter("n = 1")
    )
    # bounded by the windows of one document
    places = unique.groupBy("id", "tie").agg(F.sort_array(F.collect_list("start")).alias("unique_starts"))
    places = places.select(F.col("id").alias("p_id"), F.col("tie").alias("p_tie"), "unique_starts")

    def shown(words: list[bytes], changed: bool) -> str | None:
        if kept == "changed" and not changed:
            return None
        joined = b" ".join(words)
        return hashlib.sha256(joined).hexdigest() if kept == "digest" else joined.decode()

    def split(batch: pa.RecordBatch):
        columns = (batch.column(c).to_pylist() for c in ("id", "tie", "part"))
        for doc, tie, part, data in zip(*columns, text_bytes(batch.column("text")), strict=True):
            hashes = hash_words(data)[0]
            starts = windows_of(hashes, part)
            if len(starts):
                edge = np.flatnonzero(np.append(True, np.diff(starts) > 1))
                runs = np.stack([starts[edge], np.diff(np.append(edge, len(starts)))]).astype("<i4").tobytes()
                yield (doc, tie, len(hashes), runs, data.decode()), len(data) + len(runs) + 32
            else:
                yield (doc, tie, len(hashes), None, shown(data.split(), False)), 128 if kept != "text" else len(data) + 32

    def cut(batch: pa.RecordBatch):
        columns = (batch.column(c).to_pylist() for c in ("id", "tie", "n", "runs", "unique_starts", "text"))
        for doc, tie, n, runs, unique_starts, text in zip(*columns, strict=True):
            removed = 0
            if runs:
                first, times = np.frombuffer(runs, "<i4").astype(np.int64).reshape(2, -1)
                starts = np.repeat(first - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(int(times.sum()))
                if unique_starts:
                    starts = np.setdiff1d(starts, np.array(unique_starts, np.int64), assume_unique=True)
                gone = covered(n, starts, window)
                removed = int(gone.sum())
                text = shown(list(compress(text.encode().split(), (~gone).tolist())), removed > 0)
            yield (doc, tie, n, removed, text), len(text or "") + 32

    rows = map_rows(docs, split, "id long, tie long, n long, runs binary, text string")
    joined = rows.join(places, rows["id"].eqNullSafe(places["p_id"]) & rows["tie"].eqNullSafe(places["p_tie"]), "left")
    joined = joined.select("id", "tie", "n", "runs", "text", "unique_starts")
    return map_rows(joined, cut, f"{id_col} long, tie long, n_words long, n_removed long, kept string")


def removal_digests(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of :func:`remove_repeated`, which says what becomes of nulls and the like."""
    out = remove_repeated(df, window, id_col=id_col, kept="digest", **options)
    return out.select(F.col(f"`{id_col}`"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def without_repeats(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The rows of ``df`` with the words of repeated windows removed from their texts.

    Texts that lose nothing stay as they are, white space included, and aren't
    shuffled; the others have the words that stay, joined by one blank, and
    ``chars_col``, if it is there, follows the new length. No row is dropped;
    rows alike in id and text get equal texts. Null and empty texts stay, null
    ids are kept, an empty table gives no rows.
    """
    removed = remove_repeated(df, window, id_col=id_col, text_col=text_col, kept="changed", **options)
    removed = removed.filter("n_removed > 0")
    # rows alike in id and text lose the same words
    removed = removed.groupBy(F.col(f"`{id_col}`").alias("r_id"), F.col("tie").alias("r_tie")).agg(F.first("kept").alias("r_kept"))
    removed = materialize(removed, "removed")
    columns = df.columns
    body = df.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"),
        F.col(f"`{id_col}`").alias("b_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("b_tie"),
    )
    joined = left_join_few(body, removed, [("b_id", "r_id"), ("b_tie", "r_tie")], "b_tie", "r_tie")
    new = {text_col: F.col("r_kept"), chars_col: F.length("r_kept").cast("long")}
    out = []
    for c in columns:
        old = F.col("row").getField(c)
        out.append((F.when(F.col("r_kept").isNotNull(), new[c]).otherwise(old) if c in new else old).alias(c))
    return joined.select(*out)
