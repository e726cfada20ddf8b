"""Token ids in length-delimited binary records, with an offset index.

A shard is a row of records, each framed as

    length of data    unsigned 64-bit, little-endian
    masked CRC-32C of these 8 bytes
    data
    masked CRC-32C of the data

(the framing of TFRecord files). ``data`` is the serialized sequence: document
id (signed 64-bit), a flag byte (1: the document has an id), the width of an id
in bytes, and the ids, little-endian. Beside each shard lies an index file of
fixed-size entries (offset, length of data, ids before the record in its shard,
number of ids), so that a reader can take records in any order.

Executors write through ``pyarrow.fs`` below the shared folder. A file's name
holds the task's attempt, and only the names that a finished task reported go
into the manifest: files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import RowBuffer, arrow_schema, map_rows, materialize, shared_dir, sliced, source_columns, store, texts
from millrace.llm.tokenization import encoder, in_slices

_HEAD = "<qBB"
_HEAD_SIZE = struct.calcsize(_HEAD)
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("before", "<u8"), ("n_ids", "<u8")])
MANIFEST = "task int, part int, path string, records long, ids long, bytes long"
#: A task begins another shard after so many bytes; a reader's task takes about so many.
SHARD_BYTES = 256 << 20
RANGE_BYTES = 32 << 20
#: Index entries that a reader holds at a time.
INDEX_ROWS = 1 << 16
#: Bytes of the blocks whose checksums are computed side by side.
BLOCK = 512


# ---------------------------------------------------------------- checksums


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Eight CRC-32C tables for 8 bytes at a time, and four that move a checksum over BLOCK zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    tables = [table]
    for _ in range(7):
        tables.append(table[tables[-1] & 0xFF] ^ (tables[-1] >> 8))
    moves = []
    for k in range(4):
        crc = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(BLOCK):
            crc = table[crc & 0xFF] ^ (crc >> 8)
        moves.append(crc)
    return np.stack(tables), np.stack(moves)


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each record.

    Zero bytes in front don't change a checksum that starts at zero, so records
    are padded in front to whole blocks; all blocks are reduced side by side,
    and a record's blocks are then combined in order.
    """
    tables, moves = _tables()
    sizes = np.array([len(r) for r in records], np.int64)
    out = np.zeros(len(records), np.uint32)
    if not len(records):
        return out
    blocks = np.maximum(1, -(-sizes // BLOCK))
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    for r, end in zip(records, (ends * BLOCK).tolist(), strict=True):
        data[end - len(r) : end] = np.frombuffer(r, np.uint8)
    starts = ends * BLOCK - sizes
    for k in range(4):  # the usual start value: the first four bytes inverted
        data[starts[sizes > k] + k] ^= 0xFF
    words = data.view("<u4").reshape(-1, BLOCK // 4)
    crc = np.zeros(len(words), np.uint32)
    for k in range(0, BLOCK // 4, 2):
        low, high = crc ^ words[:, k], words[:, k + 1]
        crc = tables[7][low & 0xFF] ^ tables[6][(low >> 8) & 0xFF] ^ tables[5][(low >> 16) & 0xFF] ^ tables[4][low >> 24]
        crc ^= tables[3][high & 0xFF] ^ tables[2][(high >> 8) & 0xFF] ^ tables[1][(high >> 16) & 0xFF] ^ tables[0][high >> 24]
    firsts = ends - blocks
    order = np.argsort(-blocks, kind="stable")
    for k in range(int(blocks.max())):
        live = order[: int(np.searchsorted(-blocks[order], -k, side="left"))]
        moved = out[live]
        moved = moves[0][moved & 0xFF] ^ moves[1][(moved >> 8) & 0xFF] ^ moves[2][(moved >> 16) & 0xFF] ^ moves[3][moved >> 24]
        out[live] = moved ^ crc[firsts[live] + k]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes < 4).tolist():  # too short for the inverted start
        value = 0xFFFFFFFF
        for byte in records[i]:
            value = int(tables[0][(value ^ byte) & 0xFF]) ^ (value >> 8)
        out[i] = value ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that a checksum of data that holds checksums is sound."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


# ---------------------------------------------------------------- files


def frame(records: list[bytes]) -> bytes:
    """The records one after the other, framed."""
    heads = [struct.pack("<Q", len(r)) for r in records]
    a, b = masked(crc32c(heads)).astype("<u4"), masked(crc32c(records)).astype("<u4")
    return b"".join(x for i, r in enumerate(records) for x in (heads[i], a[i].tobytes(), r, b[i].tobytes()))


def unframe(data: bytes, entries: np.ndarray, base: int = 0) -> list[bytes]:
    """The data of the records at ``entries``; ValueError if a length or a checksum is wrong."""
    out, heads, sums = [], [], []
    for offset, length in zip(entries["offset"].tolist(), entries["length"].tolist(), strict=True):
        at = offset - base
        heads.append(data[at : at + 8])
        out.append(data[at + 12 : at + 12 + length])
        sums.append((data[at + 8 : at + 12], data[at + 12 + length : at + 16 + length]))
        if struct.unpack("<Q", heads[-1])[0] != length or len(out[-1]) != length:
            raise ValueError(f"record at {offset}: its length is not the index's")
    found = np.frombuffer(b"".join(a + b for a, b in sums), "<u4").reshape(-1, 2)
    if (masked(crc32c(heads)) != found[:, 0]).any() or (masked(crc32c(out)) != found[:, 1]).any():
        raise ValueError("a record's checksum is wrong")
    return out


class _Shard:
    """A shard that is being written, and its index beside it."""

    def __init__(self, path: str):
        self.path = path
        fs, place = store(path)
        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.data, self.index = fs.open_output_stream(place), fs.open_output_stream(f"{place}.index")
        self.records = self.ids = self.bytes = 0

    def add(self, records: list[bytes], width: int) -> None:
        sizes = np.array([len(r) for r in records], np.int64)
        n = (sizes - _HEAD_SIZE) // width
        entries = np.zeros(len(records), INDEX)
        entries["offset"] = self.bytes + np.append(0, np.cumsum(sizes + 16)[:-1])
        entries["length"], entries["n_ids"] = sizes, n
        entries["before"] = self.ids + np.append(0, np.cumsum(n)[:-1])
        self.data.write(frame(records))
        self.index.write(entries.tobytes())
        self.records, self.ids, self.bytes = self.records + len(records), self.ids + int(n.sum()), self.bytes + int((sizes + 16).sum())

    def close(self) -> None:
        self.data.close()
        self.index.close()


def write_records(
    df: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Tokenize every text and write its ids; returns the manifest, one row a shard.

    The shards, one after the other by ``task`` and ``part``, hold the documents
    in ascending order of id (null first; equal ids by a hash of the text, so
    that one id with very many rows is dealt over several shards). The manifest
    is itself stored in the shared folder, so that reading it writes nothing
    again. Without ``path`` the shards lie there too, and go with the session.

    * Null and empty texts: a record that holds the end id.
    * Very long texts: one record. Repeated rows: a record each.
    * An empty table: an empty manifest. Further columns are not read.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark, "records")
    rows = source_columns(df, id=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    schema = arrow_schema(spark, MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, context = encoder(tokenizer_path), TaskContext.get()
        end = np.array([end_id], model.dtype).tobytes()
        width, parts, shard, manifest = model.dtype.itemsize, 0, None, RowBuffer(schema)

        def close() -> None:
            shard.close()
            manifest.add((context.partitionId(), parts, shard.path, shard.records, shard.ids, shard.bytes))

        for batch in sliced(batches):
            docs, column = batch.column("id").to_pylist(), texts(batch.column("text"))
            for part in in_slices(column):
                if shard and shard.bytes >= shard_bytes:
                    close()
                    shard, parts = None, parts + 1
                shard = shard or _Shard(f"{path}/shard-{context.partitionId():06d}-{parts:04d}-{context.taskAttemptId()}.records")
                records = [
                    struct.pack(_HEAD, doc or 0, doc is not None, width) + ids + end
                    for doc, ids in zip(docs[part], model.encode(column[part]), strict=True)
                ]
                shard.add(records, width)
        if shard:
            close()
            yield manifest.take()

    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


def _entries(fs, name: str, low: int, high: int) -> Iterator[np.ndarray]:
    """Entries low..high-1 of a shard's index, a bounded number at a time."""
    with fs.open_input_file(f"{name}.index") as f:
        while low < high:
            n = min(INDEX_ROWS, high - low)
            f.seek(low * INDEX.itemsize)
            yield np.frombuffer(f.read(n * INDEX.itemsize), INDEX)
            low += n


def read_records(manifest: DataFrame, chunk_bytes: int = 8 << 20, with_ids: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Read the shards back: ``doc_id, start, n_tokens, ids_crc32`` and ``ids`` (32-bit little-endian), checked.

    ``start`` counts the ids of all documents before, over all shards. A task
    reads a range of a shard's records, which it finds by the index. What goes
    to the driver is one row a shard. Null ids come back as null, repeated rows
    each, an empty manifest gives no rows; damaged records raise ValueError.
    """
    spark = manifest.sparkSession
    ranges, total = [], 0
    for row in sorted(manifest.collect(), key=lambda r: (r.task, r.part)):
        pieces = max(1, min(row.records, -(-row.bytes // range_bytes)))
        edges = [row.records * k // pieces for k in range(pieces + 1)]
        ranges += [(row.path, total, a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]
        total += row.ids
    # one range a task
    dealt = spark.createDataFrame(ranges, "path string, start long, low long, high long").repartition(max(1, len(ranges)))

    def run(batch: pa.RecordBatch):
        for path, start, first, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, name = store(path)
            with fs.open_input_file(name) as f:
                for index in _entries(fs, name, first, end):
                    low = 0
                    while low < len(index):
                        base = int(index["offset"][low])
                        high = max(low + 1, int(np.searchsorted(index["offset"], base + chunk_bytes)))
                        part = index[low:high]
                        size = int(part["offset"][-1] + part["length"][-1]) + 16 - base
                        f.seek(base)
                        for entry, data in zip(part, unframe(f.read(size), part, base), strict=True):
                            doc, known, width = struct.unpack_from(_HEAD, data)
                            ids = np.frombuffer(data, f"<u{width}", offset=_HEAD_SIZE).astype("<u4").tobytes()
                            row = (doc if known else None, start + int(entry["before"]), int(entry["n_ids"]), zlib.crc32(ids))
                            yield (*row, ids) if with_ids else row, 32 + len(ids) * with_ids
                        low = high

    return map_rows(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_at(path: str, positions: list[int]) -> list[np.ndarray]:
    """The ids of single records of a shard, by their position: a shuffled read, of the index as well.

    A position that the shard doesn't have raises IndexError.
    """
    fs, name = store(path)
    out = []
    with fs.open_input_file(name) as f, fs.open_input_file(f"{name}.index") as index:
        n = index.size() // INDEX.itemsize
        for k in positions:
            if not 0 <= k < n:
                raise IndexError(f"no record {k}")
            index.seek(k * INDEX.itemsize)
            part = np.frombuffer(index.read(INDEX.itemsize), INDEX)
            f.seek(int(part["offset"][0]))
            data = unframe(f.read(int(part["length"][0]) + 16), part, int(part["offset"][0]))[0]
            out.append(np.frombuffer(data, f"<u{struct.unpack_from(_HEAD, data)[2]}", offset=_HEAD_SIZE).astype("<u4"))
    return out


def round_trip(
    spark: SparkSession,
    df: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents, read them back: ``doc_id, start, n_tokens, ids_crc32``.

    * Null and empty texts: a record that holds the end id.
    * Null ids: kept as null, first in order. Repeated rows: a record each.
    * Very long texts: one record. An empty table: no rows.
    * Further columns are not read.
    """
    del spark
    return read_records(write_records(df, tokenizer_path, end_id, id_col, text_col), with_ids=False)
