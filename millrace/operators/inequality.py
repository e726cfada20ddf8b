"""Joins on two inequalities, by sorted orders and bit arrays (IEJoin, Khayyat et al. 2015).

Each side is range-partitioned by its first attribute and cut into blocks that
are narrow in both. Blocks whose bounds can't satisfy both inequalities never
meet. Where two meet, the left rows have a place in the order of the first
attribute; as the right rows are gone through in the order of the second, those
left rows that satisfy it are marked in a bit array at these places, and the
marked ones on the right side of a cut are the matches. No pair is made that
isn't a result, and no nested loop is planned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.times import local_micros
from millrace.storage import written

#: Rows of a block at least, and blocks of a side at most (a further doubling of the rows doubles the blocks' rows).
BLOCK_ROWS, MAX_BLOCKS = 16_384, 16_384
#: Tasks that pairs of blocks are dealt over at most.
MAX_TASKS = 8192
#: Blocks into which rows that are neighbours by the first attribute are cut by the second.
SLICES = 8
_OPS = ("<", "<=", ">", ">=")
_WHOLE = ("byte", "short", "integer", "long", "date", "timestamp", "timestamp_ntz")


def _number(df: DataFrame, column: str, whole: bool) -> Column:
    """A value that sorts as the column does: microseconds, days or whole numbers as longs, else a double."""
    kind, value = df.schema[column].dataType.typeName(), F.col(column)
    if kind == "timestamp_ntz":
        value = local_micros(value)
    elif kind == "timestamp":
        value = F.unix_micros(value)
    elif kind == "date":
        value = F.unix_date(value)
    return value.cast("long" if whole else "double")


def _is_whole(left: DataFrame, right: DataFrame, a: str, b: str) -> bool:
    kinds = [f.schema[c].dataType.typeName() for f, c in ((left, a), (right, b))]
    times = ("date", "timestamp", "timestamp_ntz")
    if any(k in times for k in kinds) and kinds[0] != kinds[1]:
        raise ValueError(f"{a} and {b} are of different kinds")
    return all(k in _WHOLE for k in kinds)


def _ranges(ordered: np.ndarray, values: np.ndarray, op: str) -> tuple[np.ndarray, np.ndarray]:
    """For each value v the places of ``ordered`` whose entries e satisfy ``e op v``: from, to. NaN is the largest."""
    n = len(ordered)
    cut = np.searchsorted(ordered, values, side="left" if op in ("<", ">=") else "right")
    return (np.zeros(len(values), np.int64), cut) if op in ("<", "<=") else (cut, np.full(len(values), n))


def matches(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, op_x: str, op_y: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left, right) of places with ``lx op_x rx`` and ``ly op_y ry``, a part at a time."""
    by_x, by_y = np.argsort(lx, kind="stable"), np.argsort(ly, kind="stable")
    place = np.empty(len(lx), np.int64)
    place[by_x] = np.arange(len(lx))
    permuted = place[by_y]  # place by x of the left rows, in their order by y
    low, high = _ranges(lx[by_x], rx, op_x)
    y_low, y_high = _ranges(ly[by_y], ry, op_y)
    live = np.flatnonzero((low < high) & (y_low < y_high))
    rising = op_y in ("<", "<=")
    live = live[np.argsort(y_high[live] if rising else -y_low[live], kind="stable")]
    marked, done = np.zeros(len(lx), bool), 0
    found_l, found_r, size = [], [], 0
    for r in live.tolist():
        upto = y_high[r] if rising else len(lx) - y_low[r]
        if upto > done:
            marked[permuted[done:upto] if rising else permuted[len(lx) - upto : len(lx) - done]] = True
            done = upto
        hits = np.flatnonzero(marked[low[r] : high[r]])
        if len(hits):
            found_l.append(by_x[hits + low[r]])
            found_r.append(np.full(len(hits), r))
            size += len(hits)
            if size >= 100_000:
                yield np.concatenate(found_l), np.concatenate(found_r)
                found_l, found_r, size = [], [], 0
    if size:
        yield np.concatenate(found_l), np.concatenate(found_r)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _blocks(df: DataFrame, x: Column, y: Column, columns: list[str], side: str, block_rows: int) -> DataFrame:
    """Blocks of the rows that have both attributes: number, bounds, and the rows themselves, written."""
    rows = df.select(x.alias("x"), y.alias("y"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).filter("x is not null and y is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, waiting, held = TaskContext.get().partitionId(), 0, [], 0

        def out(strip: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal count
            order = np.argsort(strip.column("y").to_numpy(), kind="stable")
            for low in range(0, len(order), block_rows):
                own = strip.take(pa.array(order[low : low + block_rows])).combine_chunks()
                bounds = []
                for c in ("x", "y"):
                    values = own.column(c).to_numpy().astype(float)
                    values = np.where(np.isnan(values), np.inf, values)
                    # longs beyond 2**53 are rounded; the bounds are widened, so none is lost
                    bounds += [np.nextafter(values.min(), -np.inf), np.nextafter(values.max(), np.inf)]
                data = _packed(own.to_batches()[0])
                row = {"block": (part << 32) + count, "x0": bounds[0], "x1": bounds[1], "y0": bounds[2], "y1": bounds[3], "data": data}
                count += 1
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            low = 0
            while low < batch.num_rows:
                step = min(batch.num_rows - low, SLICES * block_rows - held)
                waiting.append(batch.slice(low, step))
                low, held = low + step, held + step
                if held == SLICES * block_rows:
                    yield from out(pa.Table.from_batches(waiting))
                    waiting, held = [], 0
        if held:
            yield from out(pa.Table.from_batches(waiting))

    schema = pa.schema([("block", pa.int64()), *((c, pa.float64()) for c in ("x0", "x1", "y0", "y1")), ("data", pa.binary())])
    dealt = rows.repartitionByRange("x", "y").sortWithinPartitions("x")
    return written(dealt.mapInArrow(cut, "block long, x0 double, x1 double, y0 double, y1 double, data binary"), side)


def inequality_join(
    left: DataFrame,
    right: DataFrame,
    x: tuple[str, str, str],
    y: tuple[str, str, str],
    left_columns: list[str],
    right_columns: list[str],
    block_rows: int | None = None,
) -> DataFrame:
    """``left_columns`` and ``right_columns`` of the pairs that satisfy both inequalities ``(left column, op, right column)``.

    The op is one of < <= > >=. Attributes are numbers, dates or timestamps;
    decimals are compared as doubles.

    * Rows with a null attribute match nothing. NaN is the largest value and equals itself.
    * Repeated rows match each by itself. Empty tables give no rows.
    * All columns named must differ; further ones, whatever their names, are left out.
    """
    if {x[1], y[1]} - set(_OPS):
        raise ValueError("an inequality is one of < <= > >=")
    if len({*left_columns, *right_columns}) < len(left_columns) + len(right_columns):
        raise ValueError("the columns must differ")
    sides = []
    whole = [_is_whole(left, right, p[0], p[2]) for p in (x, y)]
    for name, df, i, columns in (("left", left, 0, left_columns), ("right", right, 2, right_columns)):
        rows = block_rows or max(BLOCK_ROWS, -(-df.count() // MAX_BLOCKS))
        sides.append(_blocks(df, _number(df, x[i], whole[0]), _number(df, y[i], whole[1]), columns, name, rows))
    a, b = sides
    # fixed-size rows, MAX_BLOCKS and one for each partition at most
    found = b.select("block", "x0", "x1", "y0", "y1").collect()
    numbers, bounds = np.array([r[0] for r in found], np.int64), np.array([r[1:] for r in found], float).reshape(-1, 4)

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *own in zip(*(batch.column(c).to_pylist() for c in ("block", "x0", "x1", "y0", "y1")), strict=True):
                can = np.ones(len(numbers), bool)
                for k, op in ((0, x[1]), (2, y[1])):
                    can &= own[k] <= bounds[:, k + 1] if op in ("<", "<=") else own[k + 1] >= bounds[:, k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(can.sum(), block)), pa.array(numbers[can])], names=["l", "r"])

    out_schema = [f for df, cs in ((left, left_columns), (right, right_columns)) for f in (df.schema[c] for c in cs)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out_schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch.column("l_data"), batch.column("r_data"), strict=True):
                p, q = _unpacked(one.as_py()), _unpacked(other.as_py())
                values = [t.column(c).to_numpy() for t in (p, q) for c in ("x", "y")]
                for i, j in matches(*values, x[1], y[1]):
                    columns = [pc.take(p.column(k + 2), pa.array(i)) for k in range(len(left_columns))]
                    columns += [pc.take(q.column(k + 2), pa.array(j)) for k in range(len(right_columns))]
                    yield from pa.table(columns, names=[*left_columns, *right_columns]).to_batches()

    pairs = written(a.select("block", "x0", "x1", "y0", "y1").mapInArrow(meeting, "l long, r long"), "pairs")
    tasks = min(MAX_TASKS, max(1, pairs.count()))
    met = pairs.join(a.select(F.col("block").alias("l"), F.col("data").alias("l_data")), "l")
    met = met.join(b.select(F.col("block").alias("r"), F.col("data").alias("r_data")), "r")
    # few blocks make very many rows, so pairs are dealt by their number, not their bytes
    return met.repartition(tasks, "l", "r").select("l_data", "r_data").mapInArrow(join, ddl)
