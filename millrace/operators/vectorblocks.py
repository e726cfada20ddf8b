"""All queries against all vectors, as products of matrices: blocks of rows meet packs of queries.

Pairs of vectors are never rows of a join. A block and a pack are one row each,
with their vectors as bytes; a task multiplies them and passes on what is asked
for. The number of pairs still grows with rows times queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import written

#: Vectors of a block, queries of a pack; queries that are multiplied at a time.
BLOCK_ROWS, PACK_ROWS, STEP_ROWS = 8192, 1024, 64
#: Stands for a null id.
NO_ID = -(1 << 63)


def blocks(df: DataFrame, id_col: str, vector_col: str, rows: int, name: str) -> DataFrame:
    """``size, ids, data`` of at most ``rows`` vectors of one length each, written. Vectors that are null or have nulls have size -1 and no data."""
    schema = pa.schema([("size", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(size: int) -> pa.RecordBatch:
            ids, data = (b"".join(p[k].tobytes() for p in held[size]) for k in (0, 1))
            held[size] = []
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids], pa.binary()), pa.array([data], pa.binary())], schema=schema)

        for batch in batches:
            ids, column = batch.column("id").fill_null(NO_ID).to_numpy(), batch.column("v")
            sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).copy()
            flat = column.flatten()
            if flat.null_count:
                sizes[pc.list_parent_indices(column).filter(flat.is_null()).to_numpy()] = -1
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = np.zeros((len(at), 0)) if size < 0 else column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy().reshape(len(at), size)
                while len(at):
                    have = sum(len(p[0]) for p in held.setdefault(size, []))
                    held[size].append((ids[at[: rows - have]], x[: rows - have]))
                    at, x = at[rows - have :], x[rows - have :]
                    if sum(len(p[0]) for p in held[size]) == rows:
                        yield out(size)
        for size in held:
            if held[size]:
                yield out(size)

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return written(source.mapInArrow(run, "size int, ids binary, data binary"), name)


def meet(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, each: Callable[..., Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """What ``each`` makes of a step of queries and a block: ``each(query ids, queries, ids, vectors)``.

    Vectors are matrices of doubles, both None where the two can't be compared
    (null, or of different lengths).
    """
    rows = blocks(df, id_col, vector_col, BLOCK_ROWS, "blocks")
    packs = blocks(queries, id_col, vector_col, PACK_ROWS, "packs").select(*(F.col(c).alias(f"q_{c}") for c in ("size", "ids", "data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size, q_size, ids, data, q_ids, q_data = (batch.column(c)[k].as_py() for c in ("size", "q_size", "ids", "data", "q_ids", "q_data"))
                ids, asked, x, q = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64), None, None
                if size == q_size >= 0:
                    x, q = np.frombuffer(data).reshape(len(ids), size), np.frombuffer(q_data).reshape(len(asked), size)
                for low in range(0, len(asked), STEP_ROWS):
                    part = slice(low, low + STEP_ROWS)
                    yield from each(asked[part], None if q is None else q[part], ids, x)

    # a task for each block, about; no hint: few queries are broadcast, many are crossed
    dealt = rows.repartition(max(1, rows.count()), F.xxhash64("ids"))
    return dealt.crossJoin(packs).select("size", "q_size", "ids", "data", "q_ids", "q_data").mapInArrow(run, ddl)


def squared_distances(q: np.ndarray, x: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Of all pairs, from their product; near or infinite ones by differences, as the product loses their digits."""
    size = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None]
    out = size - 2 * product
    a, b = np.nonzero(~(out >= 1e-4 * size))
    for low in range(0, len(a), 8192):
        i, j = a[low : low + 8192], b[low : low + 8192]
        out[i, j] = ((q[i] - x[j]) ** 2).sum(axis=1)
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds; never -0."""
    y = x * 10.0**digits
    return np.trunc(y + np.copysign(np.nextafter(0.5, 0), y)) / 10.0**digits + 0.0


def cosines(q: np.ndarray, x: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of all pairs, and where there are none: a vector is zero."""
    size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None]
    return np.divide(product, size, out=np.zeros_like(product), where=size != 0), size == 0


def similarities(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``query_id, <id_col>, dot, cos, l2`` of every pair, rounded to 4, 6 and 5 digits; null where they can't be had."""

    def each(asked: np.ndarray, q: np.ndarray | None, ids: np.ndarray, x: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        pairs = [pa.array(v, mask=v == NO_ID) for v in (np.repeat(asked, len(ids)), np.tile(ids, len(asked)))]
        if q is None:
            values = [pa.nulls(len(pairs[0]), pa.float64())] * 3
        else:
            with np.errstate(all="ignore"):
                product = q @ x.T
                cos, none = cosines(q, x, product)
                l2 = np.sqrt(squared_distances(q, x, product))
                values = [pa.array(rounded(product, 4).ravel()), pa.array(rounded(cos, 6).ravel(), mask=none.ravel()), pa.array(rounded(l2, 5).ravel())]
        whole = pa.RecordBatch.from_arrays([*pairs, *values], names=["query_id", id_col, "dot", "cos", "l2"])
        for low in range(0, whole.num_rows, 65_536):
            yield whole.slice(low, 65_536)

    return meet(df, queries, id_col, vector_col, each, f"query_id long, `{id_col}` long, dot double, cos double, l2 double")


def nearest(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """``query_id, <id_col>, score``: of each block the k rows with the largest cosines, rounded to 6 digits; ties go to smaller ids.

    A score is null for zero vectors and those that can't be compared: they come last. NaN comes first. Rows without an id are left out.
    """

    def each(asked: np.ndarray, q: np.ndarray | None, ids: np.ndarray, x: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        score = np.full((len(asked), len(ids)), -np.inf)
        if q is not None:
            with np.errstate(all="ignore"):
                cos, none = cosines(q, x, q @ x.T)
                score = np.where(none, -np.inf, np.where(np.isnan(cos), np.inf, rounded(cos, 6)))
        n = min(k + 1, len(ids))  # the query may be one
        least = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n]
        found = []
        for row in range(len(asked)):
            at = np.flatnonzero(score[row] >= least[row])
            at = at[ids[at] != asked[row]]
            found.append(at[np.lexsort((ids[at], -score[row, at]))[:k]])
        rows = np.repeat(np.arange(len(asked)), [len(a) for a in found])
        at = np.concatenate(found)
        values = score[rows, at]
        column = pa.array(np.where(values == np.inf, np.nan, values), mask=values == -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(asked[rows]), pa.array(ids[at]), column], names=["query_id", id_col, "score"])

    return meet(df.filter(F.col(id_col).isNotNull()), queries, id_col, vector_col, each, f"query_id long, `{id_col}` long, score double")


def projected(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, tables: int, most: float) -> DataFrame:
    """``found, near, wanted`` by block: pairs closer than ``most`` that share a bucket, whether all these are that close, and all pairs that are.

    The last ``tables`` entries of a vector are its buckets.
    """

    def each(asked: np.ndarray, q: np.ndarray | None, ids: np.ndarray, x: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if q is None:
            return
        shared = np.zeros((len(asked), len(ids)), bool)
        for t in range(1, tables + 1):
            shared |= q[:, -t][:, None] == x[:, -t][None]
        a, b = np.ascontiguousarray(q[:, :-tables]), np.ascontiguousarray(x[:, :-tables])
        gap = np.sqrt(squared_distances(a, b, a @ b.T))
        close = gap < most
        found = gap[shared & close]
        yield pa.RecordBatch.from_pylist([{"found": len(found), "near": bool((found < most).all()), "wanted": int(close.sum())}])

    return meet(df, queries, id_col, vector_col, each, "found long, near boolean, wanted long")
