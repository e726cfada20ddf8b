"""Nearest vectors by inverted lists and residual codes, exactly re-ranked (after Jegou et al. 2011).

1. *Fit.* k-means on a bounded sample gives centroids; the residuals of the
   sample give a codebook for each of several subspaces.
2. *Index.* Every row goes to the list of its nearest centroid, as a code of one
   byte a subspace. A list of any size is stored in blocks of bounded size.
3. *Search.* A query looks at the blocks of its nearest lists. Distances to
   codes are products of matrices, for packs of queries at a time; the
   best of each block and query go on.
4. The best of all blocks are compared with the vectors themselves.

The driver holds the model and a count for each list, nothing that grows with
the rows. Vectors are compared by cosine: they are scaled to length one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.storage import written

#: Rows that centroids and codebooks are fitted on at most.
SAMPLE_ROWS = 20_000
#: Lists at most; below, the square root of the number of rows.
MAX_LISTS = 1024
#: Parts of a vector, each a byte of its code, unless fit() is told otherwise.
SUBSPACES = 16
#: Codes of a block, queries of a pack, on average and at most.
BLOCK_ROWS, PACK_QUERIES = 65_536, 128


@dataclass
class Model:
    """Centroids [list, d] and codebooks [subspace, code, d / subspaces]; the number of blocks of each list, once indexed."""

    centroids: np.ndarray
    codebooks: np.ndarray
    blocks: dict[int, int] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return self.centroids.shape[1]


def unit_rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column that can be compared, scaled to length one, and their places; others are null, of another length, not finite, or zero."""
    lengths = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    places = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(places)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(places), size)
    norm = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return flat[good] / norm[good, None], places[good]


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(axis=1)[None] - 2 * x @ centers.T, axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from k different rows; a center that loses all its rows stays where it was."""
    x = np.asarray(x, np.float64)
    different = np.unique(x, axis=0)
    centers = different[rng.permutation(len(different))[:k]]
    for _ in range(rounds):
        own = _nearest(x, centers)
        counts = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def fit(df: DataFrame, id_col: str, vector_col: str, size: int, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 11, subspaces: int = SUBSPACES) -> Model:
    """Fit on the ``sample_rows`` rows with the smallest hashes of their ids, or on all if there are fewer."""
    if size % subspaces:
        raise ValueError(f"vectors are cut into {subspaces} equal parts")
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.size("v") == size)
    rows = rows.filter(~F.exists("v", lambda x: x.isNull()))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()  # bounded by the parameter
    x = np.array([r["v"] for r in drawn], np.float64).reshape(-1, size)
    norm = np.sqrt((x * x).sum(axis=1))
    x = x[np.isfinite(norm) & (norm > 0)] / norm[np.isfinite(norm) & (norm > 0)][:, None]
    if not len(x):
        x = np.eye(1, size)
    rng = np.random.default_rng(seed)
    lists = lists or min(MAX_LISTS, max(1, int(df.count() ** 0.5)))
    centroids = k_means(x, lists, rng)
    rest = x - centroids[_nearest(x, centroids)]
    parts = np.split(rest, subspaces, axis=1)
    books = [k_means(p, 256, rng) for p in parts]
    books = [np.concatenate([b, np.repeat(b[-1:], 256 - len(b), axis=0)]) for b in books]
    return Model(centroids.astype(np.float32), np.stack(books).astype(np.float32))


def build(df: DataFrame, model: Model, id_col: str, vector_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of all rows that can be compared: ``list, block, ids, codes``, written. Fills in the model's numbers of blocks."""
    centroids, books = model.centroids, model.codebooks
    row = "list int, id long, code binary"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, places = unit_rows(batch.column("v"), centroids.shape[1])
            own = _nearest(x, centroids)
            parts = np.split(x - centroids[own], len(books), axis=1)
            codes = np.stack([_nearest(p, b) for p, b in zip(parts, books, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), batch.column("id").take(pa.array(places)).cast(pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["list", "id", "code"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, codes = None, [], []
        for batch in batches:
            for *now, one, code in zip(*(batch.column(c).to_pylist() for c in ("list", "block", "id", "code")), strict=True):
                if now != key:
                    if ids:
                        yield pa.RecordBatch.from_pylist([{"list": key[0], "block": key[1], "ids": ids, "codes": b"".join(codes)}], schema=schema)
                    key, ids, codes = now, [], []
                ids.append(one)
                codes.append(code)
        if ids:
            yield pa.RecordBatch.from_pylist([{"list": key[0], "block": key[1], "ids": ids, "codes": b"".join(codes)}], schema=schema)

    schema = pa.schema([("list", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("codes", pa.binary())])
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    assigned = written(rows.mapInArrow(assign, row), "assigned")
    counts = {r["list"]: r["n"] for r in assigned.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
    model.blocks = {k: -(-n // block_rows) for k, n in counts.items()}
    table = F.broadcast(df.sparkSession.createDataFrame(list(model.blocks.items()), "list int, blocks int"))
    dealt = assigned.join(table, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("list", "block", "id", "code").repartition("list", "block").sortWithinPartitions("list", "block")
    return written(dealt.mapInArrow(pack, "list int, block int, ids array<long>, codes binary"), "index")


def _best(x: np.ndarray, cells: np.ndarray, books: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and places of the ``keep`` nearest codes of each residual in x."""
    coded = np.concatenate([b[cells[:, s]] for s, b in enumerate(books)], axis=1)
    total = (x * x).sum(axis=1)[:, None] - 2 * x @ coded.T + (coded * coded).sum(axis=1)[None]
    keep = min(keep, len(cells))
    at = np.argpartition(total, keep - 1, axis=1)[:, :keep]
    return np.take_along_axis(total, at, axis=1), at


def candidates(queries: DataFrame, index: DataFrame, model: Model, probes: int, keep: int) -> DataFrame:
    """``query, id``: the ``keep`` rows nearest to each query (``query, v``) by their codes, of the ``probes`` nearest lists."""
    centroids, books = model.centroids, model.codebooks
    pack_schema = pa.schema([("list", pa.int32()), ("queries", pa.list_(pa.int64())), ("vectors", pa.binary())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, places = unit_rows(batch.column("v"), centroids.shape[1])
            gap = (centroids * centroids).sum(axis=1)[None] - 2 * x @ centroids.T
            n = min(probes, len(centroids))
            near = np.argpartition(gap, n - 1, axis=1)[:, :n]
            ids = np.array(batch.column("query").to_pylist())[places]
            data = [v.tobytes() for v in x.astype(np.float32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ravel(), pa.int32()), pa.array(np.repeat(ids, n), pa.int64()), pa.array([v for v in data for _ in range(n)], pa.binary())],
                names=["list", "query", "vector"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, data = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"list": key, "queries": ids, "vectors": b"".join(data)}], schema=pack_schema)

        for batch in batches:
            for now, one, vector in zip(*(batch.column(c).to_pylist() for c in ("list", "query", "vector")), strict=True):
                if now != key or len(ids) == PACK_QUERIES:
                    if ids:
                        yield out()
                    key, ids, data = now, [], []
                ids.append(one)
                data.append(vector)
        if ids:
            yield out()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                x = np.frombuffer(row.column("vectors")[0].as_py(), np.float32).reshape(-1, centroids.shape[1])
                x = x - centroids[row.column("list")[0].as_py()]
                ids = row.column("ids")[0].values.to_numpy()
                cells = np.frombuffer(row.column("codes")[0].as_py(), np.uint8).reshape(-1, len(books))
                asked = row.column("queries")[0].values.to_numpy()
                for low in range(0, len(x), 16):
                    gaps, at = _best(x[low : low + 16], cells, books, keep)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(asked[low : low + 16], at.shape[1])), pa.array(ids[at.ravel()]), pa.array(gaps.ravel().astype(np.float64))],
                        names=["query", "id", "gap"],
                    )

    spark = queries.sparkSession
    chosen = queries.select("query", "v").mapInArrow(choose, "list int, query long, vector binary")
    packs = chosen.repartition("list").sortWithinPartitions("list").mapInArrow(pack, "list int, queries array<long>, vectors binary")
    places = [(k, b) for k, n in model.blocks.items() for b in range(n)]
    table = spark.createDataFrame(places, "list int, block int")
    met = packs.join(table, "list").join(index, ["list", "block"])
    near = met.select("list", "queries", "vectors", "ids", "codes").mapInArrow(score, "query long, id long, gap double")
    order = Window.partitionBy("query").orderBy("gap", "id")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select("query", "id")


def search(
    df: DataFrame, queries: DataFrame, index: DataFrame, model: Model, k: int, probes: int, keep: int, id_col: str, vector_col: str
) -> DataFrame:
    """``query_id, <id_col>, place, score``: the k rows most similar to each query, itself left out, among ``keep`` candidates.

    Ties in the score, rounded to 6 digits, go to the smaller id. Queries and rows that
    can't be compared (null, another length, zero, not finite) are in no result.
    An empty table gives none.
    """
    asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector_col).alias("v"))
    pairs = candidates(asked, index, model, probes, keep + 1).filter("query <> id")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("other"))
    scored = pairs.join(rows, "id").join(asked, "query").select("query", "id", F.round(vectors.cosine(F.col("v"), F.col("other")), 6).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = scored.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k)
    return best.select(F.col("query").alias("query_id"), F.col("id").alias(id_col), "place", "score")


def exact_neighbours(df: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, most: int = 64) -> DataFrame:
    """``query, id`` of the k most similar rows by brute force, for ``most`` queries, those with the smallest hashes.

    Their vectors go to every task; a batch passes on its best k for each.
    """
    drawn = queries.orderBy(F.xxhash64(id_col), id_col).limit(most).select(id_col, vector_col).collect()  # bounded by the parameter
    size = max((len(r[vector_col]) for r in drawn), default=1)
    held = pa.array([r[vector_col] for r in drawn], pa.list_(pa.float64()))
    probes, places = unit_rows(held, size)
    asked = np.array([drawn[p][id_col] for p in places], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = unit_rows(batch.column("v"), size)
            ids = batch.column("id").to_numpy()[own]
            if not len(ids) or not len(asked):
                continue
            scores = np.round(probes @ x.T, 6)
            scores[asked[:, None] == ids[None]] = -2
            n = min(k + 1, len(ids))
            at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked, n)), pa.array(ids[at.ravel()]), pa.array(np.take_along_axis(scores, at, axis=1).ravel())], names=["query", "id", "score"]
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    found = rows.mapInArrow(run, "query long, id long, score double").filter("query <> id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query", "id")


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> DataFrame:
    """One row: how many of the ``exact`` neighbours there are, and how many of them ``found`` has."""
    mine = found.select(F.col("query_id").alias("query"), F.col(id_col).alias("id"), F.lit(1).alias("hit"))
    return exact.join(mine, ["query", "id"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
