"""Importance resampling towards a target text (after Xie et al. 2023), by external sort-count.

1. Each text becomes a stream of 16-bit bucket numbers, one a feature. The
   streams of a slice of documents are written one behind the other, packed,
   with the place where each document ends.
2. A second pass sorts the streams slice by slice and run-length encodes them;
   the runs are summed to counts of each bucket.
3. From the counts of the corpus and of the target each bucket has a gain. A
   third pass gathers the gains of the streams and sums them document by
   document (``np.add.reduceat``), and adds Gumbel noise of the document's id.
4. The highest scores are drawn: a histogram of scores, which are integers of
   bounded size, tells the lowest one that counts, and what is not below it is
   ranked by range partitions.

The texts are read once. Memory is bounded by a slice; the driver gets a count
for each bucket and each score.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import arrow_schema, frees_between_queries, mapped, materialize, sliced, source_columns, text_bytes
from millrace.llm.ranks import ranked, tagged

BUCKETS = 10_000
STREAMS = "ids array<long>, ends array<long>, stream binary"

#: Upper-case ASCII letters become lower-case ones; what isn't a digit, a letter or beyond ASCII becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """Buckets of features, kept while there are not too many."""

    def __init__(self, buckets: int, most: int = 500_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


_memo: dict[int, _Buckets] = {}
frees_between_queries(_memo.clear)


def bucket_stream(data: bytes, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """The buckets of all runs of 1 to ``longest`` words of a text, repeats included."""
    memo = _memo.setdefault(buckets, _Buckets(buckets))
    words = data.translate(_FOLD).split()
    parts = [np.fromiter(map(memo.__getitem__, words), "<u2", len(words))]
    for n in range(2, longest + 1):
        grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        parts.append(np.fromiter(map(memo.__getitem__, grams), "<u2", len(grams)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_streams(df: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """Write the bucket streams of the rows ``id, text``: a row for each slice, its documents' ids, ends, and buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    schema = arrow_schema(df.sparkSession, STREAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            streams = [bucket_stream(data, buckets, longest) for data in text_bytes(batch.column("text"))]
            ends = np.cumsum([len(s) for s in streams]).tolist()
            packed = np.concatenate(streams).astype("<u2").tobytes()
            yield pa.RecordBatch.from_pylist([{"ids": batch.column("id").to_pylist(), "ends": ends, "stream": packed}], schema=schema)

    return materialize(mapped(df.select("id", "text"), run, STREAMS), "streams")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a stream, and how often each occurs, by sorting it."""
    ordered = np.sort(stream)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all streams; each task gives one row for a bucket that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches, 16):
            for packed in batch.column("stream").to_pylist():
                values, times = run_lengths(np.frombuffer(packed, "<u2"))
                total[values] += times
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": seen.astype(np.int32), "n": total[seen]})

    out = np.zeros(buckets, np.int64)
    for r in mapped(streams.select("stream"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) of each bucket, in doubles."""
    n, many, few = len(corpus), float(corpus.sum()), float(target.sum())
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (many + n) / ((s + 1.0) * (few + n)))) for s, t in pairs], np.int64)


def noise(doc: int | None, seed: int) -> int:
    """Gumbel noise of a document, in thousandths. A null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def gathered(gains: np.ndarray, stream: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each document, and the floored mean of their gains (0 without features)."""
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    weights, full = np.zeros(len(ends), np.int64), np.flatnonzero(sizes)
    if len(full):
        weights[full] = np.add.reduceat(gains[stream], starts[full]) // sizes[full]
    return sizes, weights


def score_streams(streams: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """``id, n_features, weight, score`` of each document of the streams."""
    schema = arrow_schema(streams.sparkSession, "id long, n_features long, weight long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 16):
            for ids, ends, packed in zip(*(batch.column(c).to_pylist() for c in ("ids", "ends", "stream")), strict=True):
                sizes, weights = gathered(gains, np.frombuffer(packed, "<u2"), np.array(ends, np.int64))
                scores = weights + np.array([noise(doc, seed) for doc in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, sizes, weights, scores)], schema=schema)

    return mapped(streams, run, "id long, n_features long, weight long, score long")


def resample(
    df: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least: int = 20,
    buckets: int = BUCKETS,
    longest: int = 1,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``df``; the drawn ones are ranked from 1, the rest null.

    Of the N rows with at least ``least`` words, floor(percent * N / 100) are
    drawn, by descending score; ties go to the smaller id.

    * Words are runs of ASCII digits, ASCII letters, lower-cased, and characters beyond ASCII.
    * Null and empty texts have no features, weight 0, and are drawn only if ``least`` is 0.
    * Very long texts count whole. A null id has the noise of an empty one and stands behind other ids in ties.
    * Repeated rows are rows of their own; further ties go to fewer features and the smaller weight.
    * Empty tables: no documents give no rows; without a target its counts are 0.
    * Further columns are not read.
    """
    streams = write_streams(source_columns(df, id=id_col, text=text_col), buckets, longest)
    aims = source_columns(target, text=target_col).withColumn("id", F.lit(None).cast("long"))
    gains = bucket_gains(bucket_counts(streams, buckets), bucket_counts(write_streams(aims, buckets, longest), buckets))
    scored = tagged(score_streams(streams, gains, seed), "scores")
    words = F.col("n_features") if longest == 1 else _words_of("n_features", longest)
    fit = words >= least
    # bounded: scores are thousandths of logarithms of counts
    counts = scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    k = percent * sum(r["n"] for r in counts) // 100
    lowest, seen = None, 0
    for r in counts:
        if seen >= k:
            break
        lowest, seen = r["score"], seen + r["n"]
    near = fit & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    rest = scored.filter(~near).withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight"), F.asc("nr")]
    top = ranked(scored.filter(near), order, "rank").withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return top.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def _words_of(features: str, longest: int):
    """The number of words of a text with so many runs of 1 to ``longest`` words."""
    few = F.floor((F.sqrt(8 * F.col(features) + 1) - 1) / 2)  # n (n + 1) / 2 runs of n words, for n below the longest
    many = (F.col(features) + longest * (longest - 1) // 2) / longest
    return F.when(few < longest, few).otherwise(many)
