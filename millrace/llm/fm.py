"""Quality classifier: a factorisation machine on hashed words and structure.

A document is a sparse vector x: hashed words (square roots of counts, scaled
to unit length), indicators of its structure and its length, each a statistic
dealt into steps, and indicators of its metadata: columns of the table beside
the text, numbers dealt into steps and other values hashed. The score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

where the pairwise part takes linear time by the sum-of-squares identity,
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). The model has a fixed size
(2**16 slots of 1 + 8 numbers). It is trained on the driver with AdaGrad on a
bounded sample of labelled rows; scoring is a map over all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from millrace.llm._common import drawn_within, frees_between_queries, map_rows, sliced, texts

SLOTS = 1 << 16
FACTORS = 8
#: Labelled rows that the model is fitted on at most, drawn by a hash of the id.
SAMPLE_ROWS = 6000
#: Bytes of their features at most; beyond, the model is fitted on fewer rows.
SAMPLE_BYTES = 128 << 20
THRESHOLD = 0.7
#: Metadata that scores may use: the recorded length. Ids, languages, sources and labels are never among them.
META_COLS = ("n_chars",)
MEMO_WORDS = 300_000
#: Steps that each statistic of the structure is dealt into.
STEPS = 16

_CLASSES = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\f\v", b"\n", b".,;:?'\"()-", range(128, 256)), 1):
    _CLASSES[list(_bytes)] = _k  # 1 lower, 2 upper, 3 digit, 4 blank, 5 line feed, 6 punctuation, 7 not ASCII; 0 the rest
STATISTICS = (
    "upper share", "digit share", "symbol share", "exclamation share", "punctuation share", "distinct share",
    "top word share", "word length", "line length", "repeated line share", "stop word share", "sentence ends",
    "upper start share", "length in words",
)
# Frequent function words of the four languages of the corpus (fixed values).
STOP_WORDS = frozenset(
    "the of and to in is was for that with as on by at from it this are be an or "
    "der die das und zu den von mit auf für ein eine ist im sich nicht "
    "le la les de des et en un une du que pour dans est par sur qui au "
    "el los las y del por con una para su no como es se lo".split()
)


def _word_slot(word: str) -> int:
    return len(STATISTICS) * STEPS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (SLOTS - len(STATISTICS) * STEPS)


class _Slots(dict):
    """Slot of a lower-cased word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        slot = _word_slot(word)
        if len(word) <= 64:
            self[word] = slot
        return slot


_SLOT = _Slots()
frees_between_queries(_SLOT.clear)


def _step(share: float) -> int:
    """Steps that are finer near 0: the square root of a share in [0, 1]."""
    return min(STEPS - 1, int(STEPS * min(1.0, max(0.0, share)) ** 0.5))


def _log_step(value: float, top: float) -> int:
    return min(STEPS - 1, int(STEPS * min(1.0, np.log1p(value) / np.log1p(top))))


def statistics(text: str) -> tuple[list[int], Counter]:
    """The step of each statistic, and the counts of the words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    rest, lower, upper, digit, _, feeds, marks, other = np.bincount(_CLASSES[data], minlength=8).tolist()
    words = text.split()
    counts = Counter(words)
    n = max(1, len(words))
    letters = max(1, lower + upper + other)
    size = max(1, len(data))
    lines = [x for x in text.split("\n") if x.strip()]
    exclamations = text.count("!")
    ends = text.count(". ") + text.count(".\n") + text.endswith(".")
    starts = sum(c for w, c in counts.items() if w[:1].isupper() and not w[1:].isupper())
    stops = sum(c for w, c in counts.items() if w.strip(".,").lower() in STOP_WORDS)
    steps = [
        _step(upper / letters),
        _step(digit / size),
        _step(rest / size),
        _step(exclamations / n),
        _step(marks / size),
        _step(len(counts) / n),
        _step(max(counts.values(), default=0) / n),
        _log_step(size / n, 60),
        _log_step(len(words) / max(1, len(lines)), 400),
        _step(1 - len(set(lines)) / max(1, len(lines))),
        _step(stops / n),
        _step(ends / n),
        _step(starts / n),
        _log_step(len(words), 50_000),
    ]
    del feeds
    return steps, counts


def metadata_slots(values: dict[str, object]) -> list[int]:
    """A slot for each metadata column: the step of a number, a hash of any other value, one of its own for null."""
    out = []
    for name, value in values.items():
        if isinstance(value, (int, float)):
            value = f"step {_log_step(max(0.0, float(value)), 1e6)}" if value == value else None
        out.append(_word_slot(f"\0{name}\0{'null' if value is None else value}"))
    return out


def featurize(text: str, metadata: dict[str, object] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text and its metadata. Empty texts have their structure only."""
    steps, counts = statistics(text)
    folded: Counter = Counter()
    for word, c in counts.items():
        folded[_SLOT[word.lower()]] += c
    slots = np.fromiter(folded, np.int64, len(folded))
    values = np.sqrt(np.fromiter(folded.values(), np.float32, len(folded)))
    if len(values):
        values = values / np.sqrt((values**2).sum())
    own = np.arange(len(steps)) * STEPS + np.array(steps)
    own = np.append(own, np.array(metadata_slots(metadata or {}), np.int64))
    return np.append(own, slots), np.append(np.full(len(own), 0.3, np.float32), values).astype(np.float32)


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray  # [slot]
    factors: np.ndarray  # [slot, factor]

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Score of each row, from 0 to 1."""
        if not rows:
            return np.empty(0)
        slots, values, starts = _stack(rows)
        return _sigmoid(_margin(self.bias, self.linear, self.factors, slots, values, starts)[0])


def _stack(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(s) for s, _ in rows[:-1])])
    return np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _margin(bias, linear, factors, slots, values, starts):
    """Margins, and the sums over each row that the gradient needs. Every row has a feature."""
    scaled = factors[slots] * values[:, None]
    sums = np.add.reduceat(scaled, starts)
    squares = np.add.reduceat(scaled**2, starts).sum(axis=1)
    return bias + np.add.reduceat(linear[slots] * values, starts) + 0.5 * ((sums**2).sum(axis=1) - squares), scaled, sums


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 10, rate: float = 0.1, decay: float = 1e-5, seed: int = 1
) -> Model:
    """Logistic loss, AdaGrad, mini-batches. Without rows, or with one class only, a constant model."""
    share = float(labels.mean()) if len(labels) else 0.5
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32)
    if not len(labels) or not 0 < share < 1:
        return Model(bias, linear, factors)
    factors = rng.normal(0, 0.05, (SLOTS, FACTORS)).astype(np.float32)
    g_linear, g_factors, g_bias = np.full(SLOTS, 1e-6, np.float32), np.full((SLOTS, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), 64):
            part = order[low : low + 64]
            slots, values, starts = _stack([rows[i] for i in part])
            margin, scaled, sums = _margin(bias, linear, factors, slots, values, starts)
            error = (_sigmoid(margin) - labels[part]).astype(np.float32) / len(part)
            lengths = np.diff(np.append(starts, len(slots)))
            each = np.repeat(error, lengths) * values
            down = each[:, None] * (np.repeat(sums, lengths, axis=0) - scaled)
            # sum by slot
            by = np.argsort(slots, kind="stable")
            used, first = np.unique(slots[by], return_index=True)
            dl = np.add.reduceat(each[by], first) + decay * linear[used]
            df = np.add.reduceat(down[by], first) + decay * factors[used]
            g_linear[used] += dl**2
            g_factors[used] += df**2
            linear[used] -= rate * dl / np.sqrt(g_linear[used])
            factors[used] -= rate * df / np.sqrt(g_factors[used])
            g_bias += float(error.sum()) ** 2
            bias -= rate * float(error.sum()) / g_bias**0.5
    return Model(bias, linear, factors)


# ---------------------------------------------------------------- Spark


def is_held_out(doc_id) -> "F.Column":
    """crc32(id as text) mod 4 is 2; null ids are not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(labels: DataFrame, rows: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``draw, l_id, label`` of at most ``rows`` labelled rows that aren't held out, the first by a hash of the id.

    Rows whose id is null or whose label is null or neither 0 nor 1 are left out.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("l_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("l_id").isNotNull() & ~is_held_out("l_id"))
    return known.select(F.xxhash64("l_id").alias("draw"), "l_id", "label").distinct().orderBy("draw", "l_id", "label").limit(rows)


def _expressions(docs: DataFrame, meta_cols: tuple[str, ...], **wanted: str) -> list[Column]:
    """Columns under internal names; metadata columns as ``meta_0`` and so on, null where the table has none."""
    out = [F.col(f"`{column}`").alias(name) for name, column in wanted.items()]
    for k, column in enumerate(meta_cols):
        if column in docs.columns:
            kind = docs.schema[column].dataType
            if not isinstance(kind, (NumericType, StringType)):
                raise ValueError(f"metadata are numbers or strings: {column}")
            value = F.col(f"`{column}`")
            out.append((value.cast("double") if isinstance(kind, NumericType) else value).alias(f"meta_{k}"))
        else:
            out.append(F.lit(None).cast("string").alias(f"meta_{k}"))
    return out


def _plain(values: list) -> list:
    """Numbers as floats, whatever their type."""
    return [x if x is None or isinstance(x, str) else float(x) for x in values]


def _vectors(column: pa.Array, meta_cols: tuple[str, ...], metadata: list[list]):
    """Slots and values of texts and their metadata, one after the other."""
    for i, text in enumerate(texts(column)):
        yield featurize(text, {name: values[i] for name, values in zip(meta_cols, metadata, strict=True)})


def _metadata(batch: pa.RecordBatch, meta_cols: tuple[str, ...]) -> list[list]:
    return [batch.column(f"meta_{k}").to_pylist() for k in range(len(meta_cols))]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    meta_cols: tuple[str, ...] = META_COLS,
    max_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, the first by a hash of the id.

    Rows whose label is null or neither 0 nor 1 are left out. If their features
    exceed ``max_bytes``, fewer rows count.
    """
    chosen = labelled_sample(labels, sample_rows, id_col, label_col)
    rows = docs.select(*_expressions(docs, meta_cols, id=id_col, text=text_col))
    # the sample has a bounded number of rows of three numbers
    sample = rows.join(F.broadcast(chosen), rows["id"] == chosen["l_id"]).drop("l_id")

    def features(batch: pa.RecordBatch):
        columns = (batch.column(c).to_pylist() for c in ("draw", "id", "label"))
        for draw, doc, label, (slots, values) in zip(*columns, _vectors(batch.column("text"), meta_cols, _metadata(batch, meta_cols)), strict=True):
            yield (draw, doc, label, 8 * len(slots), slots.astype("<u4").tobytes(), values.astype("<f4").tobytes()), 8 * len(slots)

    # an id with many rows gives no more than one of them: the sample stays bounded
    ddl = "draw long, id long, label int, size long, slots binary, vals binary"
    drawn = map_rows(sample, features, ddl).groupBy("draw", "id", "label").agg(F.min(F.struct("slots", "vals", "size")).alias("x"))
    drawn = drawn.select("draw", "id", "label", "x.size", "x.slots", "x.vals")
    found = drawn_within(drawn, ["draw", "id", "label"], "size", max_bytes)
    data = [(np.frombuffer(r.slots, "<u4").astype(np.int64), np.frombuffer(r.vals, "<f4")) for r in found]
    return train(data, np.array([r.label for r in found], np.float32))


def score_documents(
    docs: DataFrame,
    model: Model,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = META_COLS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``score`` is from 0 to 1.

    * Null and empty texts are scored by their structure. Very long texts count whole.
    * Null ids are kept and not held out. Null or missing metadata have a value of their own.
    * Repeated rows get equal scores. An empty table gives no rows.
    * Columns other than the id, the text and ``meta_cols`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the corpus

    def run(batch: pa.RecordBatch):
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            scores = shared.value.scores(list(_vectors(part.column("text"), meta_cols, _metadata(part, meta_cols))))
            for doc, flag, score in zip(part.column("id").to_pylist(), part.column("held_out").to_pylist(), scores.tolist(), strict=True):
                yield (doc, flag, score, int(score >= threshold)), 32

    rows = docs.select(*_expressions(docs, meta_cols, id=id_col, text=text_col)).withColumn("held_out", is_held_out("id"))
    return map_rows(rows, run, f"{id_col} long, held_out boolean, score double, predicted int")


def accepted(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", meta_cols: tuple[str, ...] = META_COLS
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches the threshold.

    Nulls, empty and very long texts are treated as in :func:`score_documents`;
    repeated rows stay or go together; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    _expressions(docs, meta_cols)  # looks at the types
    at = docs.columns.index(text_col)
    meta_at = [docs.columns.index(c) if c in docs.columns else None for c in meta_cols]

    def run(batches):
        for batch in sliced(batches):
            keep: list[bool] = []
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                columns = [[None] * part.num_rows if k is None else _plain(part.column(k).to_pylist()) for k in meta_at]
                keep += (shared.value.scores(list(_vectors(part.column(at), meta_cols, columns))) >= threshold).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
