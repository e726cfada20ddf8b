"""Quality rules: a linear-chain conditional random field labels lines, content share decides.

Each line that has a word is labelled content or boilerplate by Viterbi decoding
of a CRF over indicators of its form. A document is kept if enough of its words
stand in content lines. The CRF is trained on the driver by maximum likelihood
(forward-backward, Adam) on a bounded sample of labelled documents, without the
held-out ones. Its line labels don't follow from the features, which see one
line of one text: a line is content if its document is marked good and the line
doesn't recur. A line recurs if it stands behind many different lines, counted
in Spark over all documents: what is put into many texts does, what is copied
with its surroundings doesn't.

As the labels of neighbours go together, so do those that the chain gives: a
line whose form is doubtful is judged by the lines around it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import drawn_within, map_rows, source_columns, texts
from millrace.llm.fm import labelled_sample

#: Labelled documents that the CRF is fitted on at most, with all their lines, and bytes of their features at most.
SAMPLE_DOCS = 1_000
SAMPLE_BYTES = 32 << 20
#: A line recurs if it stands behind so many different lines.
RECURS = 20
#: Longer chains are cut into pieces of so many lines for the fit; no line or transition is lost.
PIECE = 256
#: Share of the words that must stand in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\r\x0b\x0c"
# Words that mark boilerplate lines.
MARKERS = frozenset(
    "copyright rights reserved cookie cookies privacy terms login subscribe newsletter click share menu "
    "home javascript advertisement sitemap sponsored unsubscribe".split()
)
FEATURES = (
    ["bias", "ends a sentence", "starts upper", "marker word", "half markers", "seen before", "first", "last"]
    + [f"words {x}" for x in ("1-2", "3-5", "6-10", "11-20", "21-40", "41+")]
    + [f"upper {x}" for x in ("<.1", "<.3", "<.6", ".6+")]
    + [f"symbols {x}" for x in ("0", "<.01", "<.05", ".05+")]
    + [f"digits {x}" for x in ("<.05", "<.2", ".2+")]
    + [f"distinct {x}" for x in ("<.3", "<.6", ".6+")]
    + [f"exclaims {x}" for x in ("0", "<.3", ".3+")]
    + [f"pipes {x}" for x in ("0", "1-2", "3+")]
)
_AT = {name: k for k, name in enumerate(FEATURES)}


def _cut(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


@cache
def _classes() -> np.ndarray:
    """For each code point, bits: 1 letter, 2 upper-case, 4 digit."""
    chars = list(map(chr, range(0x110000)))
    tests = (str.isalpha, str.isupper, str.isdigit)
    return sum(np.fromiter(map(test, chars), np.uint8, len(chars)) << k for k, test in enumerate(tests)).astype(np.uint8)


def count_classes(line: str) -> tuple[int, int, int]:
    """Letters, upper-case letters and digits among all characters of the line."""
    counts = np.zeros(8, np.int64)
    for at in range(0, len(line), 1 << 16):  # all pieces are counted; they bound the arrays of a very long line
        codes = np.frombuffer(line[at : at + (1 << 16)].encode("utf-32-le", "surrogatepass"), np.uint32)
        counts += np.bincount(_classes()[codes], minlength=8)
    c = counts.tolist()
    return c[1] + c[3] + c[5] + c[7], c[2] + c[3] + c[6] + c[7], c[4] + c[5] + c[6] + c[7]


def line_features(lines: list[str]) -> tuple[list[list[int]], list[int]]:
    """For each line that has a word: its features, and its number of words."""
    out, sizes, seen = [], [], set()
    kept = [x for x in lines if x.strip(_SPACE)]
    for k, line in enumerate(kept):
        words = line.split()
        n, size = max(1, len(words)), len(line)
        letters, capitals, numerals = count_classes(line)
        upper, digits = capitals / max(1, letters), numerals / size
        symbols = sum(map(line.count, SYMBOLS)) / size
        marks = sum(w.strip(".,:;!()|").lower() in MARKERS for w in words)
        distinct = len(set(words)) / n
        exclaims, pipes = line.count("!") / n, line.count("|")
        ends = line.rstrip(_SPACE)[-1:] in ".?!…\"'»”"
        again = line in seen
        seen.add(line)
        row = [0, _AT["words 1-2"] + _cut(n, (3, 6, 11, 21, 41)), _AT["upper <.1"] + _cut(upper, (0.1, 0.3, 0.6))]
        row.append(_AT["symbols 0"] + (0 if not symbols else 1 + _cut(symbols, (0.01, 0.05))))
        row.append(_AT["digits <.05"] + _cut(digits, (0.05, 0.2)))
        row.append(_AT["distinct <.3"] + _cut(distinct, (0.3, 0.6)))
        row.append(_AT["exclaims 0"] + (0 if not exclaims else 1 + _cut(exclaims, (0.3,))))
        row.append(_AT["pipes 0"] + (0 if not pipes else 1 + _cut(pipes, (3,))))
        flags = (
            (ends, "ends a sentence"),
            (line.lstrip(_SPACE)[:1].isupper(), "starts upper"),
            (marks, "marker word"),
            (2 * marks >= n, "half markers"),
            (again, "seen before"),
            (k == 0, "first"),
            (k == len(kept) - 1, "last"),
        )
        row += [_AT[name] for flag, name in flags if flag]
        out.append(row)
        sizes.append(len(words))
    return out, sizes


@dataclass(frozen=True)
class Crf:
    """Weights of features by label, of transitions, and of the first label."""

    emit: np.ndarray  # [label, feature]
    move: np.ndarray  # [label before, label]
    start: np.ndarray  # [label]

    def viterbi(self, rows: list[list[int]]) -> list[int]:
        """The most likely labels; on a tie content (1)."""
        if not rows:
            return []
        e0, e1 = self.emit[0].tolist(), self.emit[1].tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b, back = 0.0, 0.0, []
        for k, row in enumerate(rows):
            x, y = sum(map(e0.__getitem__, row)), sum(map(e1.__getitem__, row))
            if not k:
                a, b = float(self.start[0]) + x, float(self.start[1]) + y
                continue
            from_b0, from_b1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((from_b0, from_b1))
            a, b = (b + m10 if from_b0 else a + m00) + x, (b + m11 if from_b1 else a + m01) + y
        label = int(b >= a)
        labels = [label]
        for pointer in reversed(back):
            label = int(pointer[label])
            labels.append(label)
        return labels[::-1]


def train(
    sequences: list[tuple[list[list[int]], list[int]]], steps: int = 150, rate: float = 0.1, decay: float = 1e-3, chain: bool = True
) -> Crf:
    """Maximum likelihood with an L2 penalty. Without sequences all weights are 0: every line is content.

    ``chain=False`` fits the same features without transitions (for comparison). A piece of a long chain is entered from the label of the line before it.
    """
    n_features = len(FEATURES)
    emit, move, start = np.zeros((2, n_features)), np.zeros((2, 2)), np.zeros(2)
    sequences = [s for s in sequences if s[0]]
    if not sequences:
        return Crf(emit, move, start)
    docs = len(sequences)
    pieces = [
        (rows[at : at + PIECE], labels[at : at + PIECE], labels[at - 1] if at else -1)
        for rows, labels in sequences
        for at in range(0, len(rows), PIECE)
    ]
    pieces.sort(key=lambda s: -len(s[0]))
    size = np.array([len(rows) for rows, _, _ in pieces])
    before = np.array([label for _, _, label in pieces])
    head, after = before < 0, [before == 0, before == 1]
    n, top = len(pieces), int(size[0])
    x, gold = np.zeros((n, top, n_features), np.float32), np.zeros((n, top), np.int64)
    for i, (rows, labels, _) in enumerate(pieces):
        gold[i, : len(labels)] = labels
        for t, row in enumerate(rows):
            x[i, t, row] = 1
    live = np.arange(top)[None, :] < size[:, None]
    hot = np.eye(2)[gold] * live[:, :, None]
    seen_emit = np.einsum("ntl,ntf->lf", hot, x)
    seen_move = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
    seen_move += [hot[a, 0].sum(0) for a in after]
    seen_start = hot[head, 0].sum(0)
    params = [emit, move, start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        score = x @ emit.T
        alpha, beta = np.zeros((n, top, 2)), np.zeros((n, top, 2))
        alpha[:, 0] = np.where(head[:, None], start, move[before]) + score[:, 0]
        for t in range(1, top):
            moved = np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]) + score[:, t]
            alpha[:, t] = np.where(live[:, t, None], moved, alpha[:, t - 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(top - 2, -1, -1):
            ahead = score[:, t + 1] + beta[:, t + 1]
            moved = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            beta[:, t] = np.where(live[:, t + 1, None], moved, 0)
        share = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
        pair = np.array([share[a, 0].sum(0) for a in after])
        for t in range(1, top):
            joint = alpha[:, t - 1, :, None] + move[None] + (score[:, t] + beta[:, t])[:, None, :]
            pair += (np.exp(joint - total[:, None, None]) * live[:, t, None, None]).sum(0)
        down = [
            (np.einsum("ntl,ntf->lf", share, x) - seen_emit) / docs + decay * emit,
            (pair - seen_move) / docs + decay * move,
            (share[head, 0].sum(0) - seen_start) / docs + decay * start,
        ]
        for k, (p, g, m, v) in enumerate(zip(params, down, first, second, strict=True)):
            if k and not chain:
                continue
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(emit, move, start)


def repeated_words(words: list, n: int = 3) -> int:
    """Words that stand in a run of n words found twice or more in the list, the first included."""
    if len(words) <= n:
        return 0
    names: dict = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    code = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        # ranks keep the codes small for any n and any number of words
        code = np.unique(code, return_inverse=True)[1] * len(names) + ids[k : len(ids) - n + 1 + k] if k > 1 else code * len(names) + ids[k : len(ids) - n + 1 + k]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    edges[starts] += 1
    edges[starts + n] -= 1
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def base_rules(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(text.split("\n"))
    dup = sum(c - 1 for line, c in lines.items() if c > 1 and line.strip(_SPACE))
    repeat = repeated_words(words)
    return n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n


# ---------------------------------------------------------------- Spark


def recurring_lines(docs: DataFrame, lines: DataFrame, text_col: str = "text", recurs: int = RECURS) -> DataFrame:
    """Those of ``lines`` (column ``line``, hashes; a bounded table) that stand behind ``recurs`` or more different lines of ``docs``.

    The start of a text counts as a line. Pairs of a line and the one before it
    are made distinct before and after the shuffle, so a line of very many
    documents is no burden. Null texts have no lines.
    """
    hashes = F.transform(F.split(f"`{text_col}`", "\n"), lambda x: F.xxhash64(x))
    pairs = F.arrays_zip(hashes.alias("line"), F.concat(F.array(F.lit(0).cast("long")), hashes).alias("before"))
    rows = docs.select(F.explode(pairs).alias("p")).select("p.line", "p.before").filter("line is not null")
    # the lines of a sample whose features are bounded in bytes: a few MB at most
    rows = rows.join(F.broadcast(lines.select("line").distinct()), "line", "left_semi").distinct()
    return rows.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= recurs).select("line")


def labelled_lines(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    recurs: int = RECURS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_bytes: int = SAMPLE_BYTES,
) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of the lines of a bounded sample of the labelled documents that aren't held out.

    The sample has the first ``sample_docs`` by a hash of the id. Labels that are
    null or neither 0 nor 1 are left out, as are texts that are null or have no
    word. Of an id with several rows or texts one counts. All lines of a sampled
    document count, however long; if features exceed ``max_bytes`` the sample
    has fewer documents.
    """
    chosen = labelled_sample(labels, sample_docs, id_col, label_col)
    rows = source_columns(docs, id=id_col, text=text_col)
    sample = rows.join(F.broadcast(chosen), rows["id"] == chosen["l_id"])  # of bounded size
    hashes = F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x))
    sample = sample.select("draw", "id", "label", "text", hashes.alias("hashes")).filter("text is not null")

    def features(batch: pa.RecordBatch):
        columns = (batch.column(c).to_pylist() for c in ("draw", "id", "label", "hashes"))
        for draw, doc, label, hashes, text in zip(*columns, texts(batch.column("text")), strict=True):
            lines = text.split("\n")
            found, _ = line_features(lines)
            kept = [h for h, line in zip(hashes, lines, strict=True) if line.strip(_SPACE)]
            if found:
                size = sum(map(len, found))
                yield (draw, doc, label, text[:64], 8 * size, found, kept), 16 * size

    ddl = "draw long, id long, label int, head string, size long, rows array<array<int>>, hashes array<long>"
    one = map_rows(sample, features, ddl).groupBy("draw", "id", "label").agg(
        F.min_by(F.struct("size", "rows", "hashes"), F.struct("head", "size", "hashes")).alias("x")
    )
    one = one.select("draw", "id", "label", "x.size", "x.rows", "x.hashes")
    found = drawn_within(one, ["draw", "id", "label"], "size", max_bytes)
    spark = docs.sparkSession
    lines = spark.createDataFrame([(h,) for h in {h for r in found for h in r.hashes}], "line long")
    again = {r.line for r in recurring_lines(docs, lines, text_col, recurs).collect()}  # of the sample's lines
    return [([list(x) for x in r.rows], [int(r.label and h not in again) for h in r.hashes]) for r in found]


def fit(docs: DataFrame, labels: DataFrame, **options) -> Crf:
    """Train on :func:`labelled_lines`. Without labelled documents every line is content."""
    return train(labelled_lines(docs, labels, **options))


def judge_documents(
    df: DataFrame, model: Crf, content_share: float = CONTENT_SHARE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Base counts, ``base_failed``, ``content_share`` and ``kept`` of every text.

    * Null and empty texts have no words and fail the base rules. Very long texts count whole.
    * Null ids are kept; repeated rows are judged alike.
    * An empty table gives no rows. Further columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batch: pa.RecordBatch):
        for doc, text in zip(batch.column("id").to_pylist(), texts(batch.column("text")), strict=True):
            base = base_rules(text)
            rows, sizes = line_features(text.split("\n"))
            labels = shared.value.viterbi(rows)
            share = sum(s for s, y in zip(sizes, labels, strict=True) if y) / max(1, sum(sizes))
            yield (doc, *base, share, not base[-1] and share >= content_share), 100

    schema = (
        f"{id_col} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, content_share double, kept boolean"
    )
    return map_rows(source_columns(df, id=id_col, text=text_col), run, schema)


def label_lines(df: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that has a word: ``doc_id, line, content``, the line's text as it is.

    Null, empty and blank texts have no such line. Very long lines and texts
    count whole, null ids are kept, repeated rows give their lines each, an
    empty table gives none. Further columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        for doc, text in zip(batch.column("id").to_pylist(), texts(batch.column("text")), strict=True):
            lines = text.split("\n")
            labels = shared.value.viterbi(line_features(lines)[0])
            for line, label in zip((x for x in lines if x.strip(_SPACE)), labels, strict=True):
                yield (doc, line, bool(label)), len(line)

    return map_rows(source_columns(df, id=id_col, text=text_col), run, f"{id_col} long, line string, content boolean")
