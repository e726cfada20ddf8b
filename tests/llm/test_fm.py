import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import fm

SCHEMA = "doc_id long, text string, lang string, label string, score string"


def brute_margin(model, slots, values):
    """The definition: all pairs."""
    out = model.bias + float((model.linear[slots] * values).sum())
    for i in range(len(slots)):
        for j in range(i + 1, len(slots)):
            out += float(model.factors[slots[i]] @ model.factors[slots[j]]) * float(values[i]) * float(values[j])
    return out


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = fm.Model(0.3, rng.normal(0, 1, fm.SLOTS).astype(np.float32), rng.normal(0, 0.5, (fm.SLOTS, fm.FACTORS)).astype(np.float32))
    rows = [fm.featurize(t) for t in ["", "one two three two", "A B C! d, e. f\n" * 3, "é 12 $$$ x"]]
    want = [1 / (1 + np.exp(-brute_margin(model, *r))) for r in rows]
    assert model.scores(rows) == pytest.approx(want, rel=1e-4)
    assert model.scores([]).tolist() == []


def test_pairs_are_learnt():
    """Exclusive or of two features: no linear model can tell."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(600):
        a, b = int(rng.integers(2)), int(rng.integers(2))
        rows.append((np.array([100 + a, 200 + b]), np.ones(2, np.float32)))
        labels.append(a ^ b)
    model = fm.train(rows, np.array(labels, np.float32), epochs=60, rate=0.3)
    assert ((model.scores(rows) > 0.5) == np.array(labels, bool)).mean() > 0.98


def corpus(n=400):
    rng = random.Random(5)
    vocabulary = ["the", "of", "stone", "river", "walks", "green", "hill", "and", "to", "in"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, "en", "x", "y") for d, t in rows], SCHEMA)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, known = frames(spark, [*rows, (None, "null id"), (5000, None), (5001, ""), (5002, "x " * 100_000), (3, "again")], [*labels, (7, None, 0), (None, 1, 0)])
    model = fm.fit(docs, known)
    out = fm.score_documents(docs, model).collect()
    assert len(out) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    kept = fm.accepted(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in out if r.predicted)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = corpus(120)
    docs, known = frames(spark, rows, labels)
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, 0) for d, q, _ in labels]
    a, b = fm.fit(docs, known), fm.fit(docs, frames(spark, rows, turned)[1])
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_no_labels_and_empty(spark):
    rows, _ = corpus(10)
    docs, known = frames(spark, rows, [])
    model = fm.fit(docs, known)
    assert {r.score for r in fm.score_documents(docs, model).collect()} == {0.5}
    empty = spark.createDataFrame([], SCHEMA)
    assert fm.score_documents(empty, model).collect() == [] and fm.accepted(empty, model).collect() == []


def test_metadata_counts(spark):
    """Texts alike, told apart by their metadata only."""
    rows = [(i, "the same text", 10 if i % 2 else 90_000, "a" if i % 3 else None) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, None, None, None)], "doc_id long, text string, n_chars long, kind string")
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = fm.score_documents(docs, fm.fit(docs, known)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None)
    kept = fm.accepted(docs, fm.fit(docs, known)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [r.doc_id for r in sorted(out, key=lambda r: r.doc_id or -1) if r.doc_id is not None and r.predicted]
    with pytest.raises(ValueError):
        fm.accepted(docs.withColumn("n_chars", F.lit(True)), fm.fit(docs, known))
    for cols in (("kind", "none"), ()):
        blind = fm.score_documents(docs, fm.fit(docs, known, meta_cols=cols), meta_cols=cols).collect()
        assert all(0.1 < r.score < 0.9 for r in blind if r.doc_id is not None)
    assert fm.metadata_slots({"n": 5}) == fm.metadata_slots({"n": 5.0}) != fm.metadata_slots({"n": None})


def test_the_sample_is_bounded_in_bytes(spark):
    rows, labels = corpus(60)
    docs, known = frames(spark, rows, labels)
    a, b = fm.fit(docs, known), fm.fit(docs, known, max_bytes=2000)
    assert a.bias != b.bias or not (a.linear == b.linear).all()
