"""Each stage of the pipeline against a brute-force version of it, on the output of the one before."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_nearjoin import brute as near_brute
from test_substring import WORDS
from test_substring import brute as window_brute

from millrace.llm import fm, mixing
from millrace.llm._common import materialize

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(" ".join(WORDS.findall(text)).encode()).hexdigest()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, dtypes = docs.columns, docs.dtypes
    stages = [f for _, f in corpus_pipeline.STAGES]

    def step(k, frame):
        out = materialize(stages[k](spark, frame, SF), f"t{k}")
        assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in dtypes]
        assert out.filter(F.col("n_chars") != F.length("text")).count() == 0
        return out

    good = step(0, docs)
    model = fm.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [d.doc_id for d in docs.collect() if model.scores([fm.featurize(d.text, {"n_chars": d.n_chars})])[0] >= 0.7]
    assert sorted(r.doc_id for r in good.collect()) == sorted(want) and 0 < len(want) < docs.count()

    single = step(1, good)
    classes = {c for _, c, *_ in near_brute([(r.doc_id, r.text) for r in good.collect()])}
    assert sorted(r.doc_id for r in single.collect()) == sorted(classes)

    cut = step(2, single)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    after = {r.doc_id: r.text for r in cut.collect()}
    for (doc, text), (_, _, gone, kept) in zip(rows, window_brute(rows, 35), strict=True):
        assert sha(after[doc]) == kept and (gone or after[doc] == text)

    mixed = step(3, cut)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in cut.collect():
        n = len(WORDS.findall(r.text))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in mixed.collect():
        taken[r.source] += len(WORDS.findall(r.text))
    for s, goal in mixing.targets(sizes).items():
        assert abs(taken[s] - goal) <= largest[s] / 2 + 1e-6
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2

    last = stages[4](spark, mixed, SF)
    full = last.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"))
    assert full.filter("n <> top or n > 2048").count() == 0
    assert last.filter("piece = 0").count() == mixed.count()
    total = last.agg(F.sum("length")).first()[0]
    assert full.count() <= 1.05 * -(-total // 2048) + 1

    assert corpus_pipeline.run(spark, SF).count() == last.count()


def test_empty_and_awkward_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "x y", "en", "s", 3), (2, "", "en", None, 0), (3, "word " * 90, "en", "s", 450)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("full", rows), ("empty", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (1, 0, 0)] if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, d).collect()
        corpus_pipeline.run(spark, d).collect()
