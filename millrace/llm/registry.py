"""Queries of the training-data operators, with their parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    fm,
    importance,
    licenses,
    linecrf,
    matroska,
    mixing,
    nearjoin,
    packing,
    prefixtrie,
    records,
    sharding,
    sql,
    substring,
    urlfilter,
)
from millrace.llm._common import materialize

#: Host and path rules of the URL filter (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Globs for URLs that no rule fits (verdict, glob).
URL_GLOBS = [
    ("block", "*casino*"),
    ("block", "*casino*/**"),
    ("block", "*pills*"),
    ("block", "*pills*/**"),
    ("block", "*bets*"),
    ("block", "*bets*/**"),
    ("block", "**/login**"),
    ("block", "**.exe"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return records.round_trip(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return fm.score_documents(docs, fm.fit(docs, _table(spark, sf_dir, "labels")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(_table(spark, sf_dir, "documents"), window=35)


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return linecrf.judge_documents(docs, linecrf.fit(docs, _table(spark, sf_dir, "labels")))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(_table(spark, sf_dir, "documents")).drop("tie", "first")


def op11_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=40)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, least=20, buckets=10_000, seed=2024)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# Audits: what SQL can say of operators whose whole result it can't express.


def audit_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_matroska_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def audit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialize(op2_best_fit_packing(spark, sf_dir), "packed")
    docs = pieces.groupBy("doc_id").agg(F.max(F.col("start") + F.col("length")).alias("top"), F.sum("length").alias("n"))
    held = pieces.groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("top"), F.sum("length").alias("n"))
    marks = docs.agg(F.count_if(F.col("top") != F.col("n")).alias("uncovered")).crossJoin(  # one row each
        held.agg(F.count_if(F.col("top") != F.col("n")).alias("gaps"), F.count_if(F.col("n") > 2048).alias("overfull"))
    )
    return pieces.agg(F.count_if(F.col("piece") == 0).alias("documents")).crossJoin(marks)


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op4_binary_records(spark, sf_dir)
    ends = F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")
    return rows.agg(F.count("*").alias("documents"), (ends & (F.count_distinct("start") == F.count("*"))).alias("gapless"))


def audit_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_classifier(spark, sf_dir).agg(
        F.count("*").alias("documents"),
        F.count_if(F.expr("score is null or score < 0 or score > 1")).alias("out_of_range"),
        F.count_if(F.expr("predicted <> cast(score >= 0.7 as int)")).alias("inconsistent"),
    )


def audit_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def audit_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_line_quality(spark, sf_dir).drop("content_share", "kept")


def audit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes; whether the loads aren't those of a heap; slots that leave gaps; texts in two shards.

    A heap never puts a group on a shard that another is below: without its smallest group no shard of several is
    above the least loaded one, but for what classes of large sizes round.
    """
    rows = materialize(op11_lpt_sharding(spark, sf_dir), "shards")
    shards = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("slots"))
    marks = shards.agg(F.count_if(F.expr("top <> n - 1 or slots <> n")).alias("gaps"), F.count("*").alias("shards"))
    texts = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).join(rows, "doc_id")
    groups = texts.groupBy("key", "shard").agg(F.sum("size").alias("bytes"))
    split = groups.groupBy("key").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split"))
    loads = groups.groupBy("shard").agg(F.sum("bytes").alias("load"), F.min("bytes").alias("least"), F.count("*").alias("n"))
    base = F.max(F.when(F.col("n") > 1, F.col("load") - F.col("least")))
    uneven = loads.agg((F.coalesce(base, F.lit(0)) > F.min("load") * (1 + 1 / 1024)).alias("uneven"))
    sizes = rows.agg(F.count("*").alias("documents"), F.sum("size").alias("bytes"))
    return sizes.crossJoin(marks).crossJoin(split).crossJoin(uneven)  # one row each


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_matroska_media,
        op2_best_fit_packing,
        op3_license_scan,
        op4_binary_records,
        op5_url_filter,
        op6_quality_classifier,
        op7_source_mixing,
        op8_substring_dedup,
        op9_line_quality,
        op10_ngram_jaccard_join,
        op11_lpt_sharding,
        op12_importance_resampling,
        op13_prefix_trie,
        pipeline,
        audit_media,
        audit_packing,
        audit_records,
        audit_classifier,
        audit_mixing,
        audit_line_rules,
        audit_sharding,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": sql.license_scan(),
    "op5_url_filter": sql.URL_FILTER,
    "op8_substring_dedup": sql.SUBSTRING_DEDUP,
    "op10_ngram_jaccard_join": sql.JACCARD_JOIN,
    "op12_importance_resampling": sql.IMPORTANCE_RESAMPLING,
    "op13_prefix_trie": sql.PREFIX_TRIE,
    "audit_media": sql.AUDIT_MEDIA,
    "audit_packing": sql.AUDIT_PACKING,
    "audit_records": sql.AUDIT_RECORDS,
    "audit_classifier": sql.AUDIT_CLASSIFIER,
    "audit_mixing": sql.AUDIT_MIXING,
    "audit_line_rules": sql.AUDIT_LINE_RULES,
    "audit_sharding": sql.AUDIT_SHARDING,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = dict(ORACLE_SQL)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
