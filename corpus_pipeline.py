"""A corpus in five stages: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``, further ones
included, whatever their names. An empty table gives an empty table in every
stage; null ids are kept; very long texts count whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import fm, mixing, nearjoin, packing, substring
from millrace.llm._common import materialize

#: Not expressible in SQL: the classifier, the join's pruning and the rounding aren't.
ORACLE_SQL: str | None = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts. It is fitted on ``documents`` and ``labels``.

    Null and empty texts are scored by their structure and metadata; repeated
    rows stay or go together. Without labels every score is 0.5, and no row stays.
    """
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fm.fit(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return fm.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near duplicates.

    Of rows alike in id and text one stays; a null id comes first. Null, empty
    and blank texts are groups of their own, so all of them stay.
    """
    return nearjoin.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of passages that repeat; ``n_chars`` follows the text.

    Null and empty texts, and those that lose nothing, stay as they are. Of
    repeated rows each loses what it shares with the others.
    """
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and empty texts have no words and aren't taken. A null source is a
    source of its own. Repeated rows share evenly what they are given.
    """
    return mixing.mixed_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of 2048 tokens.

    Null and empty texts are one piece that holds the end id. Repeated rows are
    packed each; pieces alike take different places.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written to the shared folder and read by the next.

    Nulls, repeats and empty tables are treated as the stages say.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
