"""License scans by diagonal voting, in DataFrame operations only.

Every rolling run of k words of a text is hashed and joined to the runs of the
license templates (a fixed, small table, so it is broadcast). A hit at word p
of the text and word t of a template votes for the diagonal p - t: where the
template would start. Votes are summed by text, template and diagonal. Words put
in or left out shift the diagonal, so each diagonal is merged with those up to
``drift`` behind it into a span, which is thereby at most ``drift`` words longer
than the template. A span is verified: of its hits, equal word for word, the
longest chain in which both the places in the text and those in the template
rise is found, and its share of the template's runs is the span's coverage.
Runs out of order, or scattered, prove nothing.

A diagonal with the votes of all runs of a template is a literal occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import source_columns

#: Words of a run.
K = 3
#: Diagonals of a span lie at most so far apart: words put in or left out, all in all.
DRIFT = 6
#: Share of a template's runs that a span must hold.
COVERAGE = 0.7

# Phrases whose literal places are counted, with their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Words of well-known licenses by which they differ from others, with their labels. A span may depart from them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
]
# Names and notices that another license's differ from by a word, with their labels. They count only as they stand.
EXACT = [
    ("gpl", "the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl-2", "gnu lesser general public license version 2"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("bsd-2", "bsd 2 clause license"),
    ("bsd-3", "bsd 3 clause license"),
    ("cc-by", "creative commons attribution 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0"),
]
# Labels of families, which give way to a longer label of a member, such as gpl to gpl-2.
FAMILIES = ["gpl", "lgpl", "lgpl-2", "agpl", "bsd"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lowered: runs of digits, a-z and all that is not ASCII. Null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _NO_WORD), "")


def template_runs(
    spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]], exact: list[tuple[str, str]], k: int, coverage: float
) -> DataFrame:
    """``h, t0.., template, label, base, at, runs, needed``: one row for each run of each template; ``needed`` is the coverage that counts."""
    rows = []
    for base, needed, group in ((True, 1.0, phrases), (False, coverage, templates), (False, 1.0, exact)):
        for label, text in group:
            words = text.split()
            if len(words) < k:
                raise ValueError(f"template shorter than {k} words: {text}")
            runs, template = len(words) - k + 1, len(rows)  # named by its first row
            rows += [(*words[i : i + k], template, label, base, i, runs, needed) for i in range(runs)]
    words = ", ".join(f"t{i} string" for i in range(k))
    table = spark.createDataFrame(rows, f"{words}, template int, label string, base boolean, at int, runs int, needed double")
    return table.withColumn("h", F.xxhash64(*(f"t{i}" for i in range(k))))


def votes(docs: DataFrame, runs: DataFrame, k: int = K) -> DataFrame:
    """Hits of ``id, tie, words`` by text, template and diagonal: ``votes`` counts the template's runs."""
    shifted = [F.col("words"), *(F.slice("words", F.lit(i + 1), F.greatest(F.size("words"), F.lit(1))) for i in range(1, k))]
    zipped = F.arrays_zip(*(c.alias(f"w{i}") for i, c in enumerate(shifted)))
    grams = docs.select("id", "tie", F.posexplode(zipped).alias("pos", "gram"))
    names = [f"w{i}" for i in range(k)]
    grams = grams.select("id", "tie", "pos", *(F.col("gram").getField(n).alias(n) for n in names))
    grams = grams.withColumn("gram_hash", F.xxhash64(*names))
    same = [F.col(f"w{i}") == F.col(f"t{i}") for i in range(k)]  # a hash alone proves nothing
    on = F.col("gram_hash") == F.col("h")
    for s in same:
        on = on & s
    hits = grams.join(F.broadcast(runs), on)  # the templates are a fixed table
    hits = hits.select("id", "tie", "template", "label", "base", "runs", "needed", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    # rows alike in id and text vote once
    keys = ["id", "tie", "template", "label", "base", "runs", "needed", "diagonal"]
    return hits.groupBy(*keys).agg(F.collect_set("at").alias("held")).withColumn("votes", F.size("held"))


def longest_chain(hits: Column, size: Column) -> Column:
    """Hits in the longest chain that rises in both coordinates.

    ``hits`` are structs ``at, back`` in order: the place in the template, and
    minus the place in the span. For each place the most hits of a chain that
    ends there or before is carried on; of hits with one ``at`` the later come
    first, so that a chain holds one of them at most. ``size`` is the span's.
    """
    reach = F.array_repeat(F.lit(0), size.cast("int"))

    def grow(best: Column, hit: Column) -> Column:
        place = -hit["back"]
        longer = F.coalesce(F.get(best, place - 1), F.lit(0)) + 1
        return F.transform(best, lambda n, i: F.when(i >= place, F.greatest(n, longer)).otherwise(n))

    return F.element_at(F.aggregate(hits, reach, grow), -1)


def merge_diagonals(tally: DataFrame, drift: int = DRIFT) -> DataFrame:
    """Verified spans: one row for each diagonal, which opens a span, with the ``coverage`` of the span.

    ``place`` is the diagonal if it holds the whole template literally. The
    groups are those of one text and template, and a span holds at most
    ``drift`` + 1 diagonals.
    """
    ahead = Window.partitionBy("id", "tie", "template").orderBy("diagonal").rangeBetween(0, drift)
    own = F.transform("held", lambda at: F.struct(at.alias("at"), F.col("diagonal").alias("diagonal")))
    spans = tally.withColumn("span", F.flatten(F.collect_list(own).over(ahead)))
    hits = F.transform("span", lambda h: F.struct(h["at"].alias("at"), (F.col("diagonal") - h["diagonal"] - h["at"]).alias("back")))
    chain = longest_chain(F.array_sort(hits), F.col("runs") + drift)
    place = F.when(F.col("votes") == F.col("runs"), F.col("diagonal"))
    return spans.select("id", "tie", "template", "label", "base", "needed", "diagonal", place.alias("place"), (chain / F.col("runs")).alias("coverage"))


def _without_families(labels: Column, families: list[str]) -> Column:
    """Labels of a document without those of families of which it has a member's."""
    member = lambda f: F.exists(labels, lambda m: m.startswith(F.concat(f, F.lit("-"))) | m.startswith(F.concat(f, F.lit("."))))
    return F.filter(labels, lambda f: ~(f.isin(families) & member(f)))


def scan_licenses(
    df: DataFrame,
    phrases: list[tuple[str, str]] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    exact: list[tuple[str, str]] = EXACT,
    families: list[str] = FAMILIES,
    k: int = K,
    drift: int = DRIFT,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every text.

    ``n_base`` counts the literal places of the phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start. ``labels`` adds those of
    templates that a span covers by ``coverage`` or more, and of ``exact`` ones
    that it covers whole; one of ``families`` is left out where a label of a
    member is found. ``score`` is the best coverage of any span, from 0 to 1.

    * Null and empty texts, and those shorter than k words: nothing is found.
    * Very long texts are scanned whole. Null ids are kept.
    * Repeated rows get equal results, each its own row.
    * An empty table gives no rows. Further columns are not read.
    """
    runs = template_runs(df.sparkSession, phrases, templates, exact, k, coverage)
    docs = source_columns(df, id=id_col, text=text_col)
    docs = docs.select("id", F.xxhash64("text").alias("tie"), words_of(F.col("text")).alias("words"))
    spans = merge_diagonals(votes(docs, runs, k), drift)
    stands = F.col("base") & F.col("place").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    fits = stands | ((F.col("coverage") >= F.col("needed")) & ~F.col("base"))
    found = spans.groupBy("id", "tie").agg(
        F.count(F.when(stands, F.col("place"))).alias("n_base"),
        F.min(F.when(stands, F.col("place"))).cast("long").alias("first_word"),
        F.max(F.when(stands, F.col("place"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(stands, F.col("label")))).alias("base_labels"),
        joined(_without_families(F.collect_set(F.when(fits, F.col("label"))), families)).alias("labels"),
        F.max("coverage").alias("score"),
    )
    found = found.withColumnsRenamed({"id": "f_id", "tie": "f_tie"})
    all_docs = docs.select("id", "tie", F.size("words").cast("long").alias("n_words"))
    on = all_docs["id"].eqNullSafe(found["f_id"]) & all_docs["tie"].eqNullSafe(found["f_tie"])
    return all_docs.join(found, on, "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))).alias("score"),
    )
