"""Scalar functions by family, and where Spark's meaning differs from other engines'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import vectorblocks
from millrace.plans.registry import query
from millrace.session import Tables


@query("SELECT c_custkey, upper(c_name) AS up, substr(c_name, 3, 4) AS sub, replace(c_name, 'Customer', 'C') AS rep, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS lp, "
       "reverse(c_name) AS rv, concat_ws('-', c_mktsegment, c_name) AS cw, instr(c_name, '#') AS ps, split_part(c_name, '#', 2) AS sp, length(c_name) AS ln, "
       "levenshtein(c_mktsegment, 'BUILDING') AS lv, translate(c_mktsegment, 'AEI', 'aei') AS tr, repeat('ab', 3) AS rp, left(c_name, 4) AS lf FROM customer")  # fmt: skip
def scalar_strings(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey",
        F.upper("c_name").alias("up"),
        F.substring("c_name", 3, 4).alias("sub"),
        F.replace("c_name", F.lit("Customer"), F.lit("C")).alias("rep"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("lp"),
        F.reverse("c_name").alias("rv"),
        F.concat_ws("-", "c_mktsegment", "c_name").alias("cw"),
        F.instr("c_name", "#").cast("long").alias("ps"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("sp"),
        F.length("c_name").cast("long").alias("ln"),
        F.levenshtein("c_mktsegment", F.lit("BUILDING")).cast("long").alias("lv"),
        F.translate("c_mktsegment", "AEI", "aei").alias("tr"),
        F.repeat(F.lit("ab"), 3).alias("rp"),
        F.left("c_name", F.lit(4)).alias("lf"),
    )


@query(r"SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host, regexp_replace(url, '[0-9]+', 'N', 'g') AS masked, "
       r"len(regexp_extract_all(url, '[a-z]+')) AS runs, regexp_matches(url, 'utm_') AS tracked FROM pages")  # fmt: skip
def scalar_regex(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id",
        F.regexp_extract("url", "^(https?)://([^/?#]+)", 2).alias("host"),
        F.regexp_replace("url", "[0-9]+", "N").alias("masked"),
        F.size(F.regexp_extract_all("url", F.lit("[a-z]+"), 0)).cast("long").alias("runs"),
        F.regexp_like("url", F.lit("utm_")).alias("tracked"),
    )


@query("SELECT doc_id, md5(text) AS m, sha256(text) AS s, sha1(text) AS s1 FROM documents")
def scalar_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"), F.sha1("text").alias("s1"))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(quarter(ts) AS INTEGER) AS q, CAST(month(ts) AS INTEGER) AS m, date_trunc('hour', ts) AS h, "
       "CAST(dayofyear(ts) AS INTEGER) AS dy, last_day(ts) AS ld, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS dd, strftime(ts, '%Y-%m-%d') AS df, "
       "CAST(weekofyear(ts) AS INTEGER) AS wk, CAST(dayofweek(ts) + 1 AS INTEGER) AS dw, CAST(CAST(ts AS DATE) + 7 AS DATE) AS wk_on FROM events")  # fmt: skip
def scalar_dates(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        F.year(ts).alias("y"),
        F.quarter(ts).alias("q"),
        F.month(ts).alias("m"),
        F.date_trunc("hour", ts).cast("timestamp_ntz").alias("h"),
        F.dayofyear(ts).alias("dy"),
        F.last_day(ts).alias("ld"),
        F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).alias("dd"),
        F.date_format(ts, "yyyy-MM-dd").alias("df"),
        F.weekofyear(ts).alias("wk"),
        F.dayofweek(ts).alias("dw"),
        F.date_add(F.to_date(ts), 7).alias("wk_on"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 1) AS r, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, "
       "round(sqrt(l_quantity), 9) AS sq, round(ln(l_quantity), 9) AS lg, round(power(l_quantity, 2), 4) AS pw, round(log10(l_quantity), 9) AS l10, "
       "sign(l_discount - 0.05) AS sg, greatest(l_tax, l_discount) AS gr, least(l_tax, l_discount) AS le FROM lineitem")  # fmt: skip
def scalar_math(t: Tables) -> DataFrame:
    x, qty = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(x, 1).alias("r"), F.floor(x).alias("f"), F.ceil(x).alias("c"),
        F.round(F.sqrt(qty), 9).alias("sq"), F.round(F.ln(qty), 9).alias("lg"), F.round(F.pow(qty, F.lit(2)), 4).alias("pw"),
        F.round(F.log10(qty), 9).alias("l10"), F.signum(F.col("l_discount") - 0.05).cast("tinyint").alias("sg"),
        F.greatest("l_tax", "l_discount").alias("gr"), F.least("l_tax", "l_discount").alias("le"),
    )


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total, len(embedding) AS n, "
       "list_contains(embedding, embedding[3]) AS has3, len(list_filter(embedding, lambda x: x > 0)) AS pos, embedding[1:3] AS head FROM embeddings")  # fmt: skip
def scalar_arrays(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id",
        F.round(F.aggregate(F.transform(e, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"),
        F.size(e).cast("long").alias("n"),
        F.array_contains(e, F.element_at(e, 3)).alias("has3"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("pos"),
        F.slice(e, 1, 3).alias("head"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def scalar_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k BIGINT").getField("k").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scalar_variant(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT p_partkey, p_size AS a, p_brand AS b, p_size + 1 AS c FROM part")
def scalar_structs_maps(t: Tables) -> DataFrame:
    s = F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("b"))
    m = F.create_map(F.lit("next"), F.col("p_size") + 1)
    return t.part.select("p_partkey", s["a"].alias("a"), s["b"].alias("b"), m["next"].alias("c"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice / (o_custkey % 7) END AS d, TRY_CAST(o_orderpriority AS INTEGER) AS i, "
       "o_custkey % 7 AS m FROM orders")  # fmt: skip
def scalar_safe(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.try_divide("o_totalprice", F.col("o_custkey") % 7).alias("d"),
        F.col("o_orderpriority").try_cast("int").alias("i"),
        (F.col("o_custkey") % 7).alias("m"),
    )


@query("SELECT b.vec_id AS query_id, a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) + 0.0 AS dot, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS cos, "
       "round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0")  # fmt: skip
def vector_similarity(t: Tables) -> DataFrame:
    """Every pair of a query and a vector, by products of matrices; the result grows with the square of the table."""
    return vectorblocks.similarities(t.embeddings, t.embeddings.filter("vec_id % 100 = 0"), "vec_id", "embedding")


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'))) AS print, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM documents")
def text_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.fingerprint(F.col("text")).alias("print"), text.word_count(F.col("text")).alias("n"))
