"""Further scalar functions by family, on column values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import Tables


@query("SELECT c_custkey, array_to_string(list_transform(string_split(c_name || ' ' || c_mktsegment, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS ic, "
       "left(c_name, 1) || 'XY' || substr(c_name, 5) AS ov, printf('%05d-%s', c_custkey, c_mktsegment) AS fs, "
       "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'BUILDING' THEN 'B435' WHEN 'FURNITURE' THEN 'F653' WHEN 'HOUSEHOLD' THEN 'H243' WHEN 'MACHINERY' THEN 'M256' END AS sx, "
       "lower(c_mktsegment) = 'building' AS eq, url_decode(url_encode(c_name || ' & ü/')) AS ud FROM customer")  # fmt: skip
def scalar_strings_more(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey",
        F.initcap(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("ic"),
        F.overlay("c_name", F.lit("XY"), 2, 3).alias("ov"),
        F.format_string("%05d-%s", "c_custkey", "c_mktsegment").alias("fs"),
        F.soundex("c_mktsegment").alias("sx"),
        (F.collate("c_mktsegment", "UTF8_LCASE") == F.collate(F.lit("Building"), "UTF8_LCASE")).alias("eq"),
        F.url_decode(F.url_encode(F.concat("c_name", F.lit(" & ü/")))).alias("ud"),
    )


@query(r"""
SELECT page_id, CASE WHEN well THEN regexp_extract(url, '^([a-z]+)://', 1) END AS protocol, CASE WHEN well THEN regexp_extract(url, '://([^/?#]*)', 1) END AS host,
       CASE WHEN well THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END AS path, CASE WHEN well THEN nullif(regexp_extract(url, '[?]([^#]*)', 1), '') END AS query
FROM (SELECT *, regexp_full_match(url, '[a-z]+://[a-z0-9.-]+(/[A-Za-z0-9/._-]*)?([?][A-Za-z0-9=&_.-]+)?') AS well FROM pages)
""")
def scalar_urls(t: Tables) -> DataFrame:
    """Parts of every page's URL, nulls where it isn't well formed."""
    well = F.regexp_like("url", F.lit("^[a-z]+://[a-z0-9.-]+(/[A-Za-z0-9/._-]*)?([?][A-Za-z0-9=&_.-]+)?$"))
    part = lambda name: F.when(well, F.try_parse_url("url", F.lit(name))).alias(name.lower())
    return t.pages.select("page_id", part("PROTOCOL"), part("HOST"), part("PATH"), part("QUERY"))


@query("SELECT c_custkey, c, x FROM customer JOIN (VALUES ('AUTOMOBILE', 3025255864, -397458929486201437), ('BUILDING', 660405656, -4774024506382391778), ('FURNITURE', 580895836, 5213815711692083559), ('HOUSEHOLD', 268513583, 623825489902674195), ('MACHINERY', 2018007539, 5510886111809640743)) v(seg, c, x) ON c_mktsegment = seg")
def scalar_checksums(t: Tables) -> DataFrame:
    """The values in the SQL are those of zlib's CRC-32 and of XXH64 with seed 42."""
    return t.customer.select("c_custkey", F.crc32(F.col("c_mktsegment").cast("binary")).alias("c"), F.xxhash64("c_mktsegment").alias("x"))


@query("SELECT event_id, CAST(ts AS DATE) + CAST(8 - isodow(ts) AS INTEGER) AS nd, "
       "round((year(ts) - 2024) * 12 + month(ts) - 1 + (day(ts) - 1) / 31.0, 6)::DOUBLE AS mb, date_trunc('minute', ts) AS tt, ts + INTERVAL 330 MINUTE AS tz, "
       "date_sub('hour', TIMESTAMP '2023-12-30 05:30:00', ts) AS td, CAST(isodow(ts) - 1 AS INTEGER) AS wd, CAST(ts AS DATE) - INTERVAL 2 MONTH AS ym, "
       "ts + INTERVAL 1 DAY + INTERVAL 90 SECOND AS dt FROM events")  # fmt: skip
def scalar_dates_more(t: Tables) -> DataFrame:
    ts = F.col("ts")
    minute = F.to_timestamp(F.date_format(ts, "yyyy/MM/dd HH:mm"), "yyyy/MM/dd HH:mm")
    return t.events.select(
        "event_id",
        F.next_day(ts, "MON").alias("nd"),
        F.round(F.months_between(F.to_date(ts), F.lit("2024-01-01").cast("date")), 6).alias("mb"),
        minute.cast("timestamp_ntz").alias("tt"),
        F.convert_timezone(F.lit("UTC"), F.lit("+05:30"), ts).alias("tz"),
        F.timestamp_diff("HOUR", F.lit("2023-12-30 05:30:00").cast("timestamp_ntz"), ts).alias("td"),
        F.weekday(ts).alias("wd"),
        (F.to_date(ts) - F.make_ym_interval(F.lit(0), F.lit(2))).cast("timestamp_ntz").alias("ym"),
        (ts + F.make_dt_interval(F.lit(1), F.lit(0), F.lit(0), F.lit(90))).alias("dt"),
    )


@query("SELECT p_partkey, round(log2(p_size), 9) AS l2, round(cbrt(p_size), 9) AS cb, round_even(p_size / 2.0, 0)::DOUBLE AS br, to_base(p_size, 2) AS cv, "
       "CAST(factorial(p_size % 10) AS BIGINT) AS fa, round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS hy, round(degrees(p_size), 9) AS dg, "
       "round(ln(p_retailprice), 9) AS ln, round(ln(p_retailprice) / ln(2), 9) AS lb, ((-p_size % 7) + 7) % 7 AS pm, "
       "CAST(least(greatest(floor((p_size - 10) / 5.0), -1), 4) + 1 AS BIGINT) AS wb FROM part")  # fmt: skip
def scalar_math_more(t: Tables) -> DataFrame:
    n, price = F.col("p_size"), F.col("p_retailprice")
    return t.part.select(
        "p_partkey",
        F.round(F.log2(n), 9).alias("l2"),
        F.round(F.cbrt(n), 9).alias("cb"),
        F.bround(n / 2.0, 0).alias("br"),
        F.conv(n.cast("string"), 10, 2).alias("cv"),
        F.factorial(n % 10).alias("fa"),
        F.round(F.hypot(n, price), 6).alias("hy"),
        F.round(F.degrees(n), 9).alias("dg"),
        F.round(F.log(price), 9).alias("ln"),
        F.round(F.log(2.0, price), 9).alias("lb"),
        F.pmod(-n, F.lit(7)).alias("pm"),
        F.width_bucket(n, F.lit(10), F.lit(30), F.lit(4)).alias("wb"),
    )


@query("SELECT p_partkey, list_reverse_sort([p_size % 3, p_size, 2]) AS sa, len(list_filter([p_size, p_size + 7], lambda x: x > 40)) > 0 AS ex, "
       "len(list_filter([p_size, p_size + 7], lambda x: x > 40)) = 2 AS fo, list_sort(list_filter(list_distinct([p_size, 1, 2]), lambda x: x <> 2 AND x <> 3)) AS ae, "
       "list_sort(list_distinct([p_size, 1, 2, 3])) AS au, [p_size + 10, 1 + 20] AS az, p_size + 1 + 2 AS rd, "
       "list_sort(list_filter(list_distinct([p_size, 1, 2]), lambda x: x = 2 OR x = 3)) AS ai FROM part")  # fmt: skip
def scalar_arrays_more(t: Tables) -> DataFrame:
    n = F.col("p_size")
    some, pair = F.array(n, F.lit(1), F.lit(2)), F.array(n, n + 7)
    zipped = F.arrays_zip(F.array(n, F.lit(1)).alias("a"), F.array(F.lit(10), F.lit(20)).alias("b"))
    return t.part.select(
        "p_partkey",
        F.sort_array(F.array(n % 3, n, F.lit(2)), asc=False).alias("sa"),
        F.exists(pair, lambda x: x > 40).alias("ex"),
        F.forall(pair, lambda x: x > 40).alias("fo"),
        F.array_sort(F.array_except(some, F.array(F.lit(2), F.lit(3)))).alias("ae"),
        F.array_sort(F.array_union(some, F.array(F.lit(2), F.lit(3)))).alias("au"),
        F.transform(zipped, lambda z: z["a"] + z["b"]).alias("az"),
        F.reduce(some, F.lit(0), lambda s, x: s + x).alias("rd"),
        F.array_sort(F.array_intersect(some, F.array(F.lit(2), F.lit(3)))).alias("ai"),
    )


@query("SELECT p_partkey, [p_size, p_size + 1] AS mc, [p_brand] AS me, CAST((p_size > 25) AS INTEGER) + CAST(p_size + 1 > 25 AS INTEGER) AS mf, ['A', 'B'] AS tk, "
       "[p_size * 2, (p_size + 1) * 2] AS tv, 2 AS n FROM part")  # fmt: skip
def scalar_maps_more(t: Tables) -> DataFrame:
    n = F.col("p_size")
    m = F.map_concat(F.create_map(F.lit("a"), n), F.create_map(F.lit("b"), n + 1))
    return t.part.select(
        "p_partkey",
        F.map_values(m).alias("mc"),
        F.map_values(F.map_from_entries(F.array(F.struct(n, F.col("p_brand"))))).alias("me"),
        F.size(F.map_filter(m, lambda k, v: v > 25)).alias("mf"),
        F.map_keys(F.transform_keys(m, lambda k, v: F.upper(k))).alias("tk"),
        F.map_values(F.transform_values(m, lambda k, v: v * 2)).alias("tv"),
        F.size(m).alias("n"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS jt, 'STRUCT<k: BIGINT>' AS sj, CAST(event_id % 9 AS INTEGER) AS ca, event_type AS cb, "
       "CAST(event_id % 9 AS INTEGER) AS xa, CAST(event_id % 9 AS INTEGER) AS xp, CAST(json_array_length('[' || event_id || ',' || user_id || ']') AS INTEGER) AS jl FROM events")  # fmt: skip
def scalar_semistructured(t: Tables) -> DataFrame:
    n = (F.col("event_id") % 9).cast("string")
    xml = F.concat(F.lit("<e><a>"), n, F.lit("</a><b>x</b></e>"))
    rows = t.events.select(
        "event_id",
        F.json_tuple("props", "k").alias("jt"),
        F.schema_of_json(F.lit('{"k": 0}')).alias("sj"),
        F.from_csv(F.concat_ws(",", n, F.col("event_type")), "a INT, b STRING").alias("csv"),
        F.from_xml(xml, "a INT, b STRING")["a"].alias("xa"),
        F.xpath_int(xml, F.lit("e/a")).alias("xp"),
        F.json_array_length(F.concat(F.lit("["), "event_id", F.lit(","), "user_id", F.lit("]"))).alias("jl"),
    )
    return rows.select("event_id", "jt", "sj", F.col("csv.a").alias("ca"), F.col("csv.b").alias("cb"), "xa", "xp", "jl")
