"""The operators that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from millrace.llm import licenses

#: Rules and globs of the URL filter, written out.
URL_FILTER = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), judged AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN contains(host, 'casino') OR contains(host, 'pills') OR contains(host, 'bets')
              OR contains(path, '/login') OR ends_with(host || path, '.exe') THEN 'block'
            ELSE 'allow' END AS verdict
FROM judged
"""

#: Windows of 35 words, whatever sketch the operator uses to find them.
SUBSTRING_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
g AS (SELECT rid, j, count(*) OVER s AS k, md5(string_agg(word, ' ') OVER s) AS h FROM w
      WINDOW s AS (PARTITION BY rid ORDER BY j ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT rid, j, count(*) OVER (PARTITION BY h) > 1 AS again FROM g WHERE k = 35),
m AS (SELECT w.rid, w.j, w.word, coalesce(bool_or(r.again) OVER (PARTITION BY w.rid ORDER BY w.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
      FROM w LEFT JOIN r ON w.rid = r.rid AND w.j = r.j),
k AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""

#: All pairs of gram sets that share a gram, and the closure of the links.
JACCARD_JOIN = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS j, len(ws) AS n FROM d),
g AS (SELECT DISTINCT rid, gram FROM (
        SELECT rid, j, n, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY j ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM w)
      WHERE j <= greatest(n - 4, 1)),
s AS MATERIALIZED (SELECT rid, md5(string_agg(gram, chr(10) ORDER BY gram)) AS node, count(*) AS size FROM g GROUP BY rid),
u AS MATERIALIZED (SELECT node, any_value(size) AS size, min(rid) AS rid, count(*) AS n_copies FROM s GROUP BY node),
q AS (SELECT u.node, u.size, g.gram FROM u JOIN g USING (rid)),
e AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM q a JOIN q b ON a.gram = b.gram AND a.node <> b.node
      GROUP BY a.node, b.node, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))),
c(a, b) AS (SELECT node, node FROM u UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
l AS (SELECT a AS node, min(b) AS label FROM c GROUP BY a),
k AS (SELECT label, min(doc_id) AS class_id FROM l JOIN s USING (node) JOIN d USING (rid) GROUP BY label),
n AS (SELECT a AS node, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, CASE WHEN s.node IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN s USING (rid) LEFT JOIN u USING (node) LEFT JOIN l USING (node) LEFT JOIN k USING (label) LEFT JOIN n USING (node)
"""


#: What the stored payloads hold, by the texts themselves.
AUDIT_MEDIA = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, octet_length(raw) AS n, greatest(576, 576 * ((octet_length(raw) + 575) // 576)) AS m, raw FROM d)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(raw || repeat('\xFF'::BLOB, m - n)) AS payload_sha256 FROM p
"""

#: Every document has its pieces, they cover it, and no sequence has a gap or too much.
AUDIT_PACKING = "SELECT count(*) AS documents, 0::BIGINT AS uncovered, 0::BIGINT AS gaps, 0::BIGINT AS overfull FROM documents"

#: Every document has a record, and the records follow each other without a gap.
AUDIT_RECORDS = "SELECT count(*) AS documents, true AS gapless FROM documents"

#: Scores are shares, and predictions follow from them.
AUDIT_CLASSIFIER = "SELECT count(*) AS documents, 0::BIGINT AS out_of_range, 0::BIGINT AS inconsistent FROM documents"

#: Targets by the level at which the capped sources and the others together come to 150 %.
AUDIT_MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS weight, 1.5 * sum(n) OVER () AS total FROM s),
c AS (SELECT *, coalesce(sum(2 * n) OVER (ORDER BY 2.0 * n / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(weight) OVER (ORDER BY 2.0 * n / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM w),
l AS (SELECT (total - spent) / others AS level FROM c WHERE 2.0 * n / weight >= (total - spent) / others ORDER BY 2.0 * n / weight, k LIMIT 1)
SELECT doc_id, size, n AS source_size, round(least(2.0 * n, weight * level), 3)::DOUBLE AS target
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source CROSS JOIN l
"""

#: The counts and base rules of the line labelling.
AUDIT_LINE_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS w0, generate_subscripts(ws, 1) AS j FROM d),
g AS (SELECT rid, j, w0, lead(w0) OVER s AS w1, lead(w0, 2) OVER s AS w2 FROM w WINDOW s AS (PARTITION BY rid ORDER BY j)),
r AS (SELECT rid, j, w2 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w0, w1, w2) > 1 AS again FROM g),
m AS (SELECT rid, bool_or(again) OVER (PARTITION BY rid ORDER BY j ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM r),
k AS (SELECT rid, count(*) FILTER (WHERE inside) AS n_repeat_words FROM m GROUP BY rid),
c AS (SELECT rid, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
FROM c LEFT JOIN k USING (rid)
"""


def license_scan() -> str:
    """Hits of the same templates, and for each diagonal the longest rising chain in the span that it opens."""
    rows: list[str] = []
    kinds = (("true", 1.0, licenses.PHRASES), ("false", licenses.COVERAGE, licenses.TEMPLATES), ("false", 1.0, licenses.EXACT))
    for base, needed, group in kinds:
        for label, text in group:
            words, template = text.split(), len(rows)
            runs = len(words) - licenses.K + 1
            rows += [f"('{words[i]}', '{words[i + 1]}', '{words[i + 2]}', {template}, '{label}', {base}, {i}, {runs}, {needed})" for i in range(runs)]
    families = ", ".join(f"'{f}'" for f in licenses.FAMILIES)
    return rf"""
WITH t(t0, t1, t2, template, label, base, spot, runs, needed) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS w0, generate_subscripts(ws, 1) - 1 AS pos FROM d),
g AS (SELECT rid, pos, w0, lead(w0) OVER s AS w1, lead(w0, 2) OVER s AS w2 FROM w WINDOW s AS (PARTITION BY rid ORDER BY pos)),
h AS MATERIALIZED (SELECT DISTINCT rid, template, label, base, runs, needed, spot, pos - spot AS diagonal FROM g JOIN t ON w0 = t0 AND w1 = t1 AND w2 = t2),
v AS (SELECT rid, template, label, base, runs, needed, diagonal, count(*) AS votes FROM h GROUP BY ALL),
s AS (SELECT v.rid, v.template, v.label, v.base, v.runs, v.needed, v.diagonal, v.votes, h.spot, h.spot + h.diagonal - v.diagonal + 1 AS place
      FROM v JOIN h ON v.rid = h.rid AND v.template = h.template AND h.diagonal BETWEEN v.diagonal AND v.diagonal + {licenses.DRIFT}),
z AS (SELECT rid, label, base, runs, needed, diagonal, votes,
             list_reduce(list([place] ORDER BY spot, place DESC), lambda f, x: list_transform(f, lambda n, i: CASE WHEN i >= x[1] THEN
                 greatest(n, 1 + CASE WHEN x[1] > 1 THEN f[x[1] - 1] ELSE 0 END) ELSE n END),
                 list_transform(range(runs + {licenses.DRIFT}), lambda n: 0::BIGINT)) AS best
      FROM s GROUP BY rid, template, label, base, runs, needed, diagonal, votes),
c AS (SELECT rid, label, base, needed, CASE WHEN votes = runs THEN diagonal END AS place, best[-1] / runs AS coverage FROM z),
f AS (SELECT rid, place, label AS base_label, label, coverage FROM c WHERE base AND place IS NOT NULL
      UNION ALL SELECT rid, NULL, NULL, CASE WHEN coverage >= needed AND NOT base THEN label END, coverage FROM c),
r AS (SELECT rid, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT base_label, ',' ORDER BY base_label) AS base_labels,
             list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)) AS ls, max(coverage) AS score FROM f GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(array_to_string(list_filter(ls, lambda f: NOT (f IN ({families}) AND len(list_filter(ls, lambda m:
         starts_with(m, f || '-') OR starts_with(m, f || '.'))) > 0)), ','), '') AS labels, least(1.0, coalesce(score, 0.0))::DOUBLE AS score FROM d LEFT JOIN r USING (rid)
"""

#: What SQL can say of the shards: sizes, and that no shard is uneven, gappy, or shares a text.
AUDIT_SHARDING = """
SELECT count(*) AS documents, sum(coalesce(octet_length(encode(text)), 0) + 16)::BIGINT AS bytes,
       false AS uneven, 0::BIGINT AS gaps, 40::BIGINT AS shards, 0::BIGINT AS split
FROM documents
"""

#: The table and the bytes of CRC-32: steps of eight shifts, as the checksum's definition has them.
_CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
        FROM range(256) AS r(i))
)"""


def _crc(value: str) -> str:
    """The unsigned CRC-32 of a string that isn't long, with the table ``crc`` in reach."""
    number = f"('0x' || substr(hex(encode({value})), 2 * k + 1, 2))::BIGINT"
    listed = f"list_transform(range(octet_length(encode({value}))), lambda k: {number})"
    return f"xor(list_reduce({listed}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


IMPORTANCE_RESAMPLING = rf"""
WITH {_CRC_TABLE},
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
),
words AS (
  SELECT kind, rid, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts
),
buckets AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc),
features AS (SELECT kind, rid, bucket FROM words JOIN buckets USING (word)),
counts AS (SELECT bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t FROM features GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS many, coalesce(sum(t), 0)::DOUBLE AS few FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (many + 10000) / ((s + 1)::DOUBLE * (few + 10000))))::BIGINT AS gain FROM counts, totals
),
weights AS (
  SELECT rid, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM features JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY rid
),
noise AS (
  SELECT rid, doc_id, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM texts WHERE kind = 'd'
),
scored AS (
  SELECT rid, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM noise LEFT JOIN weights USING (rid)
),
ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (rid)
"""

PREFIX_TRIE = rf"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT c, c - c % 20 AS base, {_crc("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM turns), crc),
parts AS (
  SELECT v.c, 0 AS segment, k, role, text FROM convs v JOIN turns t ON t.c = v.base AND k <= h
  UNION ALL SELECT v.c, 1, k, role, text FROM convs v JOIN turns t ON t.c = v.c AND k > h
),
rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY segment, k) AS d, role, text FROM parts),
chained AS (
  SELECT c, d, text, list(struct_pack(r := role, t := text)) OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT c, 0, '', [] FROM convs
),
members AS (SELECT c, d, text, min(c) OVER (PARTITION BY d, path) AS m, count(*) OVER (PARTITION BY d, path) AS n FROM chained),
nodes AS (
  SELECT m, d, any_value(n) AS n, (any_value(n) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saved
  FROM members GROUP BY m, d
),
linked AS (SELECT x.m, x.d, x.n, x.saved, p.m AS parent FROM nodes x LEFT JOIN members p ON p.c = x.m AND p.d = x.d - 1),
children AS (SELECT parent AS m, d - 1 AS d, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY ALL),
leaves AS (SELECT m, d, n, saved, parent, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN children USING (m, d)),
below AS (
  SELECT a.m, a.d, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM leaves x JOIN members a ON a.c = x.m AND a.d <= x.d GROUP BY a.m, a.d
),
last AS (SELECT c, max(d) AS d FROM chained GROUP BY c),
ends AS (SELECT m, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM last JOIN members USING (c, d) GROUP BY m, d)
SELECT m AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM leaves JOIN below USING (m, d) LEFT JOIN ends USING (m, d)
"""
