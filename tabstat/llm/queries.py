"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstat.llm import decontaminate, html, jaccard, licenses, packing, quality, spread, substrings, suffixes, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "n_words", "shard", "bin", "place", "capacity")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(_read(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = spread.write_table(warc.write_packages(_read(spark, sf_dir, "pages")))
    out = warc.read_packages(packages)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.leak_digest(found).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.link_components(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_html_extraction, op3_warc, op4_url_filters, op5_decontamination, op6_ngram_jaccard_join,
    op7_substring_dedup, op8_suffix_array_dedup, op9_license_scan, op10_quality_rules,
)}

_BLANK = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

_TEMPLATES = ", ".join("('{}', '{}', '{}')".format(licenses.family(t[0]), *(x.replace("'", "''") for x in t)) for t in licenses.TEMPLATES)
_SHARE = 0.1 / 16384
#: The rules' counts and the hashed n-gram verdict of every document.
QUALITY_SQL = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY 1),
line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ 	-
]') GROUP BY 1),
word AS (SELECT doc_id, i, CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) AS x FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d)),
gram AS (SELECT doc_id, x % 16384 AS b FROM word UNION ALL SELECT doc_id, (x % 1048576 * 31 + y) % 16384 FROM (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM word) WHERE y IS NOT NULL),
target AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 20000),
c AS (SELECT b, count(*) AS r, count(target.doc_id) AS t FROM gram LEFT JOIN target USING (doc_id) GROUP BY 1),
dense AS (SELECT b, coalesce(r, 0) AS r, coalesce(t, 0) AS t, sum(coalesce(r, 0)) OVER () AS rs, sum(coalesce(t, 0)) OVER () AS ts FROM (SELECT unnest(range(16384)) AS b) LEFT JOIN c USING (b)),
weight AS (SELECT b, CASE WHEN ts = 0 THEN 0 ELSE CAST(round((ln(t::DOUBLE / ts + {_SHARE!r}::DOUBLE) - ln(r::DOUBLE / rs + {_SHARE!r}::DOUBLE)) * 1e6::DOUBLE) AS BIGINT) END AS w FROM dense),
score AS (SELECT doc_id, sum(w) AS s FROM gram JOIN weight USING (b) GROUP BY 1),
base AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(line.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
  len(ws) < 20 OR 100 * coalesce(again.n, 0) > 30 * len(ws) AS base_failed, coalesce(s, 0) >= -40000 * greatest(2 * len(ws) - 1, 0) AS good
  FROM d LEFT JOIN line USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN score USING (doc_id)),
judged AS (SELECT * EXCLUDE (good), NOT base_failed AND good AS kept FROM base)"""

ORACLE_SQL = {
    # The tables' pages mark their article and use these tags inside it.
    "op2_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split(regexp_replace(x, '</?(h1|p)>', chr(1), 'g'), chr(1)), lambda p: trim(regexp_replace(
  replace(replace(replace(replace(regexp_replace(p, '</?(b|br)>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS p FROM a)
SELECT page_id, url, array_to_string(list_filter(p, lambda x: x <> ''), chr(10) || chr(10)) AS text, CAST(length(array_to_string(list_filter(p, lambda x: x <> ''), chr(10) || chr(10))) AS BIGINT) AS n_chars FROM b""",
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM m""",
    "op4_url_filters": rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), {_UPPER}, {_LOWER}) AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(name, verdict, host, path) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
  ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
u AS (SELECT DISTINCT host, path FROM p),
listed AS (SELECT u.host, u.path, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict FROM u JOIN r
  ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY 1, 2),
tok AS (SELECT DISTINCT host, path, t FROM (
  SELECT host, path, 'h:' || x AS t FROM (SELECT host, path, unnest(string_split(host, '.')) AS x FROM u) WHERE x <> '' UNION ALL
  SELECT host, path, 'p:' || x FROM (SELECT host, path, unnest(regexp_split_to_array(lower(path), '[^\p{{L}}\p{{N}}]+')) AS x FROM u) WHERE x <> '')),
bad AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
known AS (SELECT row_number() OVER () AS k, host, path, bad FROM p JOIN bad USING (page_id) WHERE host <> ''),
least AS (SELECT greatest(ceil(0.001 * count(*)), 5) AS n FROM known),
kt AS (SELECT k, t, bad FROM known JOIN tok USING (host, path)),
one AS (SELECT k, [t] AS a, t AS top, bad FROM kt),
two AS (SELECT one.k, list_append(a, kt.t) AS a, kt.t AS top, one.bad FROM one JOIN kt ON one.k = kt.k AND kt.t > top),
three AS (SELECT two.k, list_append(a, kt.t) AS a, kt.t AS top, two.bad FROM two JOIN kt ON two.k = kt.k AND kt.t > top),
mined AS (SELECT a FROM (SELECT a, bad FROM one UNION ALL SELECT a, bad FROM two UNION ALL SELECT a, bad FROM three) GROUP BY a
  HAVING sum(bad) >= (SELECT n FROM least) AND sum(bad) >= 0.5 * count(*)),
own AS (SELECT host, path, list(t) AS ts FROM tok GROUP BY 1, 2),
hit AS (SELECT DISTINCT host, path FROM own, mined WHERE list_has_all(ts, a))
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN hit.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN listed ON p.host = listed.host AND p.path = listed.path LEFT JOIN hit ON p.host = hit.host AND p.path = hit.path""",
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_ALNUM}) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_ALNUM}) AS ws FROM benchmark),
bn AS (SELECT item, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bn)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
word AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op6_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_BLANK}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r.b AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) r ON r.a = d.doc_id""",
    "op7_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM late),
span AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE p IS NULL OR p < i - 1) AS spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM gone) GROUP BY 1),
byte AS (SELECT doc_id, i, substring(h, 2 * i + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY i) AS s FROM byte ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(s, ''))) AS kept_sha256
FROM d LEFT JOIN span USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_license_scan": rf"""
WITH t(fam, name, text) AS (VALUES {_TEMPLATES}),
tw AS (SELECT row_number() OVER () AS t, fam, name, regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), {_ALNUM}) AS ws FROM t),
ts AS (SELECT DISTINCT t, fam, name, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT t, fam, name, ws, unnest(range(1, len(ws) - 3)) AS i FROM tw)),
tm AS (SELECT t, count(*) AS m, greatest(8, CAST(pow(2, ceil(log2(2 * count(*)))) AS BIGINT)) AS w FROM ts GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_ALNUM}) AS ws FROM documents),
ds AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 4)) AS i FROM d)),
hit AS (SELECT doc_id, i, t, fam, name, g, m, w FROM ds JOIN ts USING (g) JOIN tm USING (t)),
win AS (SELECT doc_id, fam, name, t, a, m, w, count(DISTINCT g) AS n FROM (SELECT *, unnest(range(greatest(0, (i - w) // 4 * 4), i + 1, 4)) AS a FROM hit) WHERE a <= i AND i < a + w GROUP BY ALL),
full_ AS (SELECT * FROM win WHERE 100 * n >= 80 * m),
found AS (SELECT DISTINCT doc_id, name FROM full_ x WHERE NOT EXISTS (SELECT 1 FROM full_ y WHERE y.doc_id = x.doc_id AND y.fam = x.fam AND y.name <> x.name AND y.n * x.m > x.n * y.m AND y.a < x.a + x.w AND x.a < y.a + y.w)),
own AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS s FROM found GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(s, '') AS licenses FROM d LEFT JOIN own USING (doc_id)""",
    "op10_quality_rules": f"WITH {QUALITY_SQL} SELECT * FROM judged",
}
