"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_rules, jaccard, katz, line_dedup, packing, quality, suffix_dedup, url_rules, warc, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"), length=400))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), k=5, num=80, den=100)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=1024, special=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def remainder(modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), remainder(5) == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_words=1, most_bits=None)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), url_rules.QUERY_RULES)


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digest(winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(_table(spark, sf_dir, "documents"), held_out=remainder(10) == 0, min_count=1)


OP1 = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN f END AS refers_to
FROM r
"""

OP7 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
t AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, r.host || r.path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC) AS k
      FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.k = 1
"""

OP8 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM twice) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (SELECT count(*) - count(DISTINCT l) FROM (SELECT unnest(string_split(text, chr(10))) AS l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]'))::BIGINT AS n_dup_lines,
    (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]'))::BIGINT AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
e AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, n_symbols > 0.1 * n_words AS symbols, n_dup_lines > 0.5 * n_lines AS lines, word_chars < 3 * n_words OR word_chars > 10 * n_words AS letters FROM c),
f AS (SELECT *, short OR repeats OR symbols OR lines OR letters AS fails FROM e),
h AS (
  SELECT source, r, count(*) AS n, sum(x::INT) AS f
  FROM (SELECT source, unnest(['short', 'repeats', 'symbols', 'lines', 'letters', 'any']) AS r, unnest([short, repeats, symbols, lines, letters, fails]) AS x FROM f) GROUP BY ALL),
m AS (SELECT r, sum(f) / sum(n) AS p, sum(f * f / n) / sum(n) - power(sum(f) / sum(n), 2) - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS v FROM h GROUP BY r),
s AS (SELECT r, p, CASE WHEN v <= 0 THEN 1e6 ELSE least(1e6, greatest(10, p * (1 - p) / v - 1)) END AS s FROM m),
bad AS (SELECT DISTINCT source FROM h JOIN s USING (r) WHERE (f + p * s + 1e-9) / (n + s + 2e-9) > greatest(0.5, least(0.75, p + 3 * sqrt(p * (1 - p) / (s + 1)))))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT fails AND coalesce(source NOT IN (SELECT source FROM bad WHERE source IS NOT NULL), NOT EXISTS (SELECT 1 FROM bad WHERE source IS NULL)) AS kept
FROM f
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_suffix_dedup, op3_ngram_jaccard, op4_packing, op5_bradley_terry, op6_line_dedup, op7_url_rules, op8_host_rules, op9_katz, op10_winnowing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op7_url_rules": OP7, "op8_host_rules": OP8, "op10_winnowing": OP10}
