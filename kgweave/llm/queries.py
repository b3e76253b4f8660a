"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, line_dedup, mixing, nn_descent, quality_cnn, secret_scan, simhash, token_codes, token_rollup, toxicity
from .common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(spark, read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_digest(decontam.find_leaks(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_digest(simhash.near_duplicates(spark, read(spark, sf_dir, "documents")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(spark, read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintained_counts(spark, read(spark, sf_dir, "documents"), tokenizer_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(spark, read(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(spark, read(spark, sf_dir, "embeddings"))


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.round_trip(spark, read(spark, sf_dir, "documents"), tokenizer_path())


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_source_mixing": op4_source_mixing,
        "op5_toxicity": op5_toxicity,
        "op6_token_counts": op6_token_counts,
        "op7_line_dedup": op7_line_dedup,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_token_id_output": op9_token_id_output,
        "op10_quality_classifier": op10_quality_classifier,
    }


OP2_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
item AS (SELECT item_id, regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, letters WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM item WHERE len(ws) > 0)),
doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents, letters),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, sizes WHERE len(ws) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM gram g JOIN win w ON g.n = w.n AND g.gram = w.gram),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(w.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word w ON d.doc_id = w.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

#: {docs} is the table that is mixed.
MIX_SQL = r"""
d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM {docs}),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS DOUBLE) AS "full",
    CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, (sum(source_size) OVER ()) * CAST(1.5 AS DOUBLE) AS goal, coalesce(sum("full") OVER before, 0) AS spent,
    (sum(w) OVER ()) - coalesce(sum(w) OVER before, 0) AS "open"
  FROM s WINDOW before AS (ORDER BY "full" / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((goal - spent) / "open", "full" / w) AS level FROM o WHERE "full" >= (goal - spent) / "open" * w),
t AS (SELECT source, source_size, least("full", coalesce(level * w, "full")) AS target FROM o, l),
b AS (SELECT *, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) - n AS start FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS k FROM d),
mixed AS (
  SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, b.source_size, b.target,
    CAST(d.size * (b.base + CASE WHEN 2 * (c.start + (d.k - 1) * d.size) + d.size < 2 * (b.target - b.base * b.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
  FROM r AS d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h)
"""
OP4_SQL = "WITH " + MIX_SQL.format(docs="documents") + " SELECT * FROM mixed"

OP7_SQL = r"""
WITH d AS (SELECT doc_id, text, md5(coalesce(text, '')) AS k, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, k, i - 1 AS line, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
  FROM (SELECT doc_id, k, ls, unnest(range(1, len(ls) - 1)) AS i FROM d WHERE len(ls) >= 3)),
o AS (SELECT *, dense_rank() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, k, line) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, k, unnest([line, line + 1, line + 2]) AS line FROM o WHERE nth > 1),
l AS (SELECT doc_id, k, ls[i] AS x, i - 1 AS line FROM (SELECT DISTINCT doc_id, k, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
kept AS (
  SELECT l.doc_id, l.k, string_agg(l.x, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL) AS t, count(g.line) AS n_removed
  FROM l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.k = g.k AND l.line = g.line GROUP BY l.doc_id, l.k)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(coalesce(t, '')) AS kept_md5
FROM d LEFT JOIN kept ON d.doc_id IS NOT DISTINCT FROM kept.doc_id AND d.k = kept.k
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": OP2_SQL, "op4_source_mixing": OP4_SQL, "op7_line_dedup": OP7_SQL}
