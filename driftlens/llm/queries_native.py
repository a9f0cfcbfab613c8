"""Thin queries of the native operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import decontaminate, quality, secrets
from driftlens.llm.common import checkpointed, read


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = checkpointed(quality.features(read(spark, sf_dir, "documents"), keep=["doc_id"]))  # a row of counts each, no text
    rows = quality.judged(scored, quality.fit(scored))
    return rows.select(F.col("_keep.doc_id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < 3)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(secrets.PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(secrets.said(base), 256).alias("base_sha256"), secrets.said(F.col("spans")).alias("spans"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = decontaminate.benchmark_windows(read(spark, sf_dir, "benchmark"))
    hits = decontaminate.window_hits(read(spark, sf_dir, "documents"), windows, keep=["doc_id"])
    items = F.array_join(F.array_sort("items"), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


OP10_SQL = r"""
WITH low AS (SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
grams AS (SELECT DISTINCT id AS item_id, least(len(ws), 13) AS n, list_slice(ws, i, i + least(len(ws), 13) - 1) AS g
  FROM (SELECT id, ws, unnest(generate_series(1, len(ws) - least(len(ws), 13) + 1)) AS i FROM w WHERE kind = 'b' AND len(ws) > 0)),
pos AS (SELECT id AS doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, (SELECT DISTINCT n FROM grams) WHERE kind = 'd' AND len(ws) >= n),
hits AS (SELECT doc_id, i, pos.n AS n, item_id FROM pos JOIN grams ON grams.n = pos.n AND g = list_slice(ws, i, i + pos.n - 1)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN cov ON cov.doc_id = w.id LEFT JOIN its ON its.doc_id = w.id WHERE kind = 'd'
"""

QUERIES = {"op3_quality_rules": op3_quality_rules, "op7_secret_scan": op7_secret_scan, "op10_decontaminate": op10_decontaminate}
SQL = {"op10_decontaminate": OP10_SQL}
