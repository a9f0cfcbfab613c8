"""Thin queries of the operators on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import html_text, urls, warc
from driftlens.llm.common import read, scratch


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    titles = pages.select(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1).alias("title"))
    return urls.judge(pages, urls.unigrams(titles, "title"), keep=["page_id"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    found = warc.captures(warc.read(spark, path, payloads=False))
    field = lambda name: F.regexp_extract(F.col("metadata")[0]["fields"], rf"(?m)^{name}: (\S+)\r?$", 1)
    number = lambda text: F.when(text != "null", text).cast("long")
    refers = F.regexp_extract("answer.refers_to", r"^<urn:page:(-?\d+):\d+>$", 1)
    return found.select(
        number(field("page")).alias("page_id"), F.coalesce("answer.payload_bytes", field("payloadLength").cast("long")).alias("payload_bytes"), F.col("answer.payload_digest").alias("payload_digest"),
        F.col("answer.type").alias("record_type"), F.when(F.length(refers) > 0, refers).cast("long").alias("refers_to"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_url_filter": op6_url_filter, "op8_warc": op8_warc, "op9_html_text": op9_html_text}
OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages),
n AS (SELECT *, list_transform(generate_series(0, 7), lambda i: list_reduce(list_transform(generate_series(1, 5), lambda k: strpos('0123456789abcdef', substr(x, 5 * i + k, 1)) - 1), lambda a, b: a * 16 + b)) AS twenty FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(twenty, lambda v: array_to_string(list_transform([32768, 1024, 32, 1], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // d % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM n
"""
SQL: dict[str, str] = {"op8_warc": OP8_SQL}
