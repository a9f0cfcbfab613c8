"""Thin queries of toxicity, the conversation trie and hard negatives, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import negatives, toxicity, trie
from driftlens.llm.common import read


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(read(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(read(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce("text", '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ord(y) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS v FROM (SELECT DISTINCT c FROM t)),
h AS (SELECT c, xor(v, 4294967295) % 6 AS h, c - c % 100 AS f FROM bits),
parts AS (SELECT h.c, t.p AS o, r, x FROM h JOIN t ON t.c = h.f AND t.p < h.h UNION ALL SELECT t.c, t.p + 10, r, x FROM t JOIN h ON h.c = t.c AND t.p >= h.h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o) AS d, CAST(length(x) AS BIGINT) AS size, sha256(length(r) || ':' || r || x) AS id FROM parts),
seqs AS (SELECT h.c, coalesce(list(id ORDER BY d) FILTER (WHERE id IS NOT NULL), []) AS ids, coalesce(list(size ORDER BY d) FILTER (WHERE id IS NOT NULL), []) AS sizes FROM h LEFT JOIN d ON d.c = h.c GROUP BY h.c),
pre AS (SELECT c, k, list_slice(ids, 1, k) AS pre, k = len(ids) AS last, CASE WHEN k = 0 THEN 0 ELSE sizes[k] END AS size FROM (SELECT *, unnest(generate_series(0, len(ids))) AS k FROM seqs)),
nodes AS (SELECT pre, k, min(c) AS conv_id, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM pre GROUP BY pre, k),
kids AS (SELECT list_slice(pre, 1, k - 1) AS pre, count(*) AS kids FROM nodes WHERE k > 0 GROUP BY 1),
up AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids ON kids.pre = nodes.pre),
sums AS (SELECT top, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * size) AS saved FROM (SELECT list_slice(pre, 1, j) AS top, kids, n, size FROM (SELECT *, unnest(generate_series(0, k)) AS j FROM up)) GROUP BY top)
SELECT up.conv_id, CAST(up.k AS BIGINT) AS depth, p.conv_id AS parent_conv_id, up.n AS n_convs, CAST(up.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, up.ends AS ends_sha256
FROM up JOIN sums ON sums.top = up.pre LEFT JOIN nodes p ON up.k > 0 AND p.k = up.k - 1 AND p.pre = list_slice(up.pre, 1, up.k - 1)
"""

OP13_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
pos AS (SELECT * FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
neg AS (SELECT pos.a AS anchor_id, pos.b AS positive_id, CAST(row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, pos.s AS positive_score, s.s AS negative_score
  FROM pos JOIN s ON s.a = pos.a AND NOT s.same AND 30 * pos.s <= 100 * s.s AND 100 * s.s <= 90 * pos.s)
SELECT * FROM neg WHERE rank <= 10
"""

QUERIES = {"op11_toxicity": op11_toxicity, "op12_conversation_trie": op12_conversation_trie, "op13_hard_negatives": op13_hard_negatives}
SQL = {"op12_conversation_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL}
