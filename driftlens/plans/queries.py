"""Queries of the library's operators over the given tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions import names, text
from driftlens.operators import classify, facts, layout, linediff, moves, report, review, rollup, scopes
from driftlens.plans import compare, sinks
from driftlens.sources.stored import checkpointed
from driftlens.sources.trees import code_trees, document_trees

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return document_trees(read(spark, sf_dir, "documents"))


def codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return code_trees(read(spark, sf_dir, "documents"))


TREES = r"""
WITH d AS (SELECT doc_id AS i, source, text, list_extract(['c','h','arxml','a2l','py','yaml','json','txt'], CAST(doc_id % 8 + 1 AS INT)) AS ext FROM documents),
old AS (SELECT source || '/d' || i || '.' || ext AS rel, ext, text FROM d WHERE i % 50 <> 1),
new AS (SELECT CASE WHEN i % 50 = 2 THEN 'moved' ELSE source END || '/d' || i || '.' || ext AS rel, ext,
  CASE WHEN i % 50 = 2 THEN text || chr(10) || '// tail' WHEN i % 7 = 1 THEN text || chr(10) || '/* regenerated */' WHEN i % 7 = 2 THEN replace(text, ' ', '  ')
       WHEN i % 7 = 3 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN i % 7 = 4 THEN 'X' || text WHEN i % 7 = 5 THEN '// banner' || chr(10) || text ELSE text END AS text
  FROM d WHERE i % 50 <> 0),
u_old AS (SELECT rel, ext, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM old),
u_new AS (SELECT rel, ext, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM new)
"""
CODES = r"""
WITH d AS (SELECT doc_id AS i, text, 'm' || (doc_id // 2 % 200) AS m FROM documents),
k AS (SELECT d.*, s.k, (i + s.k * (i % 3)) % 13 AS p FROM d, (SELECT unnest([0, 1]) AS k) s WHERE i % 25 <> s.k),
side AS (SELECT k, i, m || '/' || m || '_f' || i || CASE WHEN i % 2 = 0 THEN '.c' ELSE '.a2l' END AS rel, m, i % 2 = 0 AS is_c, p,
  CASE WHEN i % 2 = 0 THEN '// Rte_Call_old_x' || chr(10) || 'v = Rte_Read_P' || p || '_Sig();' || chr(10) || 'Rte_Write_Q' || (i % 5) || '_Out(v); /* Rte_Mode_no */' || chr(10)
    || 'log("Rte_Pim_text"); rtb_Sum_c' || ((i + k) % 9) || ' = tmp_' || (i % 4) || ';' || chr(10) || text
  ELSE '/begin CHARACTERISTIC K_' || p || ' "/begin MEASUREMENT no" /* /begin MEASUREMENT no2 */' || chr(10) || '/begin measurement M_' || (i % 7) || chr(10) || text END AS text FROM k)
"""
#: A text without its comments, as SQL over tokens; {p} is a pattern whose comments begin with one of {c}.
STRIPPED = "array_to_string(list_transform(regexp_extract_all(text, '{p}', 0), lambda t: CASE WHEN {c} THEN regexp_replace(t, '[^\\n]', ' ', 'g') ELSE t END), '')"
C_STRIP = STRIPPED.format(p=r"""(?s)"(?:[^"\\\n]+|\\.)*(?:"|\n|\\?\z)|''(?:[^''\\\n]+|\\.)*(?:''|\n|\\?\z)|//[^\n]*|/\*.*?(?:\*/|\z)|[^"''/]+|/""", c="starts_with(t, ''//'') OR starts_with(t, ''/*'')".replace("''", "'"))
A2L_STRIP = STRIPPED.format(p=r"""(?s)"(?:""|[^"\n])*(?:"|\n|\z)|//[^\n]*|/\*.*?(?:\*/|\z)|[^"/]+|/""", c="starts_with(t, '//') OR starts_with(t, '/*')")
PY_STRIP = STRIPPED.format(p=r"""(?s)"(?:[^"\\\n]+|\\.)*(?:"|\n|\\?\z)|''(?:[^''\\\n]+|\\.)*(?:''|\n|\\?\z)|#[^\n]*|[^"''#]+""", c="starts_with(t, '#')")
SPACES = r"[\t\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapsed(t: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({t}, '{SPACES}+', ' ', 'g'), '(?m)^ ', '', 'g'), '(?m) $', '', 'g')"


@query(TREES + "SELECT coalesce(old.rel, new.rel) AS rel, CASE WHEN new.rel IS NULL THEN 'deleted' WHEN old.rel IS NULL THEN 'added' ELSE 'both' END AS side FROM old FULL OUTER JOIN new ON old.rel = new.rel")
def tree_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = compare.paired(*trees(spark, sf_dir))
    return pairs.select("rel", F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "added").otherwise("both").alias("side"))


LADDER = TREES + rf"""
, l AS (SELECT coalesce(o.rel, n.rel) AS rel, CASE WHEN n.rel IS NULL THEN 'deleted' WHEN o.rel IS NULL THEN 'added' WHEN o.text = n.text THEN 'identical' WHEN uo.text = un.text THEN 'line-endings'
    WHEN {collapsed('uo.text')} = {collapsed('un.text')} THEN 'whitespace' ELSE 'other' END AS step
  FROM old o FULL OUTER JOIN new n ON o.rel = n.rel LEFT JOIN u_old uo ON uo.rel = o.rel LEFT JOIN u_new un ON un.rel = n.rel)
"""


@query(LADDER + "SELECT rel, step FROM l")
def tree_status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = trees(spark, sf_dir)
    found = compare.statuses(old, new)
    collapsed = lambda c: text.collapse_ws(F.col(c))
    lines = compare.texts_of(found.where("status is null"), old, new).select("rel", F.when(collapsed("old_text") == collapsed("new_text"), "whitespace").otherwise("other").alias("step"))
    plain = found.where("status is not null").select("rel", F.when(F.col("status") == "ignorable-only", "line-endings").otherwise(F.col("status")).alias("step"))
    return plain.unionByName(lines)


@query(LADDER + "SELECT step, count(*) AS files FROM l GROUP BY step")
def tree_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_status_ladder(spark, sf_dir).groupBy("step").agg(F.count("*").alias("files"))


@query(TREES + """SELECT rel, CASE ext WHEN 'h' THEN 'c' WHEN 'py' THEN 'python' WHEN 'txt' THEN 'plain' ELSE ext END AS rules FROM new""")
def ruleset_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees(spark, sf_dir)[1].select("rel", text.ruleset(F.col("rel")).alias("rules"))


@query(TREES + r"""SELECT rel FROM new WHERE (regexp_matches(rel, '^.*\.c$') OR regexp_matches(rel, '^src1.*/d.\..*$') OR regexp_matches(rel, '(^|/)d[12][0-9]?\.a2l$')) AND NOT regexp_matches(rel, '^.*[37]\.c$')""")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees(spark, sf_dir)[1].where(text.selected(F.col("rel"), ["*.c", "src1*/d?.*", "d[12].a2l", "d[12][0-9].a2l"], ["*[37].c"])).select("rel")


@query(TREES + f"SELECT rel, sha256({collapsed('text')}) AS sha FROM u_new")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees(spark, sf_dir)[1].select("rel", F.sha2(text.collapse_ws(text.unix_lines(F.col("text"))), 256).alias("sha"))


@query(TREES + f"SELECT rel, sha256({collapsed('s')}) AS sha FROM (SELECT rel, CASE ext WHEN 'a2l' THEN {A2L_STRIP} WHEN 'py' THEN {PY_STRIP} ELSE {C_STRIP} END AS s FROM u_new WHERE ext IN ('c', 'h', 'a2l', 'py'))")
def comment_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trees(spark, sf_dir)[1].withColumn("rules", text.ruleset(F.col("rel"))).where(F.col("rules").isin("c", "a2l", "python"))
    return rows.select("rel", F.sha2(text.shadow(text.unix_lines(F.col("text")), F.col("rules")), 256).alias("sha"))


MARKED = "replace(replace(html, '<p>', '<p UUID = \"a' || page_id || '\"><DATE>2024-01-' || (page_id % 28) || '</DATE><SW-VERSION>1.' || page_id || '</SW-VERSION>'), '<h1>', '<DESC x=\"1\">some' || chr(10) || 'words</DESC><h1>')"


@query(rf"""
WITH t AS (SELECT page_id, {MARKED} AS text FROM pages),
b AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)<!--.*?-->|<DATE(?:\s[^>]*)?>[^<]*</DATE>|<SW-VERSION(?:\s[^>]*)?>[^<]*</SW-VERSION>|<DESC(?:\s[^>]*)?>.*?</DESC>|<|[^<]+', 0),
  lambda k: CASE WHEN regexp_matches(k, '^<.') THEN regexp_replace(k, '[^\n]', ' ', 'g') ELSE k END), '') AS text FROM t)
SELECT page_id, sha256({collapsed(r'''regexp_replace(text, '\bUUID\s*=\s*"[^"]*"', 'UUID=""', 'g')''')}) AS sha FROM b""")
def xml_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.expr(MARKED.replace("chr(10)", "char(10)")).alias("text"))
    return rows.select("page_id", F.sha2(text.xml_shadow(F.col("text")), 256).alias("sha"))


KEYWORD_LIST = ", ".join(f"'{k}'" for k in text.KEYWORDS)
TOKENS = r"""regexp_extract_all(text, '[A-Za-z_][\pL\pN_]*|0[xX][0-9a-fA-F]+[uUlL]*|\p{Nd}+\.?\p{Nd}*(?:[eE][+-]?\p{Nd}+)?[uUlLfF]*|"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|[^\t\n\x0B\f\r ]', 0)"""


@query(CODES + f"""SELECT rel, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(list_filter(t, lambda x: regexp_matches(x, '^[A-Za-z_][\\pL\\pN_]*$') AND x NOT IN ({KEYWORD_LIST})))) AS BIGINT) AS n_identifiers
FROM (SELECT rel, {TOKENS} AS t FROM side WHERE k = 0 AND is_c)""")
def tokenize_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes(spark, sf_dir)[0].where(F.col("rel").endswith(".c"))
    return rows.select("rel", F.size(text.tokenize(F.col("text"))).cast("long").alias("n_tokens"), F.size(text.identifiers(F.col("text"))).cast("long").alias("n_identifiers"))


@query(CODES + rf"""
, n AS (SELECT DISTINCT unnest({TOKENS}) AS name FROM side WHERE is_c), i AS (SELECT name FROM n WHERE regexp_matches(name, '^[A-Za-z_][\pL\pN_]*$')),
t AS (SELECT name, regexp_matches(name, '^(?:rtb|rtu|rty|rtDW|rtP|rtC|rtZC|rtPrevZC|localB|localDW|localP|localX|localZCE)_') AS owned, regexp_extract(name, '_([a-z0-9]+)$', 1) AS tail FROM i)
SELECT name, CASE WHEN owned THEN CASE WHEN regexp_matches(tail, '^[a-z][0-9]{{0,2}}$') OR regexp_matches(tail, '^[a-z0-9]{{8,12}}$') AND regexp_matches(tail, '[0-9]') THEN left(name, length(name) - length(tail) - 1) ELSE name END END AS root,
  regexp_matches(name, '^Rte_(?:Read|Write|Call|Mode|Pim)_[\pL\pN_]+$') OR regexp_matches(name, '^[A-Z][A-Z0-9_]*$') AS authored FROM t""")
def generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = codes(spark, sf_dir)
    rows = old.unionByName(new).where(F.col("rel").endswith(".c")).select(F.explode(text.tokenize(F.col("text"))).alias("name")).distinct().where(F.col("name").rlike(f"^{text.IDENT}$"))
    return rows.select("name", names.generated_root(F.col("name")).alias("root"), names.is_authored(F.col("name")).alias("authored"))


FACT_SQL = """
, x AS (SELECT k, rel, 'rte' AS fact_type, 'Rte_Pim_text' AS name, '' AS descr FROM side WHERE is_c UNION ALL SELECT k, rel, 'rte', 'Rte_Read_P' || p || '_Sig', '' FROM side WHERE is_c UNION ALL SELECT k, rel, 'rte', 'Rte_Write_Q' || (i % 5) || '_Out', '' FROM side WHERE is_c
  UNION ALL SELECT k, rel, 'a2l', 'K_' || p, 'CHARACTERISTIC' FROM side WHERE NOT is_c UNION ALL SELECT k, rel, 'a2l', 'M_' || (i % 7), 'MEASUREMENT' FROM side WHERE NOT is_c),
f AS (SELECT coalesce(a.rel, b.rel) AS rel, coalesce(a.fact_type, b.fact_type) AS fact_type, coalesce(a.name, b.name) AS name, CASE WHEN a.rel IS NULL THEN '+' ELSE '-' END AS change
  FROM (SELECT * FROM x WHERE k = 0) a FULL OUTER JOIN (SELECT * FROM x WHERE k = 1) b ON a.rel = b.rel AND a.fact_type = b.fact_type AND a.name = b.name WHERE a.rel IS NULL OR b.rel IS NULL)
"""


def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.fact_diff(*map(facts.text_facts, codes(spark, sf_dir)))


@query(CODES + FACT_SQL + "SELECT rel, name, change FROM f WHERE fact_type = 'rte'")
def rte_calls_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = codes(spark, sf_dir)
    return facts.fact_diff(facts.rte_facts(old), facts.rte_facts(new)).select("rel", "name", "change")


@query(CODES + FACT_SQL + "SELECT rel, name, change FROM f WHERE fact_type = 'a2l'")
def a2l_objects_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = codes(spark, sf_dir)
    return facts.fact_diff(facts.a2l_facts(old), facts.a2l_facts(new)).select("rel", "name", "change")


@query("""
WITH a AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 1),
b AS (SELECT o_custkey, o_orderpriority, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 2)
SELECT CAST(coalesce(a.o_custkey, b.o_custkey) AS VARCHAR) AS rel, coalesce(a.o_orderpriority, b.o_orderpriority) AS owner, CAST(coalesce(a.o_orderkey, b.o_orderkey) AS VARCHAR) AS name,
  CASE WHEN a.s IS NULL THEN '+' WHEN b.s IS NULL THEN '-' ELSE '~' END AS change, a.s AS old_descr, b.s AS descr
FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey = b.o_orderkey WHERE a.s IS DISTINCT FROM b.s""")
def fact_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("rel"), F.lit(True).alias("parsed"), F.lit("port").alias("fact_type"), F.col("o_orderpriority").alias("owner"), k.cast("string").alias("name"), F.col("o_orderstatus").alias("descr"), k.alias("k"))
    new = rows.where("k % 10 != 2").withColumn("descr", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("descr")))
    return facts.fact_diff(rows.where("k % 10 != 1").drop("k"), new.drop("k")).select("rel", "owner", "name", "change", "old_descr", "descr")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Added and deleted files: paths meet first, and texts follow for those that are alone."""
    old, new = trees(spark, sf_dir)
    alone = lambda t, other: t.join(t.select("rel").join(other.select("rel"), "rel", "left_anti"), "rel", "left_semi")
    return alone(new, old), alone(old, new)


SIDES = TREES + """
, added AS (SELECT * FROM u_new WHERE rel NOT IN (SELECT rel FROM old)), deleted AS (SELECT * FROM u_old WHERE rel NOT IN (SELECT rel FROM new))
"""


@query("WITH a AS (SELECT doc_id, source, text FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, source, text FROM documents WHERE doc_id % 2 = 1), x AS (SELECT sha1(text) AS h, count(*) AS n, min('n/d' || doc_id || '.txt') AS added_rel FROM a GROUP BY 1 HAVING count(*) = 1), y AS (SELECT sha1(text) AS h, count(*) AS n, min('o/d' || doc_id || '.txt') AS deleted_rel FROM b GROUP BY 1 HAVING count(*) = 1) SELECT added_rel, deleted_rel, CAST(1.0 AS DOUBLE) AS similarity FROM x JOIN y ON x.h = y.h")
def moves_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    files = lambda k, d: docs.where(i % 2 == k).select(F.concat(F.lit(d), i.cast("string"), F.lit(".txt")).alias("rel"), "text")
    return moves.exact(files(0, "n/d"), files(1, "o/d"))


SIMILAR = SIDES + f"""
, la AS (SELECT rel, ext, unnest(string_split({collapsed("CASE WHEN ext IN ('c', 'h') THEN " + C_STRIP + " WHEN ext = 'a2l' THEN " + A2L_STRIP + " ELSE text END")}, chr(10))) AS line FROM added),
ld AS (SELECT rel, ext, unnest(string_split({collapsed("CASE WHEN ext IN ('c', 'h') THEN " + C_STRIP + " WHEN ext = 'a2l' THEN " + A2L_STRIP + " ELSE text END")}, chr(10))) AS line FROM deleted),
ca AS (SELECT rel, ext, line, count(*) AS c, sum(count(*)) OVER (PARTITION BY rel) AS n FROM la WHERE line <> '' GROUP BY rel, ext, line), cd AS (SELECT rel, ext, line, count(*) AS c, sum(count(*)) OVER (PARTITION BY rel) AS n FROM ld WHERE line <> '' GROUP BY rel, ext, line),
sim AS (SELECT ca.rel AS added_rel, cd.rel AS deleted_rel, CAST(2.0 AS DOUBLE) * sum(least(ca.c, cd.c)) / (max(ca.n) + max(cd.n)) AS similarity FROM ca JOIN cd ON ca.ext = cd.ext AND ca.line = cd.line GROUP BY 1, 2 HAVING CAST(2.0 AS DOUBLE) * sum(least(ca.c, cd.c)) / (max(ca.n) + max(cd.n)) >= 0.6)
"""


@query(SIMILAR + "SELECT * FROM sim")
def move_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.similarities(*sides(spark, sf_dir))


@query(SIMILAR + """, r AS (SELECT *, max(similarity) OVER (PARTITION BY added_rel) AS ba, max(similarity) OVER (PARTITION BY deleted_rel) AS bd,
  coalesce(nth_value(similarity, 2) OVER (PARTITION BY added_rel ORDER BY similarity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS na,
  coalesce(nth_value(similarity, 2) OVER (PARTITION BY deleted_rel ORDER BY similarity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS nd FROM sim)
SELECT added_rel, deleted_rel, similarity FROM r WHERE similarity = ba AND similarity = bd AND similarity - na >= 0.1 AND similarity - nd >= 0.1""")
def moves_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.clear_best(moves.similarities(*sides(spark, sf_dir)))


@query(SIMILAR + """, xa AS (SELECT ext, sha1(text) AS h, min(rel) AS added_rel FROM (SELECT a.rel, a.ext, n.text FROM added a JOIN new n ON n.rel = a.rel) GROUP BY 1, 2 HAVING count(*) = 1),
xd AS (SELECT ext, sha1(text) AS h, min(rel) AS deleted_rel FROM (SELECT a.rel, a.ext, o.text FROM deleted a JOIN old o ON o.rel = a.rel) GROUP BY 1, 2 HAVING count(*) = 1),
ex AS (SELECT added_rel, deleted_rel, CAST(1.0 AS DOUBLE) AS similarity FROM xa JOIN xd ON xa.ext = xd.ext AND xa.h = xd.h),
rest AS (SELECT * FROM sim WHERE added_rel NOT IN (SELECT added_rel FROM ex) AND deleted_rel NOT IN (SELECT deleted_rel FROM ex)),
r AS (SELECT *, max(similarity) OVER (PARTITION BY added_rel) AS ba, max(similarity) OVER (PARTITION BY deleted_rel) AS bd,
  coalesce(nth_value(similarity, 2) OVER (PARTITION BY added_rel ORDER BY similarity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS na,
  coalesce(nth_value(similarity, 2) OVER (PARTITION BY deleted_rel ORDER BY similarity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS nd FROM rest)
SELECT * FROM ex UNION ALL SELECT added_rel, deleted_rel, similarity FROM r WHERE similarity = ba AND similarity = bd AND similarity - na >= 0.1 AND similarity - nd >= 0.1""")
def moves_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.find(*sides(spark, sf_dir))


@query(TREES + """
, a AS (SELECT rel, line, count(*) AS c, min(no) AS no FROM (SELECT rel, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM u_old) GROUP BY rel, line HAVING count(*) = 1),
b AS (SELECT rel, line, count(*) AS c, min(no) AS no FROM (SELECT rel, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM u_new) GROUP BY rel, line HAVING count(*) = 1)
SELECT a.rel, CAST(a.no AS INT) AS old_no, CAST(b.no AS INT) AS new_no FROM a JOIN b ON a.rel = b.rel AND a.line = b.line""")
def unique_line_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = trees(spark, sf_dir)
    pairs = compare.paired(*(t.withColumn("text", text.unix_lines(F.col("text"))) for t in (old, new))).where("in_old and in_new")
    return linediff.unique_line_anchors(pairs)


HUNKS = """
WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS rel, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn, CAST(l_quantity AS BIGINT) AS q, CAST(l_partkey AS BIGINT) AS p, l_returnflag AS f FROM lineitem),
h AS (SELECT rel, CASE f WHEN 'R' THEN 'real' WHEN 'A' THEN 'uuid' ELSE CASE WHEN q % 2 = 0 THEN 'comment' ELSE 'moved' END END AS kind, 14 * rn + q % 7 AS i1, 14 * rn + q % 7 + p % 4 AS i2, 14 * rn + q % 5 AS j1, 14 * rn + q % 5 + (p + q) % 4 AS j2 FROM r)
"""


def line_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hunk table made from lineitem: files are orders."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    r = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("rel"), F.row_number().over(w).cast("long").alias("rn"), F.col("l_quantity").cast("long").alias("q"), F.col("l_partkey").cast("long").alias("p"), F.col("l_returnflag").alias("f"))
    rn, q, p = F.col("rn"), F.col("q"), F.col("p")
    kind = F.when(F.col("f") == "R", "real").when(F.col("f") == "A", "uuid").when(q % 2 == 0, "comment").otherwise("moved")
    return r.select("rel", kind.alias("kind"), (14 * rn + q % 7).alias("i1"), (14 * rn + q % 7 + p % 4).alias("i2"), (14 * rn + q % 5).alias("j1"), (14 * rn + q % 5 + (p + q) % 4).alias("j2"))


@query(HUNKS + "SELECT *, CAST(sum(i1 - b + m) OVER (PARTITION BY rel ORDER BY i1, j1 ROWS UNBOUNDED PRECEDING) - m AS BIGINT) AS row_start FROM (SELECT *, coalesce(lag(i2) OVER (PARTITION BY rel ORDER BY i1, j1), 0) AS b, greatest(i2 - i1, j2 - j1) AS m FROM h)".replace("SELECT *, CAST", "SELECT rel, kind, i1, i2, j1, j2, CAST"))
def hunk_row_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_starts(line_hunks(spark, sf_dir))


@query(HUNKS + "SELECT rel, kind, i1, i2, j1, j2, CAST(sum(n) OVER (PARTITION BY rel ORDER BY i1, j1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM (SELECT *, CASE WHEN i1 - lag(i2) OVER (PARTITION BY rel ORDER BY i1, j1) <= 6 THEN 0 ELSE 1 END AS n FROM h)")
def hunk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.context_groups(line_hunks(spark, sf_dir))


FOCUS = HUNKS + """, l AS (SELECT rel, i1 - 3 AS lo, greatest(i2, i1 + 1) + 3 AS hi FROM h WHERE kind IN ('real', 'moved')),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY rel ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM l),
g AS (SELECT *, sum(n) OVER (PARTITION BY rel ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS win FROM m),
v AS (SELECT rel, win, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY rel, win)
"""


@query(FOCUS + """SELECT h.rel, kind, i1, i2, j1, j2, coalesce(CAST(min(win) AS BIGINT), -1) AS win, min(win) IS NULL AND max(CASE WHEN kind IN ('real', 'moved') THEN 1 ELSE 0 END) OVER (PARTITION BY h.rel) = 1 AS lean
FROM h LEFT JOIN v ON h.rel = v.rel AND i1 < hi AND greatest(i2, i1 + 1) > lo GROUP BY h.rel, kind, i1, i2, j1, j2""")
def focus_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.focus(line_hunks(spark, sf_dir)).withColumn("win", F.coalesce("win", F.lit(-1)))


@query(HUNKS + """SELECT rel, kind, i1, i2, j1, j2, coalesce(lead(i1) OVER w, first_value(i1) OVER (PARTITION BY rel ORDER BY i1, j1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_i1,
coalesce(lag(i1) OVER w, last_value(i1) OVER (PARTITION BY rel ORDER BY i1, j1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_i1 FROM h WHERE kind IN ('real', 'moved') WINDOW w AS (PARTITION BY rel ORDER BY i1, j1)""")
def hunk_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.stops(line_hunks(spark, sf_dir))


@query(HUNKS + """, a AS (SELECT rel, kind, i1 + 12 AS i1, i2 + 12 AS i2, j1 + 12 AS j1, j2 + 12 AS j2 FROM h) SELECT a.rel, a.i1, a.i2, b.i1 AS r1, b.i2 AS r2 FROM a JOIN h b ON a.rel = b.rel AND a.kind <> 'real' AND b.kind = 'real'
AND ((a.i1 < b.i2 AND b.i1 < a.i2) OR (a.i1 = a.i2 AND b.i1 <= a.i1 AND a.i1 <= b.i2) OR (b.i1 = b.i2 AND a.i1 <= b.i1 AND b.i1 <= a.i2)
  OR (a.j1 < b.j2 AND b.j1 < a.j2) OR (a.j1 = a.j2 AND b.j1 <= a.j1 AND a.j1 <= b.j2) OR (b.j1 = b.j2 AND a.j1 <= b.j1 AND b.j1 <= a.j2))""")
def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = line_hunks(spark, sf_dir)
    later = h.withColumns({c: F.col(c) + 12 for c in ("i1", "i2", "j1", "j2")})
    return linediff.meeting(later.where("kind != 'real'"), h.where("kind = 'real'")).select("a.rel", "a.i1", "a.i2", F.col("b.i1").alias("r1"), F.col("b.i2").alias("r2"))


PAGE_STATUS = "CASE page_id % 11 WHEN 0 THEN 'real-change' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' WHEN 3 THEN 'ignorable-only' WHEN 4 THEN 'comment-only' ELSE 'identical' END"


@query(rf"""
WITH f AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS rel, {PAGE_STATUS} AS status FROM pages), p AS (SELECT rel, status, string_split(rel, '/') AS parts FROM f),
x AS (SELECT array_to_string(list_slice(parts, 1, n), '/') AS dir, rel, status, CASE status WHEN 'real-change' THEN 4 WHEN 'added' THEN 2 WHEN 'deleted' THEN 2 WHEN 'ignorable-only' THEN 1 WHEN 'comment-only' THEN 0 ELSE -1 END AS pr
  FROM (SELECT rel, status, parts, unnest(generate_series(0, len(parts) - 1)) AS n FROM p)), o AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY -pr, rel, status) AS rn, count(*) OVER (PARTITION BY dir) AS files FROM x)
SELECT dir, files, CAST(pr AS INT) AS priority, status FROM o WHERE rn = 1""")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.directory_rollup(read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("rel"), F.expr(PAGE_STATUS).alias("status")))


CODE_STATUS = "CASE WHEN substr(md5(rel), 1, 1) IN ('0', '1', '2', '3') THEN 'real-change' ELSE 'identical' END"


def code_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results of the code trees by equality of text, and their model groups."""
    res = compare.statuses(*codes(spark, sf_dir)).select("rel", F.coalesce("status", F.lit("real-change")).alias("status"), F.lit(False).alias("binary"), F.lit(True).alias("has_facts"))
    # A model's own C file, so that each folder is a model; its files are named after it.
    own = res.select(F.split("rel", "/")[0].alias("m")).distinct().select(F.concat("m", F.lit("/"), "m", F.lit(".c")).alias("rel"), F.lit("identical").alias("status"), F.lit(False).alias("binary"), F.lit(True).alias("has_facts"))
    res = res.unionByName(own)
    return res, checkpointed(rollup.model_groups(res.select("rel")))


CODE_RESULTS = CODES + """
, q AS (SELECT coalesce(a.rel, b.rel) AS rel, CASE WHEN b.rel IS NULL THEN 'deleted' WHEN a.rel IS NULL THEN 'added' WHEN a.text = b.text THEN 'identical' ELSE 'real-change' END AS status FROM (SELECT * FROM side WHERE k = 0) a FULL OUTER JOIN (SELECT * FROM side WHERE k = 1) b ON a.rel = b.rel),
res AS (SELECT rel, status FROM q UNION ALL SELECT DISTINCT split_part(rel, '/', 1) || '/' || split_part(rel, '/', 1) || '.c', 'identical' FROM q),
st AS (SELECT rel, status, regexp_replace(split_part(rel, '/', 2), '\\.[^.]*$', '') AS stem FROM res), cand AS (SELECT DISTINCT stem AS model FROM st WHERE lower(rel) LIKE '%.c'),
own AS (SELECT rel, status, model, row_number() OVER (PARTITION BY rel ORDER BY length(model) DESC, model DESC) AS rn FROM st JOIN cand ON stem = model OR starts_with(stem, model || '_') OR stem = 'Rte_' || model),
g0 AS (SELECT rel, status, model FROM own WHERE rn = 1), big AS (SELECT model FROM g0 GROUP BY model HAVING count(*) >= 3),
g AS (SELECT res.rel, res.status, CASE WHEN g0.model IN (SELECT model FROM big) THEN g0.model ELSE 'Shared / other' END AS model FROM res LEFT JOIN g0 ON g0.rel = res.rel)
"""


@query(CODE_RESULTS + "SELECT rel, model FROM g")
def model_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_results(spark, sf_dir)[1]


@query(CODE_RESULTS + "SELECT model, count(*) AS files, count(*) FILTER (status = 'identical') AS identical, count(*) FILTER (status = 'comment-only') AS comment_only, count(*) FILTER (status = 'ignorable-only') AS ignorable_only, count(*) FILTER (status = 'real-change') AS real_change, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'error') AS error FROM g GROUP BY model")
def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.model_counts(*code_results(spark, sf_dir))


@query(CODE_RESULTS + FACT_SQL.replace(", f AS", ", f AS") + "SELECT model, fact_type, count(*) FILTER (change = '+') AS added, count(*) FILTER (change = '-') AS removed, count(*) FILTER (change = '~') AS changed FROM f JOIN g ON f.rel = g.rel GROUP BY model, fact_type")
def model_fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fact_counts(code_facts(spark, sf_dir), code_results(spark, sf_dir)[1])


@query(CODE_RESULTS + FACT_SQL + """
, fa AS (SELECT rel, bool_or(fact_type = 'a2l') AS a2l_moved, bool_or(fact_type = 'rte' AND change = '+') AS rte_added FROM f GROUP BY rel),
per AS (SELECT model, bool_or(g.rel LIKE '%.c') AS has_c, bool_or(g.rel LIKE '%.c' AND status <> 'identical') AS c_changed, bool_or(g.rel LIKE '%.a2l' AND coalesce(a2l_moved, false)) AS a2l, bool_or(coalesce(rte_added, false)) AS rte FROM g LEFT JOIN fa ON fa.rel = g.rel WHERE model <> 'Shared / other' GROUP BY model)
SELECT model, 'A2L changed but the generated C did not' AS message FROM per WHERE has_c AND NOT c_changed AND a2l
UNION ALL SELECT model, 'gained an RTE access while a peer model stayed identical -- regenerate the architecture before integrating' FROM per WHERE rte AND EXISTS (SELECT 1 FROM per WHERE has_c AND NOT c_changed)""")
def model_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.advisories(*code_results(spark, sf_dir), code_facts(spark, sf_dir))


RESULTS_SQL = LADDER + ", r AS (SELECT rel, CASE step WHEN 'line-endings' THEN 'ignorable-only' WHEN 'whitespace' THEN 'ignorable-only' WHEN 'other' THEN 'real-change' ELSE step END AS status FROM l) "


def plain_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by equality and white space alone."""
    step = F.col("step")
    status = F.when(step.isin("line-endings", "whitespace"), "ignorable-only").when(step == "other", "real-change").otherwise(step)
    return tree_status_ladder(spark, sf_dir).select("rel", status.alias("status"), F.lit(False).alias("binary"), F.array().cast("array<string>").alias("notes"), compare.no_renames().alias("renames"), compare.no_hunks().alias("hunks"))


@query(RESULTS_SQL + "SELECT count(*) FILTER (status = 'identical') AS identical, CAST(0 AS BIGINT) AS comment_only, count(*) FILTER (status = 'ignorable-only') AS ignorable_only, count(*) FILTER (status = 'real-change') AS real_change, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'deleted') AS deleted, CAST(0 AS BIGINT) AS error FROM r")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.status_summary(plain_results(spark, sf_dir))


@query(RESULTS_SQL + "SELECT rel, CASE WHEN status = 'ignorable-only' THEN 'identical' ELSE status END AS status, CASE WHEN status = 'ignorable-only' THEN 'folded: ignorable-only' ELSE '' END AS note FROM r")
def fold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fold(plain_results(spark, sf_dir), ("ignorable-only", "added")).select("rel", "status", F.array_join("notes", "; ").alias("note"))


@query(RESULTS_SQL + "SELECT CAST(CASE WHEN count(*) FILTER (status IN ('real-change', 'added', 'deleted')) > 0 THEN 1 ELSE 0 END AS INT) AS exit_code FROM r")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.exit_code(plain_results(spark, sf_dir))


@query(RESULTS_SQL + "SELECT rel, status AS rule_id, 'warning' AS level, CASE status WHEN 'added' THEN 'Added' WHEN 'deleted' THEN 'Deleted' ELSE 'Modified: 0 hunk(s)' END AS message FROM r WHERE status IN ('added', 'deleted', 'real-change')")
def sarif_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.findings(plain_results(spark, sf_dir))


@query(TREES + "SELECT rel, left(sha1('file' || chr(0) || status || chr(0) || text || chr(0)), 16) || '#0' AS unit_key, 'whole file' AS label FROM (SELECT rel, 'added' AS status, text FROM new WHERE rel NOT IN (SELECT rel FROM old) UNION ALL SELECT rel, 'deleted', text FROM old WHERE rel NOT IN (SELECT rel FROM new))")
def review_file_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    added, deleted = sides(spark, sf_dir)
    files = added.withColumn("status", F.lit("added")).unionByName(deleted.withColumn("status", F.lit("deleted")))
    return review.file_units(files).select("rel", "unit_key", "label")


@query(HUNKS + "SELECT rel, kind || '-' || (i2 - i1) AS d, i1 AS hunk_idx, kind || '-' || (i2 - i1) || '#' || (row_number() OVER (PARTITION BY rel, kind || '-' || (i2 - i1) ORDER BY i1) - 1) AS unit_key FROM h")
def review_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = line_hunks(spark, sf_dir)
    return review.with_ordinals(h.select("rel", F.concat("kind", F.lit("-"), (F.col("i2") - F.col("i1")).cast("string")).alias("d"), F.col("i1").alias("hunk_idx")))


@query(HUNKS + "SELECT rel, count(*) AS units, count(*) FILTER (i1 % 3 = 0) AS reviewed, count(*) = count(*) FILTER (i1 % 3 = 0) AS done FROM (SELECT DISTINCT rel, i1 FROM h) GROUP BY rel")
def review_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = line_hunks(spark, sf_dir).select("rel", F.col("i1").cast("string").alias("unit_key")).distinct()
    entries = units.where(F.col("unit_key").cast("long") % 3 != 1).select("rel", "unit_key", F.lit("seen").alias("note"), (F.col("unit_key").cast("long") % 3 == 0).alias("reviewed"))
    return review.tally(units, entries)


def changed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = trees(spark, sf_dir)
    return compare.texts_of(compare.statuses(old, new).where("status is null"), old, new)


@query()
def hunks_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linediff.hunks(changed_pairs(spark, sf_dir)).select("rel", F.explode("ranges").alias("r")).select("rel", "r.*")


@query()
def classify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full results of the document trees."""
    res = compare.scan_texts(*trees(spark, sf_dir))
    return res.select("rel", "status", F.size("hunks").alias("n_hunks"), names.kinds_said(F.transform("hunks", lambda h: h["kind"])).alias("noise"), F.array_join("notes", "; ").alias("notes"))


@query()
def classify_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of the code trees, whose generated names and access points change."""
    res = compare.scan_texts(*codes(spark, sf_dir))
    return res.select("rel", "status", F.explode_outer("hunks").alias("h")).select("rel", "status", "h.*")


@query()
def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.aligned_rows(classify.classified(changed_pairs(spark, sf_dir), texts=True))


@query()
def review_hunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.hunk_units(classify.classified(changed_pairs(spark, sf_dir), texts=True))


@query()
def linked_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = trees(spark, sf_dir)
    return compare.linked_moves(compare.statuses(old, new), old, new).select("added_rel", "deleted_rel", "similarity", "move_status", F.size("hunks").alias("n_hunks"))


@query(r"""
WITH p AS (SELECT p_partkey AS k, '/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS pkg FROM part)
SELECT 'p' || k || '.arxml' AS rel, true AS parsed, 'iface' AS fact_type, NULL AS owner, pkg || '/If' || k AS name, 'SENDER-RECEIVER-INTERFACE' AS descr FROM p WHERE k % 2 = 0
UNION ALL SELECT 'p' || k || '.arxml', true, 'swc', NULL, pkg || '/C' || k, '' FROM p WHERE k % 2 = 1
UNION ALL SELECT 'p' || k || '.arxml', true, 'port', pkg || '/C' || k, 'Out', 'P-PORT If' || (k - 1) FROM p WHERE k % 2 = 1""")
def xml_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of XML files made from the part table: a package per brand, an interface or component per part."""
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    body = F.when(key % 2 == 0, F.format_string("<SENDER-RECEIVER-INTERFACE><SHORT-NAME>If%d</SHORT-NAME></SENDER-RECEIVER-INTERFACE>", key)).otherwise(
        F.format_string("<APPLICATION-SW-COMPONENT-TYPE><SHORT-NAME>C%d</SHORT-NAME><PORTS><P-PORT-PROTOTYPE><SHORT-NAME>Out</SHORT-NAME><PROVIDED-INTERFACE-TREF>/B/If%d</PROVIDED-INTERFACE-TREF></P-PORT-PROTOTYPE></PORTS></APPLICATION-SW-COMPONENT-TYPE>", key, key - 1))
    files = p.select(F.concat(F.lit("p"), key.cast("string"), F.lit(".arxml")).alias("rel"), F.concat(F.lit('<AUTOSAR xmlns="u"><AR-PACKAGE><SHORT-NAME>'), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.lit("</SHORT-NAME>"), body, F.lit("</AR-PACKAGE></AUTOSAR>")).alias("text"))
    return facts.xml_facts(files)


@query(RESULTS_SQL + """SELECT rel, '{"path":"' || rel || '","status":"' || status || '","binary":false}' AS entry FROM r""")
def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.file_entries(plain_results(spark, sf_dir))


@query()
def json_entries_with_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, findings and shown lines of the full comparison."""
    res = checkpointed(compare.scan_texts(*trees(spark, sf_dir)))
    return sinks.file_entries(res).join(sinks.findings(res).select("rel", "message"), "rel", "left")


@query()
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the report's groups, placeholders and notes of moved blocks."""
    judged = checkpointed(classify.classified(changed_pairs(spark, sf_dir), texts=True))
    hunks = judged.select("rel", F.posexplode("hunks").alias("hunk_idx", "h")).select("rel", "hunk_idx", "h.*")
    return report.shown_rows(layout.aligned_rows(judged), report.hunk_groups(hunks))


PAGE_FILES = rf"WITH r AS (SELECT regexp_replace(url, '^[a-z]+://', '') || '#' || page_id AS rel, {PAGE_STATUS} AS status FROM pages)"


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("#"), F.col("page_id").cast("string")).alias("rel"), F.expr(PAGE_STATUS).alias("status"))


@query(PAGE_FILES + r""", f AS (SELECT * FROM r WHERE contains(lower(rel), '/en') AND status <> 'identical'),
p AS (SELECT DISTINCT rel, status, array_to_string(list_slice(string_split(rel, '/'), 1, n), '/') AS dir FROM (SELECT rel, status, unnest(generate_series(1, len(string_split(rel, '/')) - 1)) AS n FROM f)),
d AS (SELECT dir, max(CASE status WHEN 'real-change' THEN 4 WHEN 'added' THEN 2 WHEN 'deleted' THEN 2 WHEN 'ignorable-only' THEN 1 ELSE 0 END) AS pr, max(CASE status WHEN 'deleted' THEN 1 ELSE 0 END) AS del FROM p GROUP BY dir)
SELECT dir AS path, regexp_replace(dir, '/?[^/]*$', '') AS parent, CAST(len(string_split(dir, '/')) AS INT) AS depth, true AS is_dir,
  CASE pr WHEN 4 THEN 'real-change' WHEN 2 THEN CASE WHEN del = 1 THEN 'deleted' ELSE 'added' END WHEN 1 THEN 'ignorable-only' ELSE 'comment-only' END AS status FROM d
UNION ALL SELECT rel, regexp_replace(rel, '/?[^/]*$', ''), CAST(len(string_split(rel, '/')) AS INT), false, status FROM f""")
def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.nodes(page_results(spark, sf_dir), " /EN ", hide_identical=True)


@query(PAGE_FILES + "SELECT rel, status, CAST(CASE status WHEN 'real-change' THEN 0 WHEN 'ignorable-only' THEN 1 WHEN 'added' THEN 2 ELSE 3 END AS INT) AS place FROM r WHERE status NOT IN ('identical', 'comment-only')")
def detail_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.detail_order(page_results(spark, sf_dir))


@query(PAGE_FILES + r""", f AS (SELECT regexp_replace(rel, '/?[^/]*$', '') AS folder, rel FROM r WHERE status IN ('real-change', 'added', 'deleted'))
SELECT folder, rel, coalesce(lead(rel) OVER w, min(rel) OVER (PARTITION BY folder)) AS next_rel, coalesce(lag(rel) OVER w, max(rel) OVER (PARTITION BY folder)) AS prev_rel FROM f WINDOW w AS (PARTITION BY folder ORDER BY rel)""")
def file_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.file_stops(page_results(spark, sf_dir))


CHIP_SQL = """
, t AS (SELECT {key}, CASE WHEN fact_type = 'rte' THEN 5 ELSE 6 END AS place, CASE WHEN fact_type = 'rte' THEN 'RTE' WHEN name LIKE 'K%' THEN 'Characteristic' ELSE 'Measurement' END AS label,
  count(*) FILTER (change = '+') AS a, count(*) FILTER (change = '-') AS r FROM {rows} GROUP BY 1, 2, 3),
chip AS (SELECT {key}, string_agg(CASE WHEN a > 0 AND r > 0 THEN '+' || a || '/−' || r WHEN a > 0 THEN '+' || a ELSE '−' || r END || ' ' || label, '   ·   ' ORDER BY place, label) AS chips FROM t GROUP BY 1)
"""


@query(CODES + FACT_SQL + CHIP_SQL.format(key="rel", rows="f") + "SELECT rel, chips FROM chip")
def fact_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.chips(code_facts(spark, sf_dir))


@query(CODES + FACT_SQL + """SELECT rel, CASE fact_type WHEN 'rte' THEN 'RTE' ELSE 'A2L' END AS topic, string_agg(CASE change WHEN '-' THEN '−' ELSE '+' END || name || CASE WHEN fact_type = 'rte' THEN '' WHEN name LIKE 'K%' THEN ' (CHARACTERISTIC)' ELSE ' (MEASUREMENT)' END,
  '; ' ORDER BY change, name) AS note FROM f GROUP BY 1, 2""")
def fact_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.notes(code_facts(spark, sf_dir))


@query(CODE_RESULTS + FACT_SQL + CHIP_SQL.format(key="model", rows="f JOIN g ON f.rel = g.rel") + """SELECT g.model, count(*) AS files, count(*) FILTER (status = 'identical') AS identical, count(*) FILTER (status = 'comment-only') AS comment_only, count(*) FILTER (status = 'ignorable-only') AS ignorable_only,
  count(*) FILTER (status = 'real-change') AS real_change, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'error') AS error, coalesce(max(chips), '') AS chips FROM g LEFT JOIN chip ON chip.model = g.model GROUP BY g.model""")
def model_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overview(*code_results(spark, sf_dir), code_facts(spark, sf_dir))


@query(r"""
WITH u AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS rel, page_id FROM pages), t AS (SELECT rel, count(*) AS units, count(*) FILTER (page_id % 3 = 0) AS reviewed FROM u GROUP BY rel),
x AS (SELECT array_to_string(list_slice(string_split(rel, '/'), 1, n), '/') AS path, units, reviewed FROM (SELECT *, unnest(generate_series(0, len(string_split(rel, '/')))) AS n FROM t))
SELECT path, CAST(sum(units) AS BIGINT) AS units, CAST(sum(reviewed) AS BIGINT) AS reviewed, sum(units) = sum(reviewed) AS done FROM x GROUP BY path""")
def review_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("rel"), F.col("page_id").cast("string").alias("unit_key"))
    entries = units.where(F.col("unit_key").cast("long") % 3 == 0).select("rel", "unit_key", F.lit("").alias("note"), F.lit(True).alias("reviewed"))
    return review.folder_tally(units, entries)


@query(RESULTS_SQL + """, c AS (SELECT unnest(['identical', 'comment-only', 'ignorable-only', 'real-change', 'added', 'deleted', 'error']) AS s, unnest(generate_series(0, 6)) AS k)
SELECT 1 AS section, '0' || k AS ord, s || ': ' || (SELECT count(*) FROM r WHERE status = s) AS line FROM c
UNION ALL SELECT 2, rel, rel || '  ' || CASE status WHEN 'added' THEN 'Added' WHEN 'deleted' THEN 'Deleted' ELSE 'Modified: 0 hunk(s)' END FROM r WHERE status IN ('added', 'deleted', 'real-change')""")
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.summary_lines(plain_results(spark, sf_dir))


@query(TREES + r"""
, la AS (SELECT rel, unnest(string_split(text, chr(10))) AS a, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM u_old),
lb AS (SELECT rel, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM u_new),
p AS (SELECT la.rel, CAST(la.line AS INT) AS line, a, b FROM la JOIN lb ON la.rel = lb.rel AND la.line = lb.line WHERE a <> b),
q AS (SELECT *, list_max(list_filter(generate_series(0, least(length(a), length(b))), lambda k: left(a, k) = left(b, k))) AS pre FROM p),
s AS (SELECT *, list_max(list_filter(generate_series(0, least(length(a), length(b)) - pre), lambda k: k = 0 OR right(a, k) = right(b, k))) AS suf FROM q)
SELECT rel, line, CAST(CASE WHEN pre < length(a) - suf THEN pre - length(regexp_extract(left(a, pre), '[\pL\pN_]*$')) ELSE pre END AS INT) AS old_lo,
  CAST(CASE WHEN pre < length(a) - suf THEN length(a) - suf + length(regexp_extract(substr(a, length(a) - suf + 1), '^[\pL\pN_]*')) ELSE length(a) - suf END AS INT) AS old_hi,
  CAST(CASE WHEN pre < length(b) - suf THEN pre - length(regexp_extract(left(b, pre), '[\pL\pN_]*$')) ELSE pre END AS INT) AS new_lo,
  CAST(CASE WHEN pre < length(b) - suf THEN length(b) - suf + length(regexp_extract(substr(b, length(b) - suf + 1), '^[\pL\pN_]*')) ELSE length(b) - suf END AS INT) AS new_hi FROM s""".replace("\\\\p", "\\p"))
def char_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed stretch of each two unlike lines at one place of a pair."""
    pairs = changed_pairs(spark, sf_dir)
    lines = F.arrays_zip(text.lines(F.col("old_text")).alias("a"), text.lines(F.col("new_text")).alias("b"))
    rows = pairs.select("rel", F.posexplode(lines).alias("line", "z")).where("z.a <> z.b")
    return rows.select("rel", "line", scopes.char_span(F.col("z.a"), F.col("z.b")).alias("s")).select("rel", "line", "s.*")


def scoped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C and A2L files made from documents: a function or block around each text."""
    i = F.col("doc_id").cast("string")
    docs = read(spark, sf_dir, "documents")
    body = F.regexp_replace("text", "[{}();\"'/]", " ")
    c = F.concat(F.lit("#include <a.h>\nint v;\nvoid f"), i, F.lit("(void)\n{\n  if (v) {\n"), body, F.lit("\n  }\n}\nstruct s"), i, F.lit(" {\n  int x;\n};\n"))
    a = F.concat(F.lit("/begin MODULE M"), i, F.lit("\n/begin CHARACTERISTIC K"), i, F.lit(' "/begin no"\n'), body, F.lit("\n/end CHARACTERISTIC\n/end MODULE\n"))
    is_c = F.col("doc_id") % 2 == 0
    return docs.select(F.concat(F.lit("d"), i, F.when(is_c, ".c").otherwise(".a2l")).alias("rel"), F.when(is_c, c).otherwise(a).alias("text"))


@query(r"""
WITH d AS (SELECT doc_id AS i, doc_id % 2 = 0 AS is_c, len(string_split(regexp_replace(text, '[{}();"\'/]', ' ', 'g'), chr(10))) AS n FROM documents)
SELECT 'd' || i || '.c' AS rel, 'f' || i AS label, CAST(n + 5 AS BIGINT) AS lines FROM d WHERE is_c UNION ALL SELECT 'd' || i || '.c', 's' || i, 3 FROM d WHERE is_c UNION ALL SELECT 'd' || i || '.c', NULL, 3 FROM d WHERE is_c
UNION ALL SELECT 'd' || i || '.a2l', 'K' || i, n + 2 FROM d WHERE NOT is_c UNION ALL SELECT 'd' || i || '.a2l', 'M' || i, 2 FROM d WHERE NOT is_c UNION ALL SELECT 'd' || i || '.a2l', NULL, 1 FROM d WHERE NOT is_c""".replace("\\'", "''"))
def scope_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per scope of scoped_files()."""
    return scopes.scope_labels(scoped_files(spark, sf_dir)).select("rel", F.explode("labels").alias("label")).groupBy("rel", "label").agg(F.count("*").alias("lines"))


@query(CODES + FACT_SQL + "SELECT CASE fact_type WHEN 'rte' THEN 'RTE access points' ELSE 'A2L variables' END AS section, CASE change WHEN '-' THEN '−' ELSE change END AS sign, name, CASE WHEN fact_type = 'rte' THEN '' WHEN name LIKE 'K%' THEN 'CHARACTERISTIC' ELSE 'MEASUREMENT' END AS detail, rel, name AS key FROM f")
def summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.summary_rows(code_facts(spark, sf_dir))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of text files, one per customer: of twelve lines every fourth is replaced, and some files gain a line."""
    k = F.col("c_custkey")
    at = F.sequence(F.lit(0), F.lit(11))
    line = lambda j: F.concat(F.lit("l"), j.cast("string"), F.lit(" k"), k.cast("string"))
    more = F.when((k % 3 == 0) & ((k + 11) % 4 != 0), F.array(F.lit("extra"))).otherwise(F.array().cast("array<string>"))
    new = F.concat(F.transform(at, lambda j: F.when((k + j) % 4 == 0, F.concat(F.lit("new"), j.cast("string"))).otherwise(line(j))), more)
    rel = F.concat(F.lit("c"), k.cast("string"), F.lit(".txt"))
    return read(spark, sf_dir, "customer").select(rel.alias("rel"), F.lit("plain").alias("rules"), F.array_join(F.transform(at, line), "\n").alias("old_text"), F.array_join(new, "\n").alias("new_text"))


EDITED = """
WITH k AS (SELECT c_custkey AS k, 'c' || c_custkey || '.txt' AS rel, c_custkey % 3 = 0 AND (c_custkey + 11) % 4 <> 0 AS more FROM customer),
l AS (SELECT k, rel, CAST(j AS INT) AS j, 'l' || j || ' k' || k AS o, CASE WHEN (k + j) % 4 = 0 THEN 'new' || j ELSE 'l' || j || ' k' || k END AS n, (k + j) % 4 = 0 AS edited FROM k, (SELECT unnest(generate_series(0, 11)) AS j) s),
h AS (SELECT rel, j AS i1, j + 1 AS i2, j AS j1, j + 1 AS j2, o, n FROM l WHERE edited UNION ALL SELECT rel, 12, 12, 12, 13, '', 'extra' FROM k WHERE more)
"""


@query(EDITED + "SELECT rel, i1, i2, j1, j2 FROM h")
def edited_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linediff.hunks(edited(spark, sf_dir)).select("rel", F.explode("ranges").alias("r")).select("rel", "r.*")


@query(EDITED + """SELECT rel, CAST(j AS INT) AS row_no, j + 1 AS old_no, o AS old_txt, j + 1 AS new_no, n AS new_txt, CASE WHEN edited THEN 'real' ELSE 'ctx' END AS mode FROM l
UNION ALL SELECT rel, 12, NULL, NULL, 13, 'extra', 'real' FROM k WHERE more""")
def edited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.aligned_rows(classify.classified(edited(spark, sf_dir), texts=True))
    return rows.select("rel", "row_no", "old_no", "old_txt", "new_no", "new_txt", "mode")


@query(EDITED + """SELECT rel, left(sha1('hunk' || chr(0) || 'real' || chr(0) || o || chr(0) || n || chr(0)), 16) || '#0' AS unit_key, CAST(row_number() OVER (PARTITION BY rel ORDER BY i1) - 1 AS INT) AS hunk_idx,
  'BASELINE ' || CASE WHEN i1 = i2 THEN '-' ELSE '' || i2 END || ' · CURRENT ' || j2 AS label FROM h""")
def edited_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.hunk_units(classify.classified(edited(spark, sf_dir), texts=True))


#: Edits of C and XML files by number, with the status and the kinds of hunks that they must come to.
C_EDITS = [
    ("identical", ""), ("comment-only", "comment"), ("ignorable-only", "rename"), ("ignorable-only", "reorder"), ("real-change", "real"), ("ignorable-only", "whitespace"), ("ignorable-only", ""), ("real-change", "moved"), ("real-change", "comment, real"),
]
XML_EDITS = [("identical", ""), ("ignorable-only", "uuid"), ("ignorable-only", "timestamp"), ("ignorable-only", "sw-version"), ("ignorable-only", "description"), ("comment-only", "comment"), ("real-change", "real"), ("real-change", "real, uuid")]


def _verdicts(column: int) -> str:
    c, x = (" ".join(f"WHEN {n} THEN '{e[column]}'" for n, e in enumerate(edits)) for edits in (C_EDITS, XML_EDITS))
    return f"CASE WHEN s_or_c = 0 THEN CASE k % {len(C_EDITS)} {c} END ELSE CASE k % {len(XML_EDITS)} {x} END END"


@query(f"""WITH d AS (SELECT c_custkey AS k, unnest([0, 1]) AS s_or_c FROM customer)
SELECT 'c' || k || CASE s_or_c WHEN 0 THEN '.c' ELSE '.arxml' END AS rel, {_verdicts(0)} AS status, {_verdicts(1)} AS kinds FROM d""")
def edited_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A C and an XML file per customer, each with one edit of a known verdict, as two trees that are compared."""
    k = F.col("c_custkey")
    s = k.cast("string")
    note, body, rest = F.concat(F.lit("int a"), s, F.lit(";\n/* note */\n")), F.concat(F.lit("void f(void)\n{\n  rtb_Sum_a1 = in"), s, F.lit(";\n  p = in1;\n  q = in2;\n  out = rtb_Sum_a1;\n}\n")), F.lit("int z1;\nint z2;\nint z3 = 3;\n")
    c = F.concat(note, body, rest)
    swap = lambda t, a, b: F.replace(t, F.lit(a), F.lit(b))
    c_new = [c, swap(c, "note", "other"), swap(c, "rtb_Sum_a1", "rtb_Sum_k2"), swap(c, "  p = in1;\n  q = in2;\n", "  q = in2;\n  p = in1;\n"), swap(c, "= 3", "= 4"), swap(c, "int z1", "int  z1"), swap(c, "\n", "\r\n"), F.concat(note, rest, body), swap(swap(c, "note", "other"), "= 3", "= 4")]
    x = F.concat(F.lit('<A>\n<P UUID="u'), s, F.lit('">\n<SHORT-NAME>N'), s, F.lit("</SHORT-NAME>\n<DESC>words</DESC>\n<DATE>2024</DATE>\n<SW-VERSION>1</SW-VERSION>\n<!-- note -->\n<V>1</V>\n</P>\n</A>\n"))
    x_new = [x, swap(x, 'UUID="u', 'UUID="v'), swap(x, "<DATE>2024", "<DATE>2025"), swap(x, "<SW-VERSION>1", "<SW-VERSION>2"), swap(x, "words", "more words"), swap(x, "note", "other"), swap(x, "<V>1", "<V>2"), swap(swap(x, 'UUID="u', 'UUID="v'), "<V>1", "<V>2")]
    pick = lambda new: F.element_at(F.array(*new), (k % len(new) + 1).cast("int"))
    files = F.array(F.struct(F.concat(F.lit("c"), s, F.lit(".c")).alias("rel"), c.alias("old"), pick(c_new).alias("new")), F.struct(F.concat(F.lit("c"), s, F.lit(".arxml")).alias("rel"), x.alias("old"), pick(x_new).alias("new")))
    rows = read(spark, sf_dir, "customer").select(F.explode(files).alias("f")).select("f.*")
    res = compare.scan_texts(rows.select("rel", F.col("old").alias("text")), rows.select("rel", F.col("new").alias("text")))
    return res.select("rel", "status", F.array_join(F.array_sort(F.array_distinct(F.transform("hunks", lambda h: h["kind"]))), ", ").alias("kinds"))
