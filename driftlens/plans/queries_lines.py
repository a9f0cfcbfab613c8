"""Queries of operators on the lines of files: syntax, alignment of long files, and labels of changed stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import brackets, classify, edits, layout, linediff, report, scopes, syntax
from driftlens.plans import compare, sinks
from driftlens.plans.queries import C_STRIP, CODES, EDITED, FACT_SQL, KEYWORD_LIST, SQL as OTHERS, TREES, code_facts, codes, collapsed, edited, read, scoped_files, trees

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query()
def syntax_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each kind, and their characters, in every file of the newer tree."""
    spans = syntax.lexed(trees(spark, sf_dir)[1]).select("rel", F.explode("spans").alias("s"))
    return spans.groupBy("rel", F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("s.hi") - F.col("s.lo")).cast("long").alias("chars"))


@query(r"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '["''/*]', ' ', 'g'), chr(10)) AS l FROM documents),
l AS (SELECT 'd' || doc_id || '.a2l' AS rel, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS line FROM d),
m AS (SELECT *, length(x) AS n, length(x) % 5 = 0 AS closes, length(x) % 7 = 0 AS opens FROM l),
s AS (SELECT *, coalesce(last_value(CASE WHEN opens THEN 1 WHEN closes THEN 0 END IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS state FROM m)
SELECT rel, CAST(line AS INT) AS line, CAST(state AS INT) AS state,
  CAST(CASE WHEN state = 0 THEN CASE WHEN opens THEN 2 ELSE 0 END WHEN closes THEN 2 + CASE WHEN opens THEN 2 ELSE 0 END ELSE n + CASE WHEN opens THEN 3 ELSE 0 END END AS INT) AS commented FROM s""")
def syntax_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State before each line, and characters in comments, of files in which some lines open comments and some close them."""
    lines = F.split(F.regexp_replace("text", "[\"'/*]", " "), "\n", -1)
    marked = F.transform(lines, lambda x: F.concat(F.when(F.length(x) % 5 == 0, "*/ ").otherwise(""), x, F.when(F.length(x) % 7 == 0, " /*").otherwise("")))
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".a2l")).alias("rel"), F.array_join(marked, "\n").alias("text"))
    comments = F.filter("spans", lambda s: s["kind"] == "comment")
    return syntax.lexed(files, 64).select("rel", "line", "state", F.aggregate(comments, F.lit(0), lambda n, s: n + s["hi"] - s["lo"]).alias("commented"))


@query(r"""
WITH l AS (SELECT doc_id, source AS rel, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
n AS (SELECT rel, doc_id, p, row_number() OVER (PARTITION BY rel ORDER BY doc_id, p) - 1 AS i, doc_id % 9 = 4 AND p % 4 = 1 AS edited, doc_id % 11 = 7 AND p = 0 AS gone FROM l),
k AS (SELECT *, i - sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER (PARTITION BY rel ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS j FROM n),
c AS (SELECT rel, i, coalesce(j, i) AS j, gone, i - row_number() OVER (PARTITION BY rel ORDER BY i) AS run FROM k WHERE edited OR gone)
SELECT rel, CAST(min(i) AS INT) AS i1, CAST(max(i) + 1 AS INT) AS i2, CAST(min(j) AS INT) AS j1, CAST(max(CASE WHEN gone THEN j ELSE j + 1 END) AS INT) AS j2 FROM c GROUP BY rel, run""")
def long_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed ranges of a long file per source: all its documents' lines, some of which are edited and some gone."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("rel"), F.split("text", "\n", -1).alias("lines"))
    starts = docs.select("doc_id", "rel", F.size("lines").alias("lines")).withColumn("start", F.coalesce(F.sum("lines").over(Window.partitionBy("rel").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("lines")
    gone = F.when(F.col("doc_id") % 11 == 7, 1).otherwise(0)
    fewer = F.coalesce(F.sum(gone).over(Window.partitionBy("rel").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = docs.join(starts.withColumn("fewer", fewer).drop("rel"), "doc_id").select("rel", "doc_id", "start", "fewer", gone.alias("gone"), F.posexplode("lines").alias("p", "x"))
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("p").cast("string"), F.lit(" "), "x")
    old = rows.select("rel", (F.col("start") + F.col("p")).alias("no"), line.alias("line"))
    edited = F.when((F.col("doc_id") % 9 == 4) & (F.col("p") % 4 == 1), F.concat(F.lit("edited "), line)).otherwise(line)
    new = rows.where("gone = 0 or p > 0").select("rel", (F.col("start") + F.col("p") - F.col("fewer") - F.col("gone")).alias("no"), edited.alias("line"))
    return linediff.long_changed(old, new)


@query(CODES + r"""SELECT o.rel, 'rtb_Sum_c' || (o.i % 9) AS old, 'rtb_Sum_c' || ((o.i + 1) % 9) AS new FROM side o JOIN side n ON o.rel = n.rel AND o.k = 0 AND n.k = 1 WHERE o.is_c""")
def code_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames that hold all over each C file of the code trees; access points that changed too are declared elsewhere."""
    old, new = codes(spark, sf_dir)
    both = old.where(F.col("rel").endswith(".c")).select("rel", F.col("text").alias("old_text")).join(new.select("rel", F.col("text").alias("new_text")), "rel").withColumn("rules", F.lit("c"))
    return edits.renames(edits.aligned(both))


#: Statements of a block, and the words of one: what is written, then what is read.
BLOCK_STATEMENTS, STATEMENT_WORDS = 20, 3


@query(rf"""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS w FROM documents),
s AS (SELECT doc_id, k, list_slice(w, {STATEMENT_WORDS} * k + 1, {STATEMENT_WORDS} * k + {STATEMENT_WORDS}) AS w FROM (SELECT *, unnest(generate_series(0, len(w) // {STATEMENT_WORDS} - 1)) AS k FROM w)),
b AS (SELECT doc_id, k // {BLOCK_STATEMENTS} AS b, list(w ORDER BY k) AS s FROM s GROUP BY 1, 2),
p AS (SELECT *, list_filter(generate_series(1, len(s) // 2), lambda j: (j + b) % 3 = 0) AS swaps, list_filter(flatten(s), lambda x: x IN ({KEYWORD_LIST})) AS keys FROM b)
SELECT doc_id || '/' || b AS rel, len(s) >= 2 AND len(swaps) > 0 AND len(list_distinct(s)) = len(s) AND len(list_filter(s, lambda x: x[1] IN ({KEYWORD_LIST}))) = 0
  AND len(list_filter(swaps, lambda j: s[2 * j - 1][1] = s[2 * j][1] OR list_contains(list_filter(s[2 * j][2:], lambda x: NOT x IN ({KEYWORD_LIST})), s[2 * j - 1][1]) OR list_contains(list_filter(s[2 * j - 1][2:], lambda x: NOT x IN ({KEYWORD_LIST})), s[2 * j][1]))) = 0 AS proven FROM p""")
def reorder_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether blocks of assignments made of all words of each document may have some neighbours swapped."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), F.lower)
    n, size = F.floor(F.size("w") / STATEMENT_WORDS), BLOCK_STATEMENTS
    line = lambda k: F.concat(F.get("w", k * STATEMENT_WORDS), F.lit(" = "), F.get("w", k * STATEMENT_WORDS + 1), F.lit(" + "), F.get("w", k * STATEMENT_WORDS + 2), F.lit(";"))
    docs = read(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") >= STATEMENT_WORDS)
    docs = docs.select("doc_id", F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), line).alias("s"))
    last = F.floor((F.size("s") - 1) / size).cast("int")
    blocks = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(b.alias("b"), F.slice("s", b * size + 1, F.lit(size)).alias("old")))).alias("x")).select("doc_id", "x.*")
    other = lambda x, k: F.when((F.floor(k / 2) + 1 + F.col("b")) % 3 == 0, F.coalesce(F.get("old", k + F.when(k % 2 == 0, 1).otherwise(-1)), x)).otherwise(x)
    return edits.reordered(blocks.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("b").cast("string")).alias("rel"), "old", F.transform("old", other).alias("new")))


@query(r"""
WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), m AS (SELECT 'd' || doc_id || '.txt' AS rel, CAST(n AS INT) AS n FROM d WHERE doc_id % 4 = 1 AND n >= 8)
SELECT rel, 0 AS i1, 3 AS i2, 0 AS j1, 0 AS j2, n - 2 AS moved_to, CAST(NULL AS INT) AS moved_from FROM m UNION ALL SELECT rel, n, n, n - 3, n, NULL, 1 FROM m""")
def moved_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that moved within files of numbered lines; in a quarter of them the first three lines go to the end."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, k: F.concat(k.cast("string"), F.lit(": "), x))
    moves = (F.col("doc_id") % 4 == 1) & (F.size("old") >= 8)
    changed = F.when(moves, F.concat(F.slice("old", F.lit(4), F.size("old")), F.slice("old", 1, 3))).when(F.col("doc_id") % 4 == 2, F.concat(F.array(F.lit("one more"), F.lit("and another")), "old")).otherwise(F.col("old"))
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel"), lines.alias("old"), "doc_id").withColumn("new", changed)
    pairs = files.select("rel", F.lit("plain").alias("rules"), F.array_join("old", "\n").alias("old_text"), F.array_join("new", "\n").alias("new_text"))
    return edits.moved_blocks(edits.aligned(pairs, real=True))


@query(CODES + FACT_SQL + r"""
, l AS (SELECT CASE fact_type WHEN 'rte' THEN 5 ELSE 6 END AS section, CASE fact_type WHEN 'rte' THEN 'RTE access points' ELSE 'A2L objects' END AS title, change,
  '  ' || change || ' ' || name || CASE WHEN fact_type = 'rte' THEN '' WHEN name LIKE 'K%' THEN ' (CHARACTERISTIC)' ELSE ' (MEASUREMENT)' END || ' in ' || rel AS line FROM f)
SELECT section, line FROM l UNION ALL SELECT section, title || ': ' || count(*) FILTER (change = '+') || ' added, ' || count(*) FILTER (change = '-') || ' removed' FROM l GROUP BY section, title""")
def terminal_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the terminal says of the facts that changed in the code trees."""
    return sinks.fact_lines(code_facts(spark, sf_dir)).select("section", "line")


MOVED = OTHERS["moves_found"].replace("\nSELECT * FROM ex UNION ALL", "\n, m AS (SELECT * FROM ex UNION ALL")


@query(MOVED + r""")
, j AS (SELECT m.*, o.ext, o.text = n.text AS same, n.text = o.text || chr(10) || '// tail' AS tailed FROM m JOIN u_old o ON o.rel = m.deleted_rel JOIN u_new n ON n.rel = m.added_rel),
v AS (SELECT *, CASE WHEN same THEN 'identical' WHEN tailed AND ext IN ('c', 'h', 'a2l') THEN 'comment-only' WHEN tailed THEN 'real-change' ELSE 'other' END AS move_status, CAST(CASE WHEN same THEN 0 ELSE 1 END AS INT) AS n_hunks FROM j)
SELECT added_rel AS rel, 'added' AS status, deleted_rel AS moved_from, NULL AS moved_to, move_status, round(similarity, 9) AS move_similarity, n_hunks FROM v
UNION ALL SELECT deleted_rel, 'deleted', NULL, added_rel, move_status, round(similarity, 9), 0 FROM v""")
def scan_with_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added and deleted files of the trees that are one file moved, each with where the other is and what they come to."""
    old, new = trees(spark, sf_dir)
    results = compare.statuses(old, new).where("status in ('added', 'deleted')").select("rel", "status", compare.no_renames().alias("renames"), compare.no_hunks().alias("hunks"))
    found = compare.with_moves(results, old, new).where("move_status is not null")
    return found.select("rel", "status", "moved_from", "moved_to", "move_status", F.round("move_similarity", 9).alias("move_similarity"), F.size("hunks").alias("n_hunks"))


@query(EDITED + """SELECT rel, CAST(j AS INT) AS row_no, CASE WHEN edited THEN 'real' ELSE 'ctx' END AS mode FROM l WHERE lower(o) LIKE '%l1%' OR lower(n) LIKE '%l1%'""")
def found_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of edited files that hold a text on either side, whatever its case; rows of noise are muted."""
    rows = layout.aligned_rows(classify.classified(edited(spark, sf_dir), texts=True))
    return layout.matches(layout.mute(rows, ("comment", "minor")), "L1").select("rel", "row_no", "mode")


@query(EDITED + """SELECT rel, CAST(min(j) AS INT) AS row_no FROM l WHERE NOT edited GROUP BY rel""")
def rows_with_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per edited file the first row that holds the file's own number as a word: changed rows before others."""
    rows = layout.aligned_rows(classify.classified(edited(spark, sf_dir), texts=True))
    own = rows.withColumns({c: F.regexp_replace(c, r"k\d+$", "here") for c in ("old_txt", "new_txt")}).withColumn("old_txt", F.when(F.col("mode") == "ctx", F.col("old_txt")))
    return scopes.row_with(own, "here")


@query("""
WITH p AS (SELECT page_id, k, CASE (page_id + k) % 5 WHEN 0 THEN 'real' WHEN 1 THEN 'comment' WHEN 2 THEN 'whitespace' WHEN 3 THEN 'moved' ELSE 'rename' END AS kind FROM pages, (SELECT unnest(generate_series(0, 6)) AS k) s)
SELECT 'p' || page_id AS rel, CAST(k AS INT) AS hunk_idx, kind, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS stop FROM p WHERE kind IN ('real', 'moved', 'comment')""")
def noise_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks at which navigation stops while comments are shown, numbered in each file."""
    kinds = F.array(*map(F.lit, ("real", "comment", "whitespace", "moved", "rename")))
    k = F.posexplode(F.sequence(F.lit(0), F.lit(6))).alias("hunk_idx", "k")
    hunks = read(spark, sf_dir, "pages").select("page_id", k).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("rel"), "hunk_idx", F.get(kinds, ((F.col("page_id") + F.col("k")) % 5).cast("int")).alias("kind"), (F.col("k") * 4).alias("i1"), (F.col("k") * 4).alias("j1"))
    return report.noise_stops(hunks, ("comment",)).select("rel", "hunk_idx", "kind", "stop")


@query(TREES + """SELECT rel, CAST(k AS INT) AS line_no, x AS txt FROM (SELECT rel, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM u_new WHERE rel NOT IN (SELECT rel FROM old)) WHERE k <= 400""")
def one_sided_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that a report shows of files that are only in the newer tree."""
    old, new = trees(spark, sf_dir)
    added = new.join(old.select("rel"), "rel", "left_anti")
    return layout.one_sided(added.select("rel", text.unix_lines(F.col("text")).alias("text")))


@query(TREES + rf"SELECT replace(rel, '.c', '.cpp') AS rel, sha256({collapsed('s')}) AS sha FROM (SELECT rel, {C_STRIP} AS s FROM u_new WHERE ext = 'c')")
def cpp_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of C files under the rules of C++."""
    files = trees(spark, sf_dir)[1].where(F.col("rel").endswith(".c")).withColumn("rel", F.replace("rel", F.lit(".c"), F.lit(".cpp")))
    return files.select("rel", F.sha2(text.shadow(text.unix_lines(F.col("text")), text.ruleset(F.col("rel"))), 256).alias("sha"))


@query(r"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '["''#]', ' ', 'g'), chr(10)) AS l FROM documents),
m AS (SELECT 'd' || doc_id || '.yaml' AS rel, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS k FROM d)
SELECT rel, CAST(k AS INT) AS line, CASE k % 4 WHEN 0 THEN 'key: v' || k WHEN 1 THEN 'url: a#' || x WHEN 2 THEN 'say: " # ' || x || '"' ELSE 'n: ''#''' || x END AS kept FROM m""")
def yaml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of YAML files without comments: a number sign after white space opens one, but in quotes or after a letter it does not."""
    lines = F.split(F.regexp_replace("text", "[\"'#]", " "), "\n", -1)

    def mark(x, k):
        own = F.concat(F.lit("key: v"), k.cast("string"), F.lit(" # "), x)
        return F.when(k % 4 == 0, own).when(k % 4 == 1, F.concat(F.lit("url: a#"), x)).when(k % 4 == 2, F.concat(F.lit('say: " # '), x, F.lit('"'))).otherwise(F.concat(F.lit("n: '#'"), x))

    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".yaml")).alias("rel"), F.array_join(F.transform(lines, mark), "\n").alias("text"))
    rows = files.select("rel", F.posexplode(F.split(text.strip_comments(F.col("text"), "yaml"), "\n", -1)).alias("line", "kept"))
    return rows.select("rel", "line", F.when(F.col("line") % 4 == 0, F.rtrim("kept")).otherwise(F.col("kept")).alias("kept"))


@query(r"SELECT page_id, sha256(replace(html, '<p>', repeat(' ', 19 + length('' || page_id)) || chr(10) || repeat(' ', 13) || '<p>')) AS sha FROM pages")
def admin_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with administrative data before each paragraph, which is blanked line by line."""
    mark = F.concat(F.lit("<ADMIN-DATA><X>"), F.col("page_id").cast("string"), F.lit("</X>\n</ADMIN-DATA>"))
    marked = F.replace("html", F.lit("<p>"), F.concat(mark, F.lit("<p>")))
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_xml(marked, "admin-data"), 256).alias("sha"))


@query(OTHERS["scope_labels"])
def scope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per scope of the same files as scope_labels, by matching brackets."""
    return brackets.label_rows(scoped_files(spark, sf_dir)).groupBy("rel", "label").agg(F.count("*").alias("lines"))


@query(r"""
WITH d AS (SELECT doc_id AS i, doc_id % 3 AS m, len(string_split(text, chr(10))) AS n FROM documents)
SELECT 'd' || i || '.py' AS rel, 'C' || i AS label, 1 AS lines FROM d WHERE m = 0 UNION ALL SELECT 'd' || i || '.py', 'C' || i || ' / m' || i, n + 1 FROM d WHERE m = 0
UNION ALL SELECT 'd' || i || '.arxml', 'P' || i, 3 FROM d WHERE m = 1 UNION ALL SELECT 'd' || i || '.arxml', 'P' || i || ' / Q' || i, n + 3 FROM d WHERE m = 1
UNION ALL SELECT 'd' || i || '.cpp', 'N' || i, 2 FROM d WHERE m = 2 UNION ALL SELECT 'd' || i || '.cpp', 'N' || i || ' / K' || i, 2 FROM d WHERE m = 2
UNION ALL SELECT 'd' || i || '.cpp', 'K' || i || ' / f' || i, n + 2 FROM d WHERE m = 2 UNION ALL SELECT 'd' || i || '.cpp', NULL, 1 FROM d WHERE m = 2""")
def nested_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per scope of Python, XML and C++ files made from documents: two or three scopes around each text, named with the one around."""
    i = F.col("doc_id").cast("string")
    body = F.regexp_replace("text", "[{}();\"'/<>#=]", " ")
    py = F.concat(F.lit("class C"), i, F.lit(":\n  def m"), i, F.lit("(self):\n"), F.array_join(F.transform(F.split(body, "\n", -1), lambda x: F.concat(F.lit("    "), x)), "\n"))
    xml = F.concat(F.lit("<A>\n<SHORT-NAME>P"), i, F.lit("</SHORT-NAME>\n<B>\n<SHORT-NAME>Q"), i, F.lit("</SHORT-NAME>\n<DESC>"), body, F.lit("</DESC>\n</B>\n</A>"))
    cpp = F.concat(F.lit("namespace N"), i, F.lit(" {\nclass K"), i, F.lit(" {\nvoid f"), i, F.lit("(int a) {\n"), body, F.lit("\n}\n};\n}\n"))
    m = F.col("doc_id") % 3
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), i, F.when(m == 0, ".py").when(m == 1, ".arxml").otherwise(".cpp")).alias("rel"), F.when(m == 0, py).when(m == 1, xml).otherwise(cpp).alias("text"))
    return scopes.scope_labels(files).select("rel", F.explode("labels").alias("label")).groupBy("rel", "label").agg(F.count("*").alias("lines"))
