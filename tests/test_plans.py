"""Trees, facts, moves, rollups and sinks on small frames, and every query against its SQL."""

import json
import os
import subprocess
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from driftlens.functions import names, text
from driftlens.operators import classify, facts, layout, moves, review, rollup
from driftlens.plans import compare, sinks
from driftlens.plans import queries, queries_lines
from driftlens.sources import trees
from driftlens.streaming.rescan import rescan

QUERIES, SQL = queries.QUERIES | queries_lines.QUERIES, queries.SQL | queries_lines.SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    said = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(said(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    out = con.execute(SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in out.description)
    assert got == rows_of([d[0] for d in out.description], out.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


OLD = {
    "src/same.h": b"int a;\n", "src/real.c": b"x = 1;\n", "src/note.c": b"/* one */\nint a;\n", "src/ends.c": b"a\nb\n", "src/gone.h": b"int gone_for_ever;\nint twice;\n",
    "_b.c": b"\x00\x01", ".hidden.py": b"x = 1  # a\n", "a/moved_from.c": b"int q1;\nint q2;\nint q3;\n", "x.arxml": b'<A UUID="1"/>\n', ".git/x": b"no",
}
NEW = {
    "src/same.h": b"int a;\n", "src/real.c": b"x = 2;\n", "src/note.c": b"/* two */\nint a;\n", "src/ends.c": b"a\r\nb\r\n", "src/new.py": b"print(1)\n",
    "_b.c": b"\x00\x02", ".hidden.py": b"x = 1  # b\n", "b/moved_to.c": b"int q1;\nint q2;\nint q3;\n", "x.arxml": b'<A UUID="2"/>\n',
}
VERDICTS = {
    "src/same.h": "identical", "src/real.c": "real-change", "src/note.c": "comment-only", "src/ends.c": "ignorable-only", "src/gone.h": "deleted", "src/new.py": "added",
    "_b.c": "real-change", ".hidden.py": "comment-only", "a/moved_from.c": "deleted", "b/moved_to.c": "added", "x.arxml": "ignorable-only",
}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    at = tmp_path_factory.mktemp("trees")
    for side, files in (("old", OLD), ("new", NEW)):
        for rel, content in files.items():
            path = at / side / rel
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content)
    return at


def test_scan_of_folders(spark, folders):
    old, new = (trees.read_tree(spark, str(folders / s)) for s in ("old", "new"))
    res = compare.scan(old, new).cache()
    assert {r["rel"]: r["status"] for r in res.collect()} == VERDICTS
    moved = {r["rel"]: (r["moved_from"], r["moved_to"], r["move_status"], r["move_similarity"], len(r["hunks"])) for r in res.where("move_status is not null").collect()}
    assert moved == {"a/moved_from.c": (None, "b/moved_to.c", "identical", 1.0, 0), "b/moved_to.c": ("a/moved_from.c", None, "identical", 1.0, 0)}
    assert {r["rel"] for r in compare.scan(old, new, ["*.c"], ["real*"]).collect()} == {k for k in VERDICTS if k.endswith(".c") and "real" not in k}
    assert rollup.exit_code(res).first()[0] == 1 and rollup.exit_code(res, exit_zero=True).first()[0] == 0
    folded = {r["rel"]: r["status"] for r in rollup.fold(res, ("comment-only", "ignorable-only", "added")).collect()}
    assert folded["src/note.c"] == "identical" and folded["src/new.py"] == "added"
    sinks.write_json(res, str(folders / "out.json"))
    sinks.write_sarif(res, str(folders / "out.sarif"))
    doc = json.loads((folders / "out.json").read_text())
    assert doc["summary"]["added"] == 2 and {f["path"]: f.get("moved_from") for f in doc["files"]}["b/moved_to.c"] == "a/moved_from.c"
    sarif = json.loads((folders / "out.sarif").read_text())
    assert [r["ruleId"] for r in sarif["runs"][0]["results"]].count("real-change") == 2


def test_moved_and_edited_files_are_linked(spark):
    """An edited file meets its origin, not a lesser likeness; two equal candidates meet nobody; binaries meet by content alone."""
    body = [f"line {k} of a text" for k in range(20)]
    t = lambda lines: "\n".join(lines).encode()
    twice = [f"both {k}" for k in range(20)]
    old = {"o/a.txt": t(body), "o/less.txt": t(body[:9] + ["x"] * 11), "o/t.txt": t(twice), "o/b.bin": b"\0" + t(body), "o/c.c": b"int a1; /* one */\nint b1;\n", "keep.c": b"1"}
    new = {"n/a.txt": t([*body[:-1], "edited"]), "n/t1.txt": t(twice[:-1] + ["p"]), "n/t2.txt": t(twice[:-1] + ["q"]), "n/b.bin": b"\0" + t(body[:-1]), "n/c.c": b"int a1; /* two */\nint b1;\n", "n/c.h": b"int a1;\nint b1;\n", "keep.c": b"1"}
    frames = [spark.createDataFrame([(k, None, v) for k, v in side.items()], "rel string, list_error string, content binary") for side in (old, new)]
    rows = {r["rel"]: r for r in compare.scan(*frames).collect()}
    links = {k: (r["moved_from"] or r["moved_to"], r["move_status"]) for k, r in rows.items() if r["move_status"]}
    assert links == {"n/a.txt": ("o/a.txt", "real-change"), "o/a.txt": ("n/a.txt", "real-change"), "n/c.c": ("o/c.c", "comment-only"), "o/c.c": ("n/c.c", "comment-only")}
    assert rows["n/a.txt"]["status"] == "added" and [h["kind"] for h in rows["n/a.txt"]["hunks"]] == ["real"] and rows["o/a.txt"]["hunks"] == []


def test_terminal_lines_of_facts_and_advice(spark):
    facts = spark.createDataFrame(
        [("a.arxml", "iface", None, "/p/If", "+", None, "SENDER-RECEIVER-INTERFACE"), ("a.arxml", "event", "/p/Swc", "TE", "~", "0.01", "0.02"), ("a.arxml", "swc", None, "/p/New", "+", None, ""), ("a.c", "rte", None, "Rte_Read_a_b", "-", "", None)],
        "rel string, fact_type string, owner string, name string, change string, old_descr string, descr string")
    results = spark.createDataFrame([("a.c", "error", False, ["not read", "again"], [])], f"rel string, status string, binary boolean, notes array<string>, hunks array<{classify.HUNK}>")
    advice = spark.createDataFrame([("M", "look")], "model string, message string")
    said = [r["line"] for r in sinks.summary_lines(results, facts, advice).orderBy("section", "ord").collect()][7:]
    assert said == [
        "a.c  NOT compared -- treat as potentially changed: not read; again", "ARXML interfaces: 1 added, 0 removed", "  + /p/If (SENDER-RECEIVER) in a.arxml", "AUTOSAR behavior: 2 change(s)", "  + SWC /p/New in a.arxml",
        "  ~ event Swc.TE (0.01 -> 0.02) in a.arxml", "RTE access points: 0 added, 1 removed", "  - Rte_Read_a_b in a.c", "Consistency check:", "  !! M: look",
    ]


def test_lost_folders_are_errors(spark):
    old = spark.createDataFrame([("d/a.c", None, b"1"), ("d", "denied", None)], "rel string, list_error string, content binary")
    new = spark.createDataFrame([("d/b.c", None, b"1"), ("e.c", None, b"2")], "rel string, list_error string, content binary")
    got = {r["rel"]: r["status"] for r in compare.scan(old, new).collect()}
    assert got == {"d": "error", "d/b.c": "error", "d/a.c": "deleted", "e.c": "added"}


def test_zip_and_git(spark, folders):
    with zipfile.ZipFile(folders / "t.zip", "w") as z:
        z.writestr("top/a.c", "x")
        z.writestr("top/d/_b.c", "y")
    assert {r["rel"] for r in trees.read_tree(spark, str(folders / "t.zip")).collect()} == {"a.c", "d/_b.c"}
    with zipfile.ZipFile(folders / "bad.zip", "w") as z:
        z.writestr("../a.c", "x")
    with pytest.raises(trees.SourceError):
        trees.read_tree(spark, str(folders / "bad.zip"))
    repo = str(folders / "repo")
    env = os.environ | {f"GIT_{w}_{x}": "t@example.org" for w in ("AUTHOR", "COMMITTER") for x in ("NAME", "EMAIL")}
    os.makedirs(repo)
    (folders / "repo" / "a.c").write_text("x")
    for args in (["init", "-q"], ["add", "."], ["commit", "-qm", "one"]):
        subprocess.run(["git", "-C", repo, *args], check=True, env=env)
    assert trees.git_log(repo)[0][4] == "one"
    assert [r["rel"] for r in trees.read_commit(spark, repo, "HEAD", str(folders)).collect()] == ["a.c"]


def test_review_file(tmp_path):
    path = str(tmp_path / "r.json")
    assert trees.read_review(path) == ({}, None)
    trees.save_review(path, {"a.c": {"k#0": {"note": "n", "reviewed": True}}})
    assert trees.read_review(path)[0]["a.c"]["k#0"]["reviewed"]
    (tmp_path / "r.json").write_text("{")
    with pytest.raises(trees.SourceError):
        trees.save_review(path, {})


XML = """<AUTOSAR xmlns="u"><AR-PACKAGE><SHORT-NAME>P</SHORT-NAME><SENDER-RECEIVER-INTERFACE><SHORT-NAME>If1</SHORT-NAME></SENDER-RECEIVER-INTERFACE>
<APPLICATION-SW-COMPONENT-TYPE><SHORT-NAME>C</SHORT-NAME><P-PORT-PROTOTYPE><SHORT-NAME>Out</SHORT-NAME><PROVIDED-INTERFACE-TREF>/P/If1</PROVIDED-INTERFACE-TREF></P-PORT-PROTOTYPE>
<RUNNABLE-ENTITY><SHORT-NAME>R</SHORT-NAME><SYMBOL>R_step</SYMBOL></RUNNABLE-ENTITY><TIMING-EVENT><SHORT-NAME>T</SHORT-NAME><PERIOD>0.01</PERIOD><START-ON-EVENT-REF>/P/C/R</START-ON-EVENT-REF></TIMING-EVENT>
</APPLICATION-SW-COMPONENT-TYPE></AR-PACKAGE></AUTOSAR>"""


def test_xml_facts(spark):
    rows = spark.createDataFrame([("a.arxml", XML), ("b.arxml", "<a>"), ("c.arxml", "<a/>")], "rel string, text string")
    new = spark.createDataFrame([("a.arxml", XML.replace("0.01", "0.02").replace("If1", "If2")), ("b.arxml", "<a/>")], "rel string, text string")
    old = facts.xml_facts(rows)
    got = {(r["fact_type"], r["owner"], r["name"], r["descr"]) for r in old.where("parsed").collect()}
    assert got == {("iface", None, "/P/If1", "SENDER-RECEIVER-INTERFACE"), ("swc", None, "/P/C", ""), ("port", "/P/C", "Out", "P-PORT If1"), ("runnable", "/P/C", "R", "R_step"), ("event", "/P/C", "T", "TIMING 0.01s on R")}
    changes = {(r["change"], r["name"]) for r in facts.fact_diff(old, facts.xml_facts(new)).collect()}
    assert changes == {("~", "Out"), ("~", "T"), ("-", "/P/If1"), ("+", "/P/If2")}


@pytest.mark.parametrize(
    ("rules", "before", "after"),
    [
        ("c", 'a /* x\ny */ b "//no" // z\nc', 'a     \n     b "//no"     \nc'), ("c", "'/*' a /* open\n", "'/*' a        \n"), ("a2l", '"a\\" // c', '"a\\"     '), ("python", 's = """# no\n""" # yes', 's = """# no\n"""      '),
        ("yaml", "u: http://x#y # z", "u: http://x#y    "), ("cpp", "", ""),
    ],
)
def test_strippers(spark, rules, before, after):
    assert spark.range(1).select(text.strip_comments(F.lit(before), rules)).first()[0] == after


def test_scalars(spark):
    row = spark.range(1).select(
        names.generated_root(F.lit("rtb_AND_c4nxjoom3d")).alias("a"), names.generated_root(F.lit("plain_c")).alias("b"), names.checksum_root(F.lit("Sub_c4nxjoom3d_step")).alias("c"), names.is_authored(F.lit("Rte_Read_Speed")).alias("d"),
        text.decode(F.lit(b"\xef\xbb\xbfa\r\nb\xff")).alias("e"), text.looks_binary(F.lit(b"a\x00")).alias("f"), text.apply_renames(F.lit("a = ab + a;"), F.create_map(F.lit("a"), F.lit("q"))).alias("g"),
        names.digest(F.lit("ab"), F.lit("c")).alias("h"), text.collapse_ws(F.lit(" a \t b\n\n c ")).alias("i"), names.autogen_pair(F.lit("tmp_1"), F.lit("tmp"), F.array(F.lit("x")), F.array(F.lit("y"))).alias("j"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("rtb_AND", None, "Sub__step", True)
    assert row.e.endswith("\nb\xff") and row.f and row.g == "q = ab + q;" and len(row.h) == 16 and row.i == "a b\n\nc" and row.j


def test_moves(spark):
    a = spark.createDataFrame([("n/a.c", "1\n2\n3\n4\n5\n6"), ("n/b.c", "same"), ("n/c.c", "x\ny")], "rel string, text string")
    d = spark.createDataFrame([("o/a.c", "1\n2\n3\n4\n5\n7"), ("o/b.c", "same"), ("o/c.h", "x\ny")], "rel string, text string")
    got = {(r[0], r[1]): round(r[2], 3) for r in moves.find(a, d).collect()}
    assert got == {("n/a.c", "o/a.c"): 0.833, ("n/b.c", "o/b.c"): 1.0}
    assert {r[0] for r in moves.find(a, d, guard=1).collect()} == {"n/b.c"}


def test_layout_and_review(spark):
    pairs = compare.scan_texts(*(spark.createDataFrame([("a.txt", t)], "rel string, text string") for t in ("a\nb\nc\nd", "a\nx\ny\nc\nd2")))
    texts = spark.createDataFrame([("a.txt", "a\nb\nc\nd", "a\nx\ny\nc\nd2")], "rel string, old_text string, new_text string")
    both = texts.join(pairs.select("rel", "hunks"), "rel")
    rows = [(r["old_txt"], r["new_txt"], r["mode"]) for r in layout.aligned_rows(both).orderBy("row_no").collect()]
    assert rows == [("a", "a", "ctx"), ("b", "x", "real"), (None, "y", "real"), ("c", "c", "ctx"), ("d", "d2", "real")]
    units = review.hunk_units(both)
    assert [r["label"] for r in units.orderBy("hunk_idx").collect()] == ["BASELINE 2 · CURRENT 2-3", "BASELINE 4 · CURRENT 5"]
    entries = spark.createDataFrame([], "rel string, unit_key string, note string, reviewed boolean")
    marked = review.mark_files(entries, units, True)
    assert review.tally(units, marked).first()["done"] and review.mark_files(marked, units, False).count() == 0


def test_advisories(spark):
    res = spark.createDataFrame([("A.c", "identical"), ("A.h", "identical"), ("A.arxml", "real-change"), ("B.c", "real-change"), ("B_data.c", "identical"), ("Rte_B.h", "added"), ("x.txt", "added")], "rel string, status string").withColumn("binary", F.lit(False)).withColumn("has_facts", F.lit(True))
    groups = rollup.model_groups(res.select("rel"))
    assert {r["rel"]: r["model"] for r in groups.collect()} == {"A.c": "A", "A.h": "A", "A.arxml": "A", "B.c": "B", "B_data.c": "B", "Rte_B.h": "B", "x.txt": rollup.SHARED}
    found = spark.createDataFrame([("A.arxml", "port", "+"), ("B.c", "rte", "+")], "rel string, fact_type string, change string")
    got = {(r["model"], r["message"].split(" ")[0]) for r in rollup.advisories(res, groups, found).collect()}
    assert got == {("A", "ARXML"), ("B", "gained")}


def test_rescan(spark, tmp_path):
    spark.createDataFrame([(1, "a.c", "x = 1;"), (2, "a.c", "x = 2;"), (1, "b.c", "same")], "snapshot long, rel string, text string").write.parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([("a.c", "x = 1;"), ("b.c", "same"), ("c.c", "unseen")], "rel string, text string")
    out = []
    q = rescan(spark.readStream.schema("snapshot long, rel string, text string").parquet(str(tmp_path / "in")), base, lambda df, n: out.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r["rel"]: r["status"] for r in out} == {"a.c": "real-change", "b.c": "identical"}


def test_command_line(spark, folders, capsys):
    from driftlens.__main__ import main

    out = {k: str(folders / f"cli.{k}") for k in ("html", "json", "sarif", "arxml")}
    args = [str(folders / "old"), str(folders / "new"), "--report", out["html"], "--json", out["json"], "--sarif", out["sarif"], "--arxml-report", out["arxml"]]
    assert main(args, spark) == 1
    said = capsys.readouterr().out
    assert "real-change: 2" in said and "b/moved_to.c  Added, moved from a/moved_from.c — content unchanged, 100% alike" in said
    assert "src/real.c" in open(out["html"]).read() and "ignorable-only: 1" in open(out["arxml"]).read()
    assert main([*args[:2], "--exit-zero", "--arxml-only"], spark) == 0
    assert main([str(folders / "none"), str(folders / "new")], spark) == 2


def test_sql_functions(spark):
    from driftlens.functions.register import register

    register(spark)
    row = spark.sql("SELECT line_hunks('a\nb', 'a\nc') AS h, generated_root('rtb_A_c') AS r, is_identifier('while') AS i").first()
    assert (row.h[0].i1, row.h[0].i2, row.r, row.i) == (1, 2, "rtb_A", False)


def test_nothing_is_looked_for_below_a_component_without_a_name():
    swc = lambda name, inner: f"<APPLICATION-SW-COMPONENT-TYPE>{name}{inner}</APPLICATION-SW-COMPONENT-TYPE>"
    port = "<PORTS><P-PORT-PROTOTYPE><SHORT-NAME>Out</SHORT-NAME></P-PORT-PROTOTYPE></PORTS>"
    iface = "<SENDER-RECEIVER-INTERFACE><SHORT-NAME>If</SHORT-NAME></SENDER-RECEIVER-INTERFACE>"
    named = swc("<SHORT-NAME>In</SHORT-NAME>", port)
    assert {r[:3] for r in facts.xml_rows(f"<A>{swc('', port + named + iface)}</A>")} == {("iface", None, "/If")}
    assert {r[:3] for r in facts.xml_rows(f"<A>{swc('', '')}{named}</A>")} == {("swc", None, "/In"), ("port", "/In", "Out")}
