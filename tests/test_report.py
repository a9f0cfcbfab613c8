"""Report rows, chips, nodes, review of folders and binaries, and the JSON document, on small frames with written-out results."""

import json

from pyspark.sql import functions as F

from driftlens.operators import layout, report, review
from driftlens.plans import sinks
from driftlens.sources import trees

HUNK = "array<struct<kind:string,i1:int,i2:int,j1:int,j2:int,moved_to:int,moved_from:int>>"


def pair(spark, rel, n, hunks, edit):
    old = [f"line {k}" for k in range(n)]
    return spark.createDataFrame([(rel, "\n".join(old), "\n".join(edit(list(old))), hunks)], f"rel string, old_text string, new_text string, hunks {HUNK}")


def shown(pairs):
    hunks = pairs.select("rel", F.posexplode("hunks").alias("hunk_idx", "h")).select("rel", "hunk_idx", "h.*")
    rows = report.shown_rows(layout.aligned_rows(pairs), report.hunk_groups(hunks)).orderBy("row_no", "sub").collect()
    return [(r["old_no"], r["new_no"], r["mode"]) if r["what"] == "code" else r["said"] for r in rows]


def test_real_change_has_context_and_far_noise_has_none(spark):
    def edit(x):
        x[10], x[12], x[40] = "new 10", "// c", "// far"
        return x

    pairs = pair(spark, "a.c", 50, [("real", 10, 11, 10, 11, None, None), ("comment", 12, 13, 12, 13, None, None), ("comment", 40, 41, 40, 41, None, None)], edit)
    ctx = lambda a, b: [(k, k, "ctx") for k in range(a, b)]
    assert shown(pairs) == [*ctx(8, 11), (11, 11, "real"), (12, 12, "ctx"), (13, 13, "comment"), *ctx(14, 17), (41, 41, "comment")]


def test_noise_alone_keeps_context_and_has_a_placeholder(spark):
    def edit(x):
        x[0], x[1] = "// a", "// b"
        return x

    pairs = pair(spark, "a.c", 5, [("comment", 0, 2, 0, 2, None, None)], edit)
    assert shown(pairs) == [(1, 1, "comment"), (2, 2, "comment"), "⋯ 2 comment lines hidden", (3, 3, "ctx"), (4, 4, "ctx"), (5, 5, "ctx")]


def test_moved_blocks_have_notes_and_context_stops_at_the_next_hunk(spark):
    def edit(x):
        return x[:2] + x[4:8] + x[2:4] + x[8:]

    pairs = pair(spark, "a.c", 10, [("moved", 2, 4, 2, 2, 7, None), ("moved", 8, 8, 6, 8, None, 3)], edit)
    assert shown(pairs) == [(1, 1, "ctx"), (2, 2, "ctx"), (3, None, "moved"), (4, None, "moved"), "⇄ block moved to CURRENT line 7", *[(k, k - 2, "ctx") for k in range(5, 9)], (None, 7, "moved"), (None, 8, "moved"), "⇄ block moved from BASELINE line 3", (9, 9, "ctx"), (10, 10, "ctx")]


def test_chips_and_notes(spark):
    rows = [("m.arxml", "swc", None, "/P/C", "+", None, ""), ("m.arxml", "port", "/P/C", "Out", "+", None, "P-PORT I"), ("m.arxml", "port", "/P/C", "In", "-", "R-PORT I", None), ("m.arxml", "event", "/P/C", "T", "~", "TIMING 0.01s", "TIMING 0.02s"),
            ("m.arxml", "iface", None, "/P/I", "+", None, "CLIENT-SERVER-INTERFACE"), ("c.a2l", "a2l", None, "K", "-", "CHARACTERISTIC", None), ("c.a2l", "a2l", None, "M", "+", None, "MEASUREMENT"), ("c.c", "rte", None, "Rte_Read_A", "+", None, "")]
    facts = spark.createDataFrame(rows, "rel string, fact_type string, owner string, name string, change string, old_descr string, descr string")
    assert {r["rel"]: r["chips"] for r in report.chips(facts).collect()} == {"m.arxml": "+1 SWC   ·   +1/−1 Port   ·   ~1 Event   ·   +1 Interface", "c.a2l": "−1 Characteristic   ·   +1 Measurement", "c.c": "+1 RTE"}
    said = {(r["rel"], r["topic"]): r["note"] for r in report.notes(facts).collect()}
    assert said == {("m.arxml", "Behavior"): "+Port C.Out; +SWC /P/C; −Port C.In; ~Event C.T (TIMING 0.01s → TIMING 0.02s)", ("m.arxml", "Interfaces"): "+/P/I (CLIENT-SERVER)", ("c.a2l", "A2L"): "+M (MEASUREMENT); −K (CHARACTERISTIC)", ("c.c", "RTE"): "+Rte_Read_A"}


RESULTS = [("a/x.c", "identical"), ("a/b/y.c", "real-change"), ("a/b/z.c", "added"), ("top.c", "error"), ("n/n.c", "ignorable-only")]


def test_nodes_order_and_navigation(spark):
    res = spark.createDataFrame(RESULTS, "rel string, status string")
    tree = {r["path"]: (r["parent"], r["depth"], r["is_dir"], r["status"]) for r in report.nodes(res).collect()}
    assert tree == {"a": ("", 1, True, "real-change"), "a/b": ("a", 2, True, "real-change"), "n": ("", 1, True, "ignorable-only"), "a/x.c": ("a", 2, False, "identical"), "a/b/y.c": ("a/b", 3, False, "real-change"), "a/b/z.c": ("a/b", 3, False, "added"),
                    "top.c": ("", 1, False, "error"), "n/n.c": ("n", 2, False, "ignorable-only")}
    assert {r["path"] for r in report.nodes(res, "X.C").collect()} == {"a", "a/x.c"} and report.nodes(res, "x.c", hide_identical=True).isEmpty()
    assert [r["rel"] for r in report.detail_order(res).orderBy("place", "rel").collect()] == ["top.c", "a/b/y.c", "n/n.c", "a/b/z.c"]
    assert (report.after(res, "a/b/y.c"), report.after(res, "top.c"), report.after(res, "a/b/y.c", back=True)) == ("a/b/z.c", "a/b/y.c", "top.c")


def test_review_of_binaries_folders_and_stops(spark):
    files = spark.createDataFrame([("d/a.bin", "real-change", None, True, b"\x00x"), ("d/b.c", "added", "int b;", False, b"int b;"), ("d/lost.bin", "real-change", None, True, None), ("e.c", "real-change", "x", False, b"x")], "rel string, status string, text string, binary boolean, content binary")
    units = review.file_units(files)
    assert {r["rel"] for r in units.collect()} == {"d/a.bin", "d/b.c"}
    entries = units.where("rel = 'd/b.c'").select("rel", "unit_key", F.lit("ok").alias("note"), F.lit(True).alias("reviewed"))
    assert {r["path"]: (r["units"], r["reviewed"], r["done"]) for r in review.folder_tally(units, entries).collect()} == {"": (2, 1, False), "d": (2, 1, False), "d/a.bin": (1, 0, False), "d/b.c": (1, 1, True)}
    assert review.marks_changed(entries, units, True).first()["changed"] == 1
    stops = spark.createDataFrame([("d/b.c", 0), ("f.c", 0), ("f.c", 1)], "rel string, hunk_idx int")
    more = units.unionByName(spark.createDataFrame([("f.c", "k#0", 1, "here")], "rel string, unit_key string, hunk_idx int, label string"))
    assert {(r["rel"], r["hunk_idx"]): r["label"] for r in review.units_at(stops, more).collect()} == {("d/b.c", 0): "whole file", ("f.c", 0): None, ("f.c", 1): "here"}


def test_group_notes(spark):
    groups = spark.createDataFrame([("a", 0, "real", "w0"), ("a", 1, "comment", "w0"), ("a", 2, "moved", "w1")], "rel string, hunk_idx int, kind string, grp string")
    units = spark.createDataFrame([("a", 0, "p"), ("a", 2, "q")], "rel string, hunk_idx int, unit_key string")
    entries = spark.createDataFrame([("a", "p", True)], "rel string, unit_key string, reviewed boolean")
    assert {r["grp"]: (r["units"], r["reviewed"], r["done"]) for r in report.group_notes(groups, units, entries).collect()} == {"w0": (1, 1, True), "w1": (1, 0, False)}


def test_json_document(spark, tmp_path):
    res = spark.createDataFrame([("b.c", "real-change", False, [], {}, [("real", 0, 1, 0, 1, None, None), ("moved", 2, 2, 2, 3, None, 5)]), ("a.c", "identical", False, [], {}, []), ("c.c", "error", False, ["lost"], {"p": "q"}, [])], f"rel string, status string, binary boolean, notes array<string>, renames map<string,string>, hunks {HUNK}")
    advice = spark.createDataFrame([("m", "said")], "model string, message string")
    sinks.write_json(res, str(tmp_path / "x.json"), "o", "n", "old name", None, advice)
    doc = json.loads((tmp_path / "x.json").read_text())
    assert {k: doc[k] for k in ("schema", "baseline", "current", "baseline_label", "exit_code", "consistency")} == {"schema": 1, "baseline": "o", "current": "n", "baseline_label": "old name", "exit_code": 2, "consistency": [{"model": "m", "message": "said"}]}
    assert "current_label" not in doc and doc["generated"] and doc["version"] and list(doc["summary"].values()) == [1, 0, 0, 1, 0, 0, 1]
    assert doc["files"] == [{"path": "a.c", "status": "identical", "binary": False}, {"path": "b.c", "status": "real-change", "binary": False, "hunks": [{"kind": "real", "old_range": [0, 1], "new_range": [0, 1]}, {"kind": "moved", "old_range": [2, 2], "new_range": [2, 3], "moved_from": 5}]},
                            {"path": "c.c", "status": "error", "binary": False, "notes": ["lost"], "renames": {"p": "q"}}]


def test_sources_named(tmp_path):
    import subprocess

    repo = tmp_path / "r"
    (repo / "sub").mkdir(parents=True)
    (repo / "sub" / "f.c").write_text("x")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    assert trees.rel_in_repo(str(repo / "sub")) == "sub" and trees.rel_in_repo(str(repo)) == ""
    assert trees.resolve(str(repo), "HEAD") == trees.git_log(str(repo))[0][0]
    for wrong in ("--all", "nothing"):
        try:
            trees.resolve(str(repo), wrong)
            raise AssertionError
        except trees.SourceError:
            pass
    assert trees.review_path(str(tmp_path / "new")) == str(tmp_path / "codegen-review.json") and trees.label("/x/model.zip") == "model.zip"


def test_command_line_with_review_and_names(spark, tmp_path, capsys):
    from driftlens.__main__ import main, write_hint

    for side, said in (("old", "int a = 1;\nint b;\n"), ("new", "int a = 2;\nint b;\n")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "m.c").write_text(said)
    review_file = tmp_path / "r.json"
    trees.save_review(str(review_file), {"m.c": {"k#0": {"note": "seen", "reviewed": True}}})
    html, doc = tmp_path / "out.html", tmp_path / "out.json"
    args = [str(tmp_path / "old"), str(tmp_path / "new"), "--report", str(html), "--json", str(doc), "--review", str(review_file), "--baseline-name", "Before", "--current-name", "After"]
    assert main(args, spark) == 1
    said = html.read_text()
    assert all(x in said for x in ("Before and After", "<h2>Review</h2>", "<h2>Overview</h2>", "<h2>m.c</h2>", "int a = <b>2</b>;"))
    found = json.loads(doc.read_text())
    assert (found["baseline_label"], found["current_label"], found["consistency"]) == ("Before", "After", [])
    assert main([*args[:2], "--json", str(tmp_path / "no" / "x.json")], spark) == 2
    assert "does not exist" in capsys.readouterr().err and "read-only" in write_hint(str(doc), PermissionError(13, "no"))
