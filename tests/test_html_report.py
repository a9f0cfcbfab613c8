"""The report's fragments: order, escapes, labels, one-sided text, moves, the tree; as one file and as section files."""

import re

from driftlens.plans import compare, html_report

BODY = "int keep_{0};\nvoid f_{0}(void)\n{{\n  a = {1};\n}}\nvoid g(void)\n{{\n  b = {1};\n}}\nvoid h(void)\n{{\n  c = {1};\n}}\nvoid k(void)\n{{\n  d = {1};\n}}\n"
OLD = {"src/a.c": BODY.format(1, 10), "src/gone.txt": "gone <one>\nand two", "o/m.txt": "\n".join(f"moved {k}" for k in range(9)), "same.c": "1", "note.c": "/* x */\nint n;\n"}
NEW = {"src/a.c": BODY.format(1, 20), "src/new.py": 'print("<b>&")', "n/m.txt": "\n".join([*(f"moved {k}" for k in range(8)), "edited"]), "same.c": "1", "note.c": "/* y */\nint n;\n"}


def made(spark):
    old, new = (spark.createDataFrame([(k, None, v.encode()) for k, v in side.items()] + more, "rel string, list_error string, content binary") for side, more in ((OLD, []), (NEW, [("lost", "denied", None)])))
    texts = [spark.createDataFrame(list(side.items()), "rel string, text string") for side in (OLD, NEW)]
    advice = spark.createDataFrame([("M<1>", "look & see")], "model string, message string")
    return html_report.fragments(compare.scan(old, new), *texts, "Old & new", {"Advisories": advice}).cache()


def test_report_as_one_file_and_as_sections(spark, tmp_path):
    parts = made(spark)
    html_report.write_file(parts, str(tmp_path / "r.html"), "Old & new")
    said = (tmp_path / "r.html").read_text()
    for x in (
        "<h1>Old &amp; new</h1>", "<li>real-change: 1", "COMPARE INCOMPLETE: 1 path(s)", "lost: folder listing failed on CURRENT side: denied", "<h2>Advisories</h2>", "<td>M&lt;1&gt;<td>look &amp; see", '<p style="margin-left:2em">a.c real-change',
        "affects f_1, g, h (+1)", "ƒ f_1", "<td>  a = <b>10</b>;<td>4<td>  a = <b>20</b>;", "<td>gone &lt;one&gt;", "<td>print(&quot;&lt;b&gt;&amp;&quot;)", "moved from o/m.txt — and changed, 89% alike", "moved to n/m.txt", "<td><b>edited</b>",
    ):
        assert x in said, x
    order = re.findall(r"<h2>([^<]*)</h2>", said)
    assert order == ["Advisories", "lost", "src/a.c", "n/m.txt", "src/new.py", "o/m.txt", "src/gone.txt"]
    assert said.count("<table>") == said.count("</table>") and "same.c</h2>" not in said
    folder = tmp_path / "sections"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        html_report.write_sections(parts, str(folder), "Old & new")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = sorted(p.name for p in folder.iterdir())
    assert files[0] == "index.html" and len(files) > 2 and all(x.startswith("section-") for x in files[1:])
    head = html_report.PAGE.format("Old &amp; new")
    assert "".join((folder / f).read_text().removeprefix(head) for f in files[1:]) == said.removeprefix(head)
    index = (folder / "index.html").read_text()
    assert all(f'href="{f}"' in index for f in files[1:])


def test_report_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "rel string, list_error string, content binary")
    texts = spark.createDataFrame([], "rel string, text string")
    html_report.write_file(html_report.fragments(compare.scan(none, none), texts, texts, "None"), str(tmp_path / "r.html"), "None")
    assert "<li>error: 0" in (tmp_path / "r.html").read_text()
