"""The HTML report as a frame of fragments (place, rel, row_no, sub, html), which Spark renders; in that order they are the report.

They are written as one file, or, for reports of any size, as sorted section files with an index by the `driftlens_report`
sink, whose tasks write their own files; the driver gets a line about each.
"""

from __future__ import annotations

import html
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from driftlens.functions import text
from driftlens.operators import layout, report, scopes
from driftlens.operators.rollup import STATUSES, status_summary

PART = ("place", "rel", "row_no", "sub")
#: Places before those of report.DETAIL_ORDER: the title, the banner, tables, the tree. Row numbers around those of lines.
TITLE, BANNER, TABLES, TREE, HEAD, END = -100, -99, -90, -50, -1, 2**31 - 1
#: Scopes that a file's heading names: what it is, not a limit on work.
NAMED = 3


def esc(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def cell(x: Column) -> Column:
    return F.concat(F.lit("<td>"), F.coalesce(esc(x.cast("string")), F.lit("")))


def _part(rows: DataFrame, place, rel, row_no, sub, said: Column) -> DataFrame:
    as_is = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(as_is(place).cast("int").alias("place"), as_is(rel).cast("string").alias("rel"), as_is(row_no).cast("int").alias("row_no"), as_is(sub).cast("int").alias("sub"), said.alias("html"))


def marked(own: Column, lo: Column, hi: Column) -> Column:
    """A line with its changed stretch in bold."""
    cut = lambda a, n: esc(F.substr(own, a + 1, n))
    return F.concat(F.lit("<td>"), cut(F.lit(0), lo), F.when(lo < hi, F.concat(F.lit("<b>"), cut(lo, hi - lo), F.lit("</b>"))).otherwise(""), cut(hi, F.length(own)))


def pairs_of(results: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """rel, rules, old_text, new_text and hunks of files with hunks; a moved file's old text is that of the path it had."""
    was = F.coalesce("moved_from", "rel") if "moved_from" in results.columns else F.col("rel")
    some = results.where(F.size("hunks") > 0).select("rel", was.alias("was"), "hunks")
    a, b = (t.select(F.col("rel").alias(k), text.unix_lines(F.col("text")).alias(c)) for t, k, c in ((old, "was", "old_text"), (new, "rel", "new_text")))
    return some.join(a, "was").join(b, "rel").select("rel", text.ruleset(F.col("rel")).alias("rules"), "old_text", "new_text", "hunks")


def fragments(results: DataFrame, old: DataFrame, new: DataFrame, title: str, tops: dict[str, DataFrame] | None = None, notes: DataFrame | None = None) -> DataFrame:
    """PART and html of the report of results on two trees (rel, text), with tables on top by title. notes: rel, note."""
    spark = results.sparkSession
    one = spark.range(1)
    counts = F.concat(*[F.concat(F.lit(f"<li>{s}: "), F.col(s.replace("-", "_")).cast("string")) for s in STATUSES])
    out = [_part(one, TITLE, "", 0, 0, F.lit(f"<h1>{html.escape(title)}</h1>")), _part(status_summary(results), TITLE, "", 1, 0, F.concat(F.lit("<ul>"), counts, F.lit("</ul>")))]
    lost = results.where("status = 'error'")
    banner = F.concat(F.lit("<p class=error>COMPARE INCOMPLETE: "), F.col("n").cast("string"), F.lit(" path(s) could not be compared; treat them as changed"))
    out.append(_part(lost.agg(F.count("*").alias("n")).where("n > 0"), BANNER, "", 0, 0, banner))
    out.append(_part(lost, BANNER, F.col("rel"), 1, 0, F.concat(F.lit("<p class=error>"), esc(F.col("rel")), F.lit(": "), esc(F.array_join("notes", "; ")))))
    for k, (name, table) in enumerate((tops or {}).items()):
        head = f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}" for c in table.columns)
        key = F.to_json(F.struct(*table.columns))
        out += [_part(one, TABLES + k, "", HEAD, 0, F.lit(head)), _part(table, TABLES + k, key, 0, 0, F.concat(F.lit("<tr>"), *[cell(F.col(c)) for c in table.columns])), _part(one, TABLES + k, "\U0010ffff", END, 0, F.lit("</table>"))]
    tree = report.nodes(results)
    name = F.substring_index("path", "/", -1)
    out.append(_part(tree, TREE, F.when(F.col("is_dir"), F.concat("path", F.lit("/"))).otherwise(F.col("path")), 0, 0, F.concat(F.lit('<p style="margin-left:'), F.col("depth").cast("string"), F.lit('em">'), esc(name), F.when(F.col("is_dir"), "/").otherwise(""), F.lit(" "), "status")))
    return _union([*out, *_sections(results, old, new, notes)])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _sections(results: DataFrame, old: DataFrame, new: DataFrame, notes: DataFrame | None) -> list[DataFrame]:
    shown = results.where((F.size("hunks") > 0) | F.col("status").isin("error", "real-change", "added", "deleted"))
    places = report.detail_order(shown).select("rel", "place")
    pairs = pairs_of(results, old, new)
    labels = {s: scopes.scope_labels(pairs.select("rel", F.col(f"{s}_text").alias("text"))).select("rel", "labels") for s in ("old", "new")}
    both = pairs.select("rel", "hunks").join(labels["old"].withColumnRenamed("labels", "_old"), "rel").join(labels["new"].withColumnRenamed("labels", "_new"), "rel")
    touched = both.select("rel", scopes.affected(F.col("_old"), F.col("_new"), F.col("hunks")).alias("scopes"))
    said = notes.groupBy("rel").agg(F.array_join(F.sort_array(F.collect_list("note")), "; ").alias("more")) if notes is not None else results.select("rel", F.lit(None).cast("string").alias("more")).limit(0)
    moved = F.lit(None).cast("string")
    if "moved_from" in results.columns:
        other = F.coalesce("moved_from", "moved_to")
        moved = F.when(other.isNotNull(), scopes.move_said(other, F.col("moved_from").isNotNull(), F.col("move_status"), F.col("move_similarity")))
    more = F.when(F.size("scopes") > NAMED, F.concat(F.lit(" (+"), (F.size("scopes") - NAMED).cast("string"), F.lit(")"))).otherwise("")
    affected = F.when(F.size("scopes") > 0, F.concat(F.lit("affects "), F.array_join(F.slice("scopes", 1, NAMED), ", "), more))
    heads = shown.join(places, "rel").join(said, "rel", "left").join(touched, "rel", "left")
    lines = F.concat(*[F.coalesce(F.concat(F.lit("<p>"), esc(F.when(x != "", x))), F.lit("")) for x in (F.col("status"), F.array_join("notes", "; "), moved, affected, F.col("more"))])
    out = [_part(heads, F.col("place"), F.col("rel"), HEAD, 0, F.concat(F.lit("<h2>"), esc(F.col("rel")), F.lit("</h2>"), lines, F.lit("<table>"))), _part(heads, F.col("place"), F.col("rel"), END, 0, F.lit("</table>"))]
    hunks = pairs.select("rel", F.posexplode("hunks").alias("hunk_idx", "h")).select("rel", "hunk_idx", "h.*")
    rows = report.row_labels(report.shown_rows(layout.aligned_rows(pairs), report.hunk_groups(hunks)), labels["old"], labels["new"]).join(places, "rel")
    changed = F.when((F.col("mode") == "real") & F.col("old_txt").isNotNull() & F.col("new_txt").isNotNull(), scopes.char_span(F.col("old_txt"), F.col("new_txt")))
    rows = rows.withColumn("span", changed)
    side = lambda s: F.concat(cell(F.col(f"{s}_no")), F.when(F.col("span").isNotNull(), marked(F.col(f"{s}_txt"), F.col(f"span.{s}_lo"), F.col(f"span.{s}_hi"))).otherwise(cell(F.col(f"{s}_txt"))))
    code = F.when(F.col("what") == "code", F.concat(F.lit("<tr class="), "mode", F.lit(">"), side("old"), side("new"))).otherwise(F.concat(F.lit("<tr class="), "what", F.lit("><td colspan=4>"), esc(F.col("said"))))
    out.append(_part(rows, F.col("place"), F.col("rel"), F.col("row_no"), F.col("sub"), code))
    first = rows.groupBy("place", "rel", "grp").agg(F.min_by("label", F.when(F.col("mode") != "ctx", F.col("row_no"))).alias("label"), F.min("row_no").alias("row_no"))
    out.append(_part(first, F.col("place"), F.col("rel"), F.col("row_no"), -1, F.concat(F.lit("<tr class=scope><td colspan=4>"), F.coalesce(F.concat(F.lit("ƒ "), esc(F.col("label"))), F.lit("⋯")))))
    alone = results.where(F.col("status").isin("added", "deleted") & ~F.coalesce("binary", F.lit(False)) & (F.size("hunks") == 0)).select("rel", "status").join(places, "rel")
    for tree, status in ((old, "deleted"), (new, "added")):
        content = layout.one_sided(tree.join(alone.where(F.col("status") == status).select("rel"), "rel", "left_semi").select("rel", text.unix_lines(F.col("text")).alias("text"))).join(places, "rel")
        out.append(_part(content, F.col("place"), F.col("rel"), F.col("line_no"), 0, F.concat(F.lit(f"<tr class={status}>"), cell(F.col("line_no")), cell(F.col("txt")))))
    return out


PAGE = '<!DOCTYPE html><meta charset=utf-8><title>{}</title>\n'


def write_file(parts: DataFrame, path: str, title: str) -> None:
    """One file; fragments pass by a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(PAGE.format(html.escape(title)))
        for r in parts.orderBy(*PART).select("html").toLocalIterator():
            f.write(r["html"] + "\n")


@dataclass
class Section(WriterCommitMessage):
    file: str
    first: str
    last: str
    n: int


class SectionWriter(DataSourceWriter):
    """A section file per task, under a name of its own until all have succeeded; the commit names and lists them."""

    def __init__(self, folder: str, title: str):
        self.folder, self.title = folder, title
        os.makedirs(folder, exist_ok=True)

    def write(self, iterator: Iterator[Row]) -> Section:
        from pyspark import TaskContext

        context = TaskContext.get()
        out = Section(f"part-{context.partitionId():05d}-{context.taskAttemptId()}.tmp", "", "", 0)
        with open(os.path.join(self.folder, out.file), "w", encoding="utf-8") as f:
            f.write(PAGE.format(html.escape(self.title)))
            for r in iterator:
                f.write(r["html"] + "\n")
                out.first, out.last, out.n = (out.first if out.n else r["rel"]), r["rel"], out.n + 1
        return out

    def commit(self, messages: list[Section | None]) -> None:
        listed = []
        for k, m in enumerate(sorted((m for m in messages if m), key=lambda m: m.file)):
            if m.n:
                name = f"section-{k:05d}.html"
                os.replace(os.path.join(self.folder, m.file), os.path.join(self.folder, name))
                listed.append(f'<li><a href="{name}">{html.escape(m.first or self.title)} to {html.escape(m.last or self.title)}</a>')
            else:
                os.remove(os.path.join(self.folder, m.file))
        with open(os.path.join(self.folder, "index.html"), "w", encoding="utf-8") as f:
            f.write(PAGE.format(html.escape(self.title)) + f"<h1>{html.escape(self.title)}</h1><ol>" + "\n".join(listed) + "</ol>\n")

    def abort(self, messages: list[Section | None]) -> None:
        for m in messages:
            if m and os.path.exists(path := os.path.join(self.folder, m.file)):
                os.remove(path)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "driftlens_report"

    def schema(self) -> str:
        return "place int, rel string, row_no int, sub int, html string"

    def writer(self, schema, overwrite: bool) -> SectionWriter:
        return SectionWriter(self.options["path"], self.options.get("title", "Comparison"))


def write_sections(parts: DataFrame, folder: str, title: str) -> None:
    """Section files in order under a folder that all executors see, and index.html. A file's section is in one of them."""
    parts.sparkSession.dataSource.register(ReportSink)
    parts.repartitionByRange("place", "rel").sortWithinPartitions(*PART).write.format("driftlens_report").option("title", title).mode("append").save(folder)
