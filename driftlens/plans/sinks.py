"""Results as JSON, SARIF, terminal lines and HTML. Rows are rendered by Spark; one document is put together by the caller."""

from __future__ import annotations

import datetime
import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens import __version__
from driftlens.functions.text import ruleset
from driftlens.operators.rollup import STATUSES, exit_code, status_summary
from driftlens.operators.scopes import move_said

# Fixed values.
LEVELS = {"error": "error", "real-change": "warning", "added": "warning", "deleted": "warning"}
RULE_NAMES = {"error": "CompareIncomplete", "real-change": "Modified", "added": "Added", "deleted": "Deleted"}


def file_entries(results: DataFrame) -> DataFrame:
    """(rel, entry): each file's result as JSON. Empty notes, renames and hunks are left out, as is what a file doesn't have.

    Of moved files also moved_from or moved_to, move_status and move_similarity, if results has them.
    """
    hunks = F.transform("hunks", lambda h: F.struct(h["kind"].alias("kind"), F.array(h["i1"], h["i2"]).alias("old_range"), F.array(h["j1"], h["j2"]).alias("new_range"), h["moved_to"].alias("moved_to"), h["moved_from"].alias("moved_from")))
    some = lambda c, x: F.when(F.size(c) > 0, x).alias(c)
    moved = [c for c in ("moved_from", "moved_to", "move_status", "move_similarity") if c in results.columns]
    entry = F.struct(F.col("rel").alias("path"), "status", "binary", some("notes", F.col("notes")), some("renames", F.col("renames")), some("hunks", hunks), *moved)
    return results.select("rel", F.to_json(entry).alias("entry"))


def message(status: Column, hunks: Column, binary: Column, notes: Column) -> Column:
    real, moved = (F.size(F.filter(F.transform(hunks, lambda h: h["kind"]), _is(kind))) for kind in ("real", "moved"))
    changed = F.when(binary, F.lit("Modified (binary)")).otherwise(F.concat(F.lit("Modified: "), real.cast("string"), F.lit(" hunk(s)"), F.when(moved > 0, F.concat(F.lit(", "), moved.cast("string"), F.lit(" moved"))).otherwise(F.lit(""))))
    lost = F.concat(F.lit("NOT compared -- treat as potentially changed: "), F.when(F.size(notes) > 0, F.array_join(notes, "; ")).otherwise(F.lit("unknown")))
    return F.when(status == "real-change", changed).when(status == "error", lost).when(status == "added", "Added").otherwise("Deleted")


def _is(kind: str):
    return lambda k: k == kind


def findings(results: DataFrame, *more: str) -> DataFrame:
    """(rel, rule_id, level, message), and more columns, of files that need action."""
    rows = results.where(F.col("status").isin(*LEVELS))
    return rows.select("rel", F.col("status").alias("rule_id"), F.when(F.col("status") == "error", "error").otherwise("warning").alias("level"), message(F.col("status"), F.col("hunks"), F.col("binary"), F.col("notes")).alias("message"), *more)


def sarif_results(results: DataFrame) -> DataFrame:
    """(rel, result): SARIF results as JSON."""
    uri = F.struct(F.struct(F.struct(F.col("rel").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    return findings(results).select("rel", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(uri).alias("locations"))).alias("result"))


def _document(path: str, head: str, rows: DataFrame, column: str, foot: str) -> None:
    """One file of head, rows in order of path, and foot. Spark makes the rows; they pass through a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(head)
        for k, r in enumerate(rows.orderBy("rel").toLocalIterator()):
            f.write(("," if k else "") + "\n" + r[column])
        f.write(foot)


def write_parts(rows: DataFrame, column: str, path: str) -> None:
    """Rows as lines of text files that Spark writes under path, in order of rel: for results too many for one file."""
    rows.repartitionByRange("rel").sortWithinPartitions("rel").select(F.col(column).alias("value")).write.text(path)


def write_sarif(results: DataFrame, path: str) -> None:
    """A SARIF 2.1.0 log."""
    rules = [{"id": s, "name": RULE_NAMES[s], "shortDescription": {"text": RULE_NAMES[s]}} for s in LEVELS]
    run = json.dumps({"tool": {"driver": {"name": "driftlens", "version": __version__, "rules": rules}}})[:-1]
    _document(path, '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [' + run + ', "results": [', sarif_results(results), "result", "]}]}\n")


def document_head(results: DataFrame, baseline: str, current: str, baseline_label: str | None = None, current_label: str | None = None, advisories: DataFrame | None = None) -> dict:
    """What the JSON document of schema 1 says of a comparison as a whole. advisories: model, message."""
    summary, code = status_summary(results).first().asDict(), exit_code(results).first()["exit_code"]
    said = [] if advisories is None else [{"model": r["model"], "message": r["message"]} for r in advisories.orderBy("model", "message").toLocalIterator()]
    head = {"schema": 1, "tool": "driftlens", "version": __version__, "generated": datetime.datetime.now().isoformat(timespec="seconds"), "baseline": baseline, "current": current}
    head |= {"summary": {s: summary[s.replace("-", "_")] for s in STATUSES}, "exit_code": code, "consistency": said}
    return head | {k: v for k, v in (("baseline_label", baseline_label), ("current_label", current_label)) if v}


def write_json(results: DataFrame, path: str, baseline: str = "", current: str = "", baseline_label: str | None = None, current_label: str | None = None, advisories: DataFrame | None = None) -> None:
    """The JSON document of schema 1."""
    head = document_head(results, baseline, current, baseline_label, current_label, advisories)
    _document(path, json.dumps(head, ensure_ascii=False)[:-1] + ', "files": [', file_entries(results), "entry", "]}\n")


# Of each kind of fact, the title of its section and what a line calls it.
FACT_LINES = {
    "iface": ("ARXML interfaces", ""), "swc": ("AUTOSAR behavior", "SWC "), "port": ("AUTOSAR behavior", "port "), "runnable": ("AUTOSAR behavior", "runnable "), "event": ("AUTOSAR behavior", "event "), "rte": ("RTE access points", ""), "a2l": ("A2L objects", ""),
}


def fact_lines(facts: DataFrame) -> DataFrame:
    """(section, ord, line) of fact differences for the terminal: a count for each kind, and a line for each difference."""
    titles = {t: 3 + k for k, t in enumerate(dict.fromkeys(t for t, _ in FACT_LINES.values()))}
    lookup = lambda of: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    kind = F.col("fact_type")
    inside = F.when(F.col("owner").isNotNull(), F.concat(F.substring_index("owner", "/", -1), F.lit("."))).otherwise("")
    descr = F.coalesce("descr", "old_descr", F.lit(""))
    shown = F.when(F.col("change") == "~", F.concat(F.lit(" ("), "old_descr", F.lit(" -> "), "descr", F.lit(")"))).when(kind == "swc", "").when(descr == "", "").otherwise(F.concat(F.lit(" ("), F.when(kind == "iface", F.regexp_replace(descr, "-INTERFACE$", "")).otherwise(descr), F.lit(")")))
    title = lookup({k: t for k, (t, _) in FACT_LINES.items()})[kind]
    line = F.concat(F.lit("  "), "change", F.lit(" "), lookup({k: n for k, (_, n) in FACT_LINES.items()})[kind], inside, "name", shown, F.lit(" in "), "rel")
    order = F.concat_ws("\x01", F.translate("change", "+-~", "123"), "rel", "name")
    rows = facts.where(kind.isin(*FACT_LINES)).select(title.alias("title"), lookup(titles)[title].alias("section"), "change", order.alias("ord"), line.alias("line"))
    n = lambda x: F.sum(F.when(F.col("change") == x, 1).otherwise(0)).cast("string")
    said = F.when(F.col("title") == "AUTOSAR behavior", F.concat(F.lit("AUTOSAR behavior: "), F.count("*").cast("string"), F.lit(" change(s)"))).otherwise(F.concat("title", F.lit(": "), n("+"), F.lit(" added, "), n("-"), F.lit(" removed")))
    heads = rows.groupBy("section", "title").agg(said.alias("line")).select("section", F.lit("").alias("ord"), "line")
    return heads.unionByName(rows.select("section", "ord", "line"))


def summary_lines(results: DataFrame, facts: DataFrame | None = None, advisories: DataFrame | None = None) -> DataFrame:
    """(section, ord, line) of the terminal summary: counts, files that need action, moved files, facts, and advisories (model, message)."""
    counts = status_summary(results).select(F.posexplode(F.array(*[F.concat(F.lit(f"{s}: "), F.col(s.replace("-", "_")).cast("string")) for s in STATUSES])).alias("ord", "line"))
    moved = F.when(F.col("moved_from").isNotNull(), F.concat(F.lit(", "), move_said(F.col("moved_from"), F.lit(True), F.col("move_status"), F.col("move_similarity")))) if "moved_from" in results.columns else F.lit(None)
    rest = [c for c in ("moved_from", "moved_to", "move_status", "move_similarity") if c in results.columns]
    files = findings(results, *rest).select(F.lit(2).alias("section"), F.col("rel").alias("ord"), F.concat("rel", F.lit("  "), "message", F.coalesce(moved, F.lit(""))).alias("line"))
    lines = counts.select(F.lit(1).alias("section"), F.format_string("%02d", "ord").alias("ord"), "line").unionByName(files)
    lines = lines if facts is None else lines.unionByName(fact_lines(facts))
    if advisories is None:
        return lines
    said = advisories.select(F.lit(9).alias("section"), F.concat_ws("\x01", "model", "message").alias("ord"), F.concat(F.lit("  !! "), "model", F.lit(": "), "message").alias("line"))
    head = advisories.limit(1).select(F.lit(9).alias("section"), F.lit("").alias("ord"), F.lit("Consistency check:").alias("line"))
    return lines.unionByName(head).unionByName(said)


def write_arxml_report(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Verdicts of XML and A2L files, and their fact differences (scopes.summary_rows) by section; written even if empty."""
    esc = lambda x: html.escape("" if x is None else str(x))
    typed = results.where(ruleset(F.col("rel")).isin("arxml", "a2l"))
    with open(path, "w", encoding="utf-8") as f:
        f.write("<!DOCTYPE html><meta charset=utf-8><title>ARXML and A2L</title><h1>ARXML and A2L</h1>")
        for kind in ("arxml", "a2l"):
            counts = typed.where(ruleset(F.col("rel")) == kind).groupBy("status").count().orderBy("status").collect()
            f.write(f"<h2>{kind.upper()}</h2><p>" + esc(", ".join(f"{r['status']}: {r['count']}" for r in counts) or "no files") + "</p>")
        last = None
        for r in summary.orderBy("section", "sign", "name", "rel").toLocalIterator():
            f.write((f"<h3>{esc(r['section'])}</h3>" if r["section"] != last else "") + f"<p>{esc(r['sign'])} {esc(r['name'])} {esc(r['detail'])} <i>{esc(r['rel'])}</i></p>\n")
            last = r["section"]
