"""python -m driftlens OLD NEW: compares two folders or zip archives. Exit code 0: no change, 1: changes, 2: errors."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import review, rollup, scopes
from driftlens.operators import report as reports
from driftlens.plans import compare, html_report, sinks
from driftlens.sources import trees
from driftlens.sources.stored import checkpointed


# What reports are called unless told otherwise.
REPORT, ARXML_REPORT = "compare_report.html", "arxml_update.html"


def write_hint(path: str, e: OSError) -> str:
    """Why a file could not be written, with what is mostly the cause."""
    why = e.strerror or str(e)
    if not os.path.isdir(os.path.dirname(os.path.abspath(path))):
        why += f" -- the folder {os.path.dirname(path)} does not exist"
    elif isinstance(e, PermissionError):
        why += " -- the file may be open elsewhere, or read-only"
    return f"{path}: {why}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftlens", description=__doc__)
    p.add_argument("old")
    p.add_argument("new")
    for name in ("json", "sarif"):
        p.add_argument(f"--{name}", metavar="FILE")
    p.add_argument("--report", metavar="FILE", nargs="?", const=REPORT)
    p.add_argument("--report-sections", metavar="FOLDER", help="the report as section files with an index, for reports too large for one file")
    p.add_argument("--arxml-report", metavar="FILE", nargs="?", const=ARXML_REPORT)
    p.add_argument("--include", action="append", default=[], metavar="GLOB")
    p.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    p.add_argument("--arxml-only", action="store_true")
    p.add_argument("--fold", action="append", default=[], choices=rollup.FOLDABLE)
    p.add_argument("--exit-zero", action="store_true")
    p.add_argument("--review", metavar="FILE", help="sign-offs; those of the current tree stand in the report")
    p.add_argument("--baseline-name", metavar="NAME")
    p.add_argument("--current-name", metavar="NAME")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    outputs = [x for x in (args.report, args.arxml_report, args.json, args.sarif) if x]
    spark = spark or SparkSession.builder.appName("driftlens").getOrCreate()
    try:
        for path in outputs:  # no stale file may pass for this run's
            if os.path.exists(path):
                os.remove(path)
        include = args.include + ([f"*{e}" for e, r in text.RULESETS.items() if r in ("arxml", "a2l")] if args.arxml_only else [])
        old, new = (trees.read_tree(spark, x, include, args.exclude) for x in (args.old, args.new))
        results = checkpointed(rollup.fold(compare.scan(old, new, include, args.exclude), tuple(args.fold)))
        texts = [t.where("list_error is null").select("rel", text.decode(F.col("content")).alias("text")) for t in (old, new)]
        found = checkpointed(compare.tree_facts(results, *texts))
        groups = checkpointed(rollup.model_groups(results.select("rel")))
        advice = checkpointed(rollup.advisories(results.join(compare.parsed_files(results, *texts), "rel", "left"), groups, found))
        for r in sinks.summary_lines(results, found, advice).orderBy("section", "ord").toLocalIterator():
            print(r["line"])
        code = rollup.exit_code(results, args.exit_zero).first()["exit_code"]
    except (OSError, trees.SourceError) as e:
        print(e, file=sys.stderr)
        return 2
    if not any((*outputs, args.report_sections)):
        return code
    names = args.baseline_name or trees.label(args.old), args.current_name or trees.label(args.new)

    def fragments() -> DataFrame:
        tops = {"Advisories": advice, "Overview": reports.overview(results, groups, found), "Changes of the model": scopes.summary_rows(found).drop("key")}
        if args.review:
            entries = trees.review_entries(results.sparkSession, args.review)
            tops["Review"] = review.tally(review.hunk_units(html_report.pairs_of(results, *texts)), entries)
        return html_report.fragments(results, *texts, title, tops, reports.notes(found))

    title = f"{names[0]} and {names[1]}"
    outputs = (
        (args.json, lambda p: sinks.write_json(results, p, args.old, args.new, args.baseline_name, args.current_name, advice)),
        (args.sarif, lambda p: sinks.write_sarif(results, p)),
        (args.report, lambda p: html_report.write_file(fragments(), p, title)),
        (args.report_sections, lambda p: html_report.write_sections(fragments(), p, title)),
        (args.arxml_report, lambda p: sinks.write_arxml_report(results, scopes.summary_rows(found), p)),
    )
    for path, put in outputs:
        try:
            if path:
                put(path)
        except OSError as e:
            print(f"results could not be written: {write_hint(path, e)}", file=sys.stderr)
            return 2
    return code


if __name__ == "__main__":
    sys.exit(main())
