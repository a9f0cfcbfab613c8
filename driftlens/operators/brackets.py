"""Scopes of C and A2L files by matching brackets, as relations: depth is a running sum, a bracket's partner its next neighbour of equal depth.

The rows are those of scopes.labels(), without a function of a whole file: a file's tokens are rows, sorted by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators.scopes import A2L_EDGE, C_HEAD, C_TAG

SO_FAR = (Window.unboundedPreceding, 0)


def _java(pattern: str) -> str:
    """A pattern of Python for Spark: what a word holds is told apart by both."""
    return pattern.replace(r"[\w.\[\]]", rf"(?:{text.WORD}|[.\[\]])").replace(r"(?<!\w)", f"(?<!{text.WORD})").replace(r"\w", text.WORD)


def leveled(events: DataFrame, step: str, out: str) -> DataFrame:
    """events (rel, seq, and a step of 1, 0 or -1) with out, the running sum that never goes below zero."""
    order = Window.partitionBy("rel").orderBy("seq")
    rows = events.withColumn("_sum", F.sum(step).over(order.rowsBetween(*SO_FAR)))
    return rows.withColumn(out, F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(order.rowsBetween(*SO_FAR)))).drop("_sum")


def matched(events: DataFrame) -> DataFrame:
    """rel, level, label, lo (line) and hi (line after the last) and seq (of the closing one) of brackets that close: events (rel, seq, line, step, label).

    A closing bracket without an opening one is nothing.
    """
    rows = leveled(events, "step", "depth")
    before = F.coalesce(F.lag("depth").over(Window.partitionBy("rel").orderBy("seq")), F.lit(0))
    rows = rows.withColumn("before", before).where(~((F.col("step") < 0) & (F.col("before") == 0)))
    level = Window.partitionBy("rel", "level").orderBy("seq")
    rows = rows.withColumn("level", F.greatest("depth", "before"))
    ends = rows.withColumns({"hi": F.lead("line").over(level) + 1, "end": F.lead("seq").over(level)})
    return ends.where((F.col("step") > 0) & F.col("hi").isNotNull()).select("rel", "level", "label", F.col("line").alias("lo"), "hi", F.col("end").alias("seq"))


def innermost(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """lines (rel, line) with label: that of the smallest span that holds the line, of equal ones the one that closes last."""
    covered = spans.where("label is not null").select("rel", "label", F.struct((F.col("hi") - F.col("lo")).alias("size"), (-F.col("seq")).alias("late")).alias("key"), F.explode(F.sequence("lo", F.col("hi") - 1)).alias("line"))
    best = covered.groupBy("rel", "line").agg(F.min_by("label", "key").alias("label"))
    return lines.join(best, ["rel", "line"], "left")


def a2l_spans(code: DataFrame) -> DataFrame:
    """Spans of blocks of lines (rel, line, code) without comments and strings."""
    p = F.lit(_java(f"(?i){A2L_EDGE.pattern}"))
    parts = F.arrays_zip(*[F.regexp_extract_all("code", p, k).alias(n) for k, n in ((1, "edge"), (2, "kind"), (3, "name"))])
    rows = code.select("rel", "line", F.posexplode(parts).alias("k", "e"))
    opens = F.lower("e.edge") == "begin"
    label = F.when(opens, F.when(F.coalesce(F.col("e.name"), F.lit("")) != "", F.col("e.name")).otherwise(F.col("e.kind")))
    return matched(rows.select("rel", (F.col("line").cast("long") * (1 << 20) + F.col("k")).alias("seq"), "line", F.when(opens, 1).otherwise(-1).alias("step"), label.alias("label")))


def c_name(head: Column) -> Column:
    """The function, or else the struct, union or enum, whose brace follows head."""
    some = lambda p: F.nullif(F.regexp_extract(head, p, 1), F.lit(""))
    return F.coalesce(some(_java(f"^(?:{C_HEAD.pattern})")), F.when(~F.contains(head, F.lit("#")), some(_java(C_TAG.pattern))))


def c_spans(code: DataFrame) -> DataFrame:
    """Spans of functions and types at the outermost level of lines (rel, line, code) without comments, strings and directives."""
    pieces = F.regexp_extract_all("code", F.lit(r"[(){};]|[^(){};]+"), 0)
    rows = code.select("rel", "line", F.posexplode(F.concat(pieces, F.array(F.lit("\n")))).alias("k", "x"))
    rows = rows.withColumn("seq", F.col("line").cast("long") * (1 << 20) + F.col("k"))
    step = lambda a, z: F.when(F.col("x") == a, 1).when(F.col("x") == z, -1).otherwise(0)
    rows = leveled(leveled(rows.withColumns({"step": step("{", "}"), "paren": step("(", ")")}), "paren", "parens"), "step", "depth")
    order = Window.partitionBy("rel").orderBy("seq")
    rows = rows.withColumn("outer", F.coalesce(F.lag("depth").over(order), F.lit(0)) == 0)
    # A head ends at a brace, or at a semicolon outside of parentheses.
    resets = F.when((F.col("step") != 0) | (F.col("x") == ";") & (F.col("parens") == 0), 1).otherwise(0)
    rows = rows.withColumn("resets", resets).withColumn("part", F.sum("resets").over(order.rowsBetween(*SO_FAR)) - F.col("resets"))
    told = F.col("outer") & (F.col("step") == 0) & (F.col("x") != ";")
    heads = rows.where(told).groupBy("rel", "part").agg(
        F.trim(F.translate(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x"))), lambda t: t["x"]), ""), "\n", " ")).alias("head"),
        F.min(F.when(F.trim(F.translate("x", "\n\t", "  ")) != "", F.col("line"))).alias("start"))
    events = rows.where("step <> 0").join(heads, ["rel", "part"], "left")
    named = F.when(F.col("outer") & (F.col("step") > 0), c_name(F.coalesce("head", F.lit(""))))
    return matched(events.select("rel", "seq", F.when(F.col("step") > 0, F.coalesce("start", "line")).otherwise(F.col("line")).alias("line"), "step", named.alias("label")))


def label_rows(files: DataFrame) -> DataFrame:
    """rel, line (from 0) and label of each line of the C and A2L files among files (rel, text)."""
    rules = text.ruleset(F.col("rel"))
    lines = {}
    for name in ("c", "a2l"):
        bare = text.blank_strings(text.strip_comments(F.col("text"), name), name)
        bare = text.strip_directives(bare) if name == "c" else bare
        lines[name] = files.where(rules == name).select("rel", F.posexplode(F.split(bare, "\n", -1)).alias("line", "code"))
    spans = c_spans(lines["c"]).unionByName(a2l_spans(lines["a2l"]))
    return innermost(lines["c"].unionByName(lines["a2l"]).select("rel", "line"), spans)
