"""Provable noise among a file's changed ranges, as relations over its lines: renames, reordered statements, moved blocks.

What classify.classify() finds file by file is here a join or a sum by file and name, line or digest, so that a file with
many changes is many rows; only a reordered block, whose lines are few, is one. The alignment of two lines' tokens is the one
step that runs as a small function of a line pair.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import names, text
from driftlens.operators.classify import MOVED_LINES, REORDER_LINES, swapped
from driftlens.operators.linediff import hunks


def solid(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.regexp_replace(x, f"{text.SPACE}+", "") != "")


def cut(lines: Column, lo: Column, hi: Column) -> Column:
    return F.slice(lines, lo + 1, hi - lo)


def line_pairs(files: DataFrame) -> DataFrame:
    """rel, old and new: the n-th line with content of either side of each range of files (rel, old_lines, new_lines, ranges)."""
    rows = files.select("rel", "old_lines", "new_lines", F.explode("ranges").alias("r"))
    both = rows.select("rel", solid(cut(F.col("old_lines"), F.col("r.i1"), F.col("r.i2"))).alias("old"), solid(cut(F.col("new_lines"), F.col("r.j1"), F.col("r.j2"))).alias("new"))
    return both.select("rel", F.explode(F.filter(F.arrays_zip("old", "new"), lambda p: p["old"].isNotNull() & p["new"].isNotNull())).alias("p")).select("rel", "p.old", "p.new")


def swaps(pairs: DataFrame) -> DataFrame:
    """rel, old and new name, each once a file, of line pairs (rel, old, new) that differ in identifiers alone."""

    @F.pandas_udf("array<struct<old:string,new:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"old": p, "new": q} for p, q in (swapped(x, y, lambda *_: True) or {}).items()] for x, y in zip(a, b, strict=True)], dtype=object)

    return pairs.where("old <> new").select("rel", F.explode(run("old", "new")).alias("s")).select("rel", "s.old", "s.new").distinct()


def renames(files: DataFrame) -> DataFrame:
    """rel, old and new of one-to-one renames that hold all over a file: files (rel, old_lines, new_lines, ranges).

    Swaps are edges between the names of both sides. An edge counts if neither end has another, the old name is gone and
    the new one was not there, neither is declared elsewhere, and checksums within them are all that differs in it.
    """
    edges = swaps(line_pairs(files))
    one = [edges.groupBy("rel", c).agg(F.count("*").alias("n")).where("n = 1").select("rel", c) for c in ("old", "new")]
    here = {c: files.select("rel", F.explode(text.identifiers(F.array_join(f"{c}_lines", "\n"))).alias("name")) for c in ("old", "new")}
    alone = edges.join(one[0], ["rel", "old"], "left_semi").join(one[1], ["rel", "new"], "left_semi")
    alone = alone.join(here["new"].withColumnRenamed("name", "old"), ["rel", "old"], "left_anti").join(here["old"].withColumnRenamed("name", "new"), ["rel", "new"], "left_anti")
    return alone.where(~names.is_authored(F.col("old")) & ~names.is_authored(F.col("new")) & names.same_checksummed(F.col("old"), F.col("new"))).select("rel", "old", "new")


#: A scalar assignment: what is written, and the value.
ASSIGNMENT = rf"^\s*({text.IDENT})\s*=\s*([^=;][^;]*);\s*$"


def shape(line: Column) -> Column:
    """line, and what is written and the value if it is a scalar assignment; else these are empty."""
    return F.struct(line.alias("line"), F.regexp_extract(line, ASSIGNMENT, 1).alias("written"), F.regexp_extract(line, ASSIGNMENT, 2).alias("value"))


def fits(s: Column) -> Column:
    """Whether a shape() is a statement: a scalar assignment without calls."""
    return (s["written"] != "") & ~s["written"].isin(*text.KEYWORDS) & ~(F.contains(s["value"], F.lit("(")) & s["value"].rlike(rf"{text.IDENT}\s*\("))


def statement(s: Column) -> Column:
    """content, written and read of a shape() that fits."""
    content = names.canonical_generated(F.regexp_replace(F.trim(s["line"]), ";$", ""))
    return F.struct(content.alias("content"), s["written"].alias("written"), text.identifiers(s["value"]).alias("read"))


def commutes(said: Column, order: Column, n: Column) -> Column:
    """Whether n statement()s, each of its own content, come once each in an order, of their places, that no name's readers and writers notice.

    That is, another order in which no two of them, of which one writes what the other writes or reads, have changed places:
    each name's writers stay in order, and so do the readers between them.
    """
    meets = lambda s, o: (o["written"] == s["written"]) | F.array_contains(o["read"], s["written"]) | F.array_contains(s["read"], o["written"])

    def overtaken(at: Column) -> Column:
        """Whether one that comes after a place, and came before what is there, has to do with it."""
        own, behind = F.get(order, at), F.slice(order, at + 2, n)
        return F.when(F.array_min(behind) < own, F.exists(behind, lambda o: (o < own) & meets(F.get(said, own), F.get(said, o)))).otherwise(False)

    places = F.sequence(F.lit(0), n - 1)
    once = (F.size(F.array_distinct(F.transform(F.slice(said, F.lit(1), n), lambda s: s["content"]))) == n) & (F.array_min(order) >= 0) & (F.size(F.array_distinct(order)) == n)
    return once & (order != places) & ~F.exists(places, overtaken)


def reordered(blocks: DataFrame) -> DataFrame:
    """rel and proven: whether new holds old's assignments, each once, in another order that no name's readers and writers notice.

    blocks: rel, old and new (lines). A block of more lines than REORDER_LINES is never proven, so that each is judged where
    it stands: nothing is shuffled or stored. Lines that both sides have are parsed once.
    """

    def proven(b: Column) -> Column:
        unlike = lambda side: F.size(F.array_distinct(b[side]))
        n = F.size(b["old"])
        may = n.between(REORDER_LINES[0], REORDER_LINES[-1]) & (n == F.size(b["new"])) & (b["old"] != b["new"]) & (unlike("old") == n) & (unlike("new") == n)

        def judged(lines: Column) -> Column:
            """lines: those of old, and then what else new has."""
            place = lambda rows, x: F.array_position(rows, x).cast("int") - 1
            of_old = lambda said, k: F.when(k < n, k).otherwise(place(F.slice(said, F.lit(1), n), F.get(said, k)))
            order = lambda said: F.transform(b["new"], lambda x: text.let(place(lines, x), lambda k: of_old(said, k)))
            found = lambda said: text.let(order(said), lambda places: commutes(said, places, n))
            return text.let(F.transform(lines, shape), lambda shapes: F.forall(shapes, fits) & text.let(F.transform(shapes, statement), found))

        return F.when(may, text.let(F.array_distinct(F.concat(b["old"], b["new"])), judged))

    return blocks.select("rel", F.coalesce(text.let(F.struct("old", "new"), proven), F.lit(False)).alias("proven"))


def slid(lines: Column, lo: Column, hi: Column) -> Column:
    """How far a block of lines may slide down: as long as the line that it leaves is the line that it takes in."""

    def first_unlike(n: Column) -> Column:
        equal = F.zip_with(F.slice(lines, lo + 1, n), F.slice(lines, hi + 1, n), lambda x, y: x.eqNullSafe(y))
        return F.array_position(equal, F.lit(False))

    rest = F.size(lines) - hi
    near = first_unlike(F.least(rest, F.lit(64)))
    return F.when(rest <= 0, 0).when(near > 0, near - 1).when(rest <= 64, rest).otherwise(text.let(first_unlike(rest), lambda k: F.when(k > 0, k - 1).otherwise(rest))).cast("int")


def moved_blocks(files: DataFrame) -> DataFrame:
    """rel, i1, i2, j1, j2, moved_to and moved_from (lines from 1) of deleted and inserted blocks that have the same lines, each the only one of its side.

    files: rel, rules, old_lines, new_lines, ranges.
    """
    rows = files.select("rel", "rules", "old_lines", "new_lines", F.explode("ranges").alias("r")).select("rel", "rules", "old_lines", "new_lines", "r.*")
    sides = []
    for lines, lo, hi, other in (("old_lines", "i1", "i2", ("j1", "j2")), ("new_lines", "j1", "j2", ("i1", "i2"))):
        own = rows.where((F.col(lo) < F.col(hi)) & (F.col(other[0]) == F.col(other[1]))).withColumn("down", slid(F.col(lines), F.col(lo), F.col(hi)))
        block = solid(cut(F.col(lines), F.col(lo) + F.col("down"), F.col(hi) + F.col("down")))
        said = F.when(F.col("rules") == "c", F.transform(block, names.canonical_generated)).otherwise(block)
        keyed = own.select("rel", "i1", "i2", "j1", "j2", (F.col(lo) + F.col("down") + 1).alias("line"), said.alias("block")).where(F.size("block") >= MOVED_LINES)
        keyed = keyed.select("rel", F.struct("i1", "i2", "j1", "j2").alias("r"), "line", F.sha2(F.to_json("block"), 256).alias("key"))
        sides.append(keyed.groupBy("rel", "key").agg(F.count("*").alias("n"), F.first("r").alias("r"), F.first("line").alias("line")).where("n = 1").drop("n"))
    gone, come = (s.select("rel", "key", F.col("r").alias(f"{n}_r"), F.col("line").alias(f"{n}_line")) for s, n in zip(sides, ("old", "new"), strict=True))
    met = gone.join(come, ["rel", "key"])
    none = F.lit(None).cast("int")
    both = F.array(F.struct(F.col("old_r").alias("r"), F.col("new_line").alias("moved_to"), none.alias("moved_from")), F.struct(F.col("new_r").alias("r"), none.alias("moved_to"), F.col("old_line").alias("moved_from")))
    return met.select("rel", F.explode(both).alias("x")).select("rel", "x.r.*", "x.moved_to", "x.moved_from")


def aligned(pairs: DataFrame, real: bool = False) -> DataFrame:
    """rel, rules, old_lines, new_lines and ranges of pairs (rel, rules, old_text, new_text), by their shadows; real: without ranges of blank lines."""
    shadows = pairs.select("rel", "rules", *[text.shadow(F.col(f"{s}_text"), F.col("rules")).alias(f"{s}_text") for s in ("old", "new")])
    found = hunks(shadows).select("rel", "rules", text.lines(F.col("old_text")).alias("old_lines"), text.lines(F.col("new_text")).alias("new_lines"), "ranges")
    holds = lambda r: (F.size(solid(cut(F.col("old_lines"), r["i1"], r["i2"]))) > 0) | (F.size(solid(cut(F.col("new_lines"), r["j1"], r["j2"]))) > 0)
    return found.withColumn("ranges", F.filter("ranges", holds)) if real else found
