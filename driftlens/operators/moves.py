"""Moved files: exact pairs by content, then pairs by shared lines that are each other's clear best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.sources.stored import checkpointed, looked_up

LEAST, MARGIN = 0.60, 0.10


def ext() -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract("rel", r"([^/]*)$", 1), r"(\.[^.]*)$", 1))


def exact(added: DataFrame, deleted: DataFrame) -> DataFrame:
    """(added_rel, deleted_rel, similarity) of files (rel, text) whose content one file on each side has."""

    def once(files: DataFrame, name: str) -> DataFrame:
        rows = files.select("rel", ext().alias("ext"), F.sha1(F.col("text").cast("binary")).alias("digest"))
        return rows.groupBy("ext", "digest").agg(F.count("*").alias("n"), F.min("rel").alias(name)).where("n = 1").drop("n")

    return once(added, "added_rel").join(once(deleted, "deleted_rel"), ["ext", "digest"]).select("added_rel", "deleted_rel", F.lit(1.0).alias("similarity"))


def similarities(added: DataFrame, deleted: DataFrame, least: float = LEAST) -> DataFrame:
    """(added_rel, deleted_rel, similarity) of files that share lines: twice the shared lines over all of both sides.

    Lines are counted multisets of their shadows. A file's lines are put in order of how many files have them, the rarest
    first. Files as alike as least share a line among the first of either that the others' number leaves over (exact prefix
    filter), so a line that every file has brings nobody together unless a file has little else. Candidates are then counted.
    Two files without any lines are alike too, but can't be told apart, and are left to the exact pass.
    """

    def lined(files: DataFrame, side: str) -> DataFrame:
        rules = text.ruleset(F.col("rel"))
        rows = files.select(F.lit(side).alias("side"), "rel", ext().alias("ext"), F.filter(text.lines(text.move_shadow(text.unix_lines(F.col("text")), rules)), lambda x: x.rlike(r"\S")).alias("lines"))
        rows = rows.withColumn("n", F.size("lines")).select("side", "rel", "ext", "n", F.explode("lines").alias("line"))
        return rows.groupBy("side", "rel", "ext", "n", "line").agg(F.count("*").alias("c"))

    rows = checkpointed(lined(added, "a").unionByName(lined(deleted, "d")).withColumn("key", F.sha2(F.concat_ws("\n", "ext", "line"), 256)).drop("line"))
    met = looked_up(rows, checkpointed(rows.groupBy("key").agg(F.count("*").alias("files"))), "key")
    # Lines that a file must share with any other: its part of the sum, with the smallest other that can be alike.
    needed = F.ceil(F.col("n") * F.lit(least / (2 - least)) - 1e-9)
    before = F.sum("c").over(Window.partitionBy("side", "rel").orderBy("files", "key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    first = checkpointed(met.withColumn("before", before).where(F.col("before") <= F.col("n") - needed).select("side", "rel", "n", "key"))
    a, d = (first.where(F.col("side") == s).select(F.col("rel").alias(s), F.col("n").alias(f"n_{s}"), "key") for s in "ad")
    sizes = least * (F.col("n_a") + F.col("n_d")) <= 2 * F.least("n_a", "n_d") + 1e-9
    pairs = checkpointed(a.join(d, "key").where(sizes).select("a", "d", "n_a", "n_d").distinct())
    of_a, of_d = (rows.where(F.col("side") == s).select(F.col("rel").alias(s), "key", F.col("c").alias(f"c_{s}")) for s in "ad")
    shared = pairs.join(of_a, "a").join(of_d, ["d", "key"]).groupBy("a", "d", "n_a", "n_d").agg(F.sum(F.least("c_a", "c_d")).alias("shared"))
    scored = shared.select(F.col("a").alias("added_rel"), F.col("d").alias("deleted_rel"), (F.lit(2.0) * F.col("shared") / (F.col("n_a") + F.col("n_d"))).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def clear_best(scored: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Pairs that are the best of both files, by the margin over the next best of either."""
    both = scored
    for side in ("added_rel", "deleted_rel"):
        w = Window.partitionBy(side).orderBy(F.desc("similarity"))
        both = both.withColumn(f"best_{side}", F.first("similarity").over(w)).withColumn(f"next_{side}", F.coalesce(F.nth_value("similarity", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    s = F.col("similarity")
    ok = [(s == F.col(f"best_{k}")) & (s - F.col(f"next_{k}") >= margin) for k in ("added_rel", "deleted_rel")]
    return both.where(ok[0] & ok[1]).select("added_rel", "deleted_rel", "similarity")


def find(added: DataFrame, deleted: DataFrame, guard: int | None = None) -> DataFrame:
    """Exact pairs, and scored ones of the rest. With a guard, none is scored if there are more combinations than that.

    As files meet by rare lines and not each with each, no guard is needed; one makes results depend on how many files moved,
    and says so: the pairs' skipped is true then.
    """
    first = checkpointed(exact(added, deleted))
    rest_a = added.join(first.select(F.col("added_rel").alias("rel")), "rel", "left_anti")
    rest_d = deleted.join(first.select(F.col("deleted_rel").alias("rel")), "rel", "left_anti")
    rest_a, rest_d = (t.where("not binary") if "binary" in t.columns else t for t in (rest_a, rest_d))
    if guard is None:
        return first.unionByName(clear_best(similarities(rest_a, rest_d)))
    skipped = rest_a.count() * rest_d.count() > guard
    rest = first.limit(0) if skipped else clear_best(similarities(rest_a, rest_d))
    return first.unionByName(rest).withColumn("skipped", F.lit(skipped))
