"""Review sign-off by content: units of a compared file, their notes, tallies and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.names import digest
from driftlens.operators.rollup import directories


def _side(a: Column, b: Column) -> Column:
    return F.when(b <= a, F.lit("-")).when(b - a == 1, (a + 1).cast("string")).otherwise(F.concat((a + 1).cast("string"), F.lit("-"), b.cast("string")))


def hunk_units(pairs: DataFrame) -> DataFrame:
    """(rel, unit_key, hunk_idx, label) of the real and moved hunks of changed pairs (rel, old_text, new_text, hunks).

    A key is a digest of kind and content and, among equal ones, a number in file order.
    """
    rows = pairs.select("rel", F.split("old_text", "\n", -1).alias("a"), F.split("new_text", "\n", -1).alias("b"), F.posexplode("hunks").alias("hunk_idx", "h")).where(F.col("h.kind").isin("real", "moved"))
    cut = lambda side, lo, hi: F.array_join(F.slice(side, F.col(f"h.{lo}") + 1, F.col(f"h.{hi}") - F.col(f"h.{lo}")), "\n")
    rows = rows.withColumn("d", digest(F.lit("hunk"), F.col("h.kind"), cut("a", "i1", "i2"), cut("b", "j1", "j2")))
    label = F.concat(F.lit("BASELINE "), _side(F.col("h.i1"), F.col("h.i2")), F.lit(" · CURRENT "), _side(F.col("h.j1"), F.col("h.j2")))
    return with_ordinals(rows.withColumn("label", label)).select("rel", "unit_key", "hunk_idx", "label")


def with_ordinals(rows: DataFrame) -> DataFrame:
    """rows (rel, d, hunk_idx) with unit_key."""
    n = F.row_number().over(Window.partitionBy("rel", "d").orderBy("hunk_idx")) - 1
    return rows.withColumn("unit_key", F.concat("d", F.lit("#"), n.cast("string")))


def file_units(files: DataFrame) -> DataFrame:
    """Units of whole files that were added or deleted, or that changed as binaries.

    files: rel, status, text, and where there are binaries also binary and content, the bytes of the side that is left (null
    if it could not be read, which gives no unit).
    """
    named = "content" in files.columns
    blob = F.when(F.col("binary") & F.col("content").isNotNull(), F.sha1("content")) if named else F.lit(None).cast("string")
    whole = F.col("status").isin("added", "deleted") | ((F.col("status") == "real-change") & F.col("binary") if named else F.lit(False))
    body = F.coalesce(blob, F.when(~F.col("binary"), F.col("text")) if named else F.col("text"))
    rows = files.where(whole).withColumn("_body", body).where("_body is not null")
    return rows.select("rel", F.concat(digest(F.lit("file"), F.col("status"), F.col("_body")), F.lit("#0")).alias("unit_key"), F.lit(None).cast("int").alias("hunk_idx"), F.lit("whole file").alias("label"))


def folder_tally(units: DataFrame, entries: DataFrame) -> DataFrame:
    """Per folder and file (path): units below it, those reviewed, and whether all are; '' is the top."""
    per = tally(units, entries)
    up = directories(per).select(F.col("dir").alias("path"), "units", "reviewed").unionByName(per.select(F.col("rel").alias("path"), "units", "reviewed"))
    return up.groupBy("path").agg(F.sum("units").alias("units"), F.sum("reviewed").alias("reviewed")).withColumn("done", F.col("units") == F.col("reviewed"))


def units_at(stops: DataFrame, units: DataFrame) -> DataFrame:
    """Stops (rel, hunk_idx, ...) with unit_key and label of the unit there: null at noise, the whole file's where it has one."""
    whole = units.where("hunk_idx is null").select("rel", F.col("unit_key").alias("_key"), F.col("label").alias("_label"))
    met = stops.join(units.where("hunk_idx is not null").select("rel", "hunk_idx", "unit_key", "label"), ["rel", "hunk_idx"], "left").join(whole, "rel", "left")
    return met.withColumns({"unit_key": F.coalesce("_key", "unit_key"), "label": F.coalesce("_label", "label")}).drop("_key", "_label")


def tally(units: DataFrame, entries: DataFrame) -> DataFrame:
    """Per file: units, those reviewed, and whether all are; entries are (rel, unit_key, note, reviewed)."""
    rows = units.join(entries, ["rel", "unit_key"], "left")
    per = rows.groupBy("rel").agg(F.count("*").alias("units"), F.count_if(F.coalesce("reviewed", F.lit(False))).alias("reviewed"))
    return per.withColumn("done", F.col("units") == F.col("reviewed"))


def upsert(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """entries with changes in their place; an entry without note and review goes."""
    kept = entries.join(changes.select("rel", "unit_key"), ["rel", "unit_key"], "left_anti")
    return kept.unionByName(changes).where((F.coalesce("note", F.lit("")) != "") | F.coalesce("reviewed", F.lit(False)))


def mark_files(entries: DataFrame, units: DataFrame, reviewed: bool) -> DataFrame:
    """All units of the given files marked; notes stay."""
    notes = entries.select("rel", "unit_key", "note")
    return upsert(entries, units.select("rel", "unit_key").join(notes, ["rel", "unit_key"], "left").withColumn("reviewed", F.lit(reviewed)))


def marks_changed(entries: DataFrame, units: DataFrame, reviewed: bool) -> DataFrame:
    """How many units mark_files() would change, as one row."""
    rows = units.select("rel", "unit_key").join(entries.select("rel", "unit_key", "reviewed"), ["rel", "unit_key"], "left")
    return rows.agg(F.count_if(F.coalesce("reviewed", F.lit(False)) != F.lit(reviewed)).alias("changed"))
