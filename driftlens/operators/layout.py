"""Hunks laid out: row offsets, context groups, focus windows, aligned rows, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftlens.functions.names import mode_of
from driftlens.functions.text import let

#: Lines around a change, and lines of a one-sided file, that a report shows: what it is, not a limit on work.
CONTEXT, CONTENT_LINES = 3, 400
LOUD = ("real", "moved")


def in_file() -> WindowSpec:
    return Window.partitionBy("rel").orderBy("i1", "j1")


def row_starts(hunks: DataFrame) -> DataFrame:
    """hunks (rel, kind, i1, i2, j1, j2) with the aligned row at which each begins."""
    before = F.coalesce(F.lag("i2").over(in_file()), F.lit(0))
    rows = F.greatest(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"))
    step = F.col("i1") - before
    return hunks.withColumn("row_start", (F.sum(step + rows).over(in_file().rowsBetween(Window.unboundedPreceding, 0)) - rows).cast("bigint"))


def context_groups(hunks: DataFrame, context: int = CONTEXT) -> DataFrame:
    """hunks with the number of the run whose context windows touch."""
    new = F.when(F.col("i1") - F.lag("i2").over(in_file()) <= 2 * context, 0).otherwise(1)
    return hunks.withColumn("_new", new).withColumn("grp", F.sum("_new").over(in_file()).cast("bigint")).drop("_new")


def focus_windows(hunks: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Windows (rel, win, lo, hi) around real and moved hunks, those that touch made one."""
    loud = hunks.where(mode_of(F.col("kind")).isin(*LOUD)).select("rel", (F.col("i1") - context).alias("lo"), (F.greatest("i2", F.col("i1") + 1) + context).alias("hi"))
    w = Window.partitionBy("rel").orderBy("lo", "hi")
    ends = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = loud.withColumn("new", F.when(F.col("lo") <= ends, 0).otherwise(1)).withColumn("win", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("rel", "win").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def focus(hunks: DataFrame) -> DataFrame:
    """hunks with the window they fall in (null: none) and lean: no context is shown around them."""
    wins = focus_windows(hunks)
    h, v = hunks.alias("h"), wins.alias("v")
    inside = (F.col("h.rel") == F.col("v.rel")) & (F.col("i1") < F.col("hi")) & (F.greatest("i2", F.col("i1") + 1) > F.col("lo"))
    met = h.join(v, inside, "left").groupBy(*[F.col(f"h.{c}").alias(c) for c in hunks.columns]).agg(F.min("win").cast("bigint").alias("win"))
    loud = F.max(mode_of(F.col("kind")).isin(*LOUD)).over(Window.partitionBy("rel"))
    return met.withColumn("lean", loud & F.col("win").isNull())


def aligned_rows(pairs: DataFrame) -> DataFrame:
    """Rows (rel, row_no, old_no, old_txt, new_no, new_txt, mode, kind, hunk_idx) of pairs (rel, old_text, new_text, hunks).

    A hunk takes as many rows as its longer side; between hunks the sides go together. A file's rows are made in one array and
    then dealt out, so that no row carries its file's lines along.
    """

    def rows(a: Column, b: Column) -> Column:
        end = F.struct(F.size(a).alias("i1"), F.size(a).alias("i2"), F.size(b).alias("j1"), F.size(b).alias("j2"), F.lit("equal").alias("kind"))
        start = F.struct(*[F.lit(0).alias(c) for c in ("i1", "i2", "j1", "j2")], F.lit("equal").alias("kind"))
        bare = F.transform("hunks", lambda h: F.struct(*[h[c].alias(c) for c in ("i1", "i2", "j1", "j2", "kind")]))
        # Each hunk, and the end, with the one before it: the equal lines between come first, then the hunk's own rows.
        steps = F.arrays_zip(F.concat(F.array(start), bare).alias("p"), F.concat(bare, F.array(end)).alias("h"))

        def of(z: Column, no: Column) -> Column:
            p, h = z["p"], z["h"]
            equal, own = h["i1"] - p["i2"], F.greatest(h["i2"] - h["i1"], h["j2"] - h["j1"])

            def row(k: Column) -> Column:
                same, past = k < equal, k - equal
                at = lambda first, last: F.when(same, p[last] + k).when(h[first] + past < h[last], h[first] + past)
                o, n = at("i1", "i2"), at("j1", "j2")
                return F.struct((o + 1).alias("old_no"), F.get(a, o).alias("old_txt"), (n + 1).alias("new_no"), F.get(b, n).alias("new_txt"), F.when(same, "equal").otherwise(h["kind"]).alias("kind"), F.when(~same, no).alias("hunk_idx"))

            return F.transform(F.when(equal + own > 0, F.sequence(F.lit(0), equal + own - 1)).otherwise(F.array().cast("array<int>")), row)

        return F.flatten(F.transform(steps, of))

    made = let(F.split("old_text", "\n", -1), lambda a: let(F.split("new_text", "\n", -1), lambda b: rows(a, b)))
    out = pairs.select("rel", F.posexplode(made).alias("row_no", "r")).select("rel", "row_no", "r.*")
    return out.select("rel", "old_no", "old_txt", "new_no", "new_txt", F.when(F.col("kind") == "equal", "ctx").otherwise(mode_of(F.col("kind"))).alias("mode"), "kind", "hunk_idx", "row_no")


def mute(rows: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """Comment and minor rows of the modes shown as muted."""
    return rows.withColumn("mode", F.when(F.col("mode").isin("comment", "minor") & F.col("mode").isin(*modes), "muted").otherwise(F.col("mode")))


def matches(rows: DataFrame, said: str) -> DataFrame:
    """Rows that hold the text on either side, whatever its case."""
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lower(F.lit(said))), F.lit(False))
    return rows.where(holds("old_txt") | holds("new_txt"))


def stops(hunks: DataFrame) -> DataFrame:
    """Real and moved hunks with the next and previous one of their file, going round at the ends."""
    whole = in_file().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    loud = hunks.where(F.col("kind").isin(*LOUD))
    return loud.withColumn("next_i1", F.coalesce(F.lead("i1").over(in_file()), F.first("i1").over(whole))).withColumn("prev_i1", F.coalesce(F.lag("i1").over(in_file()), F.last("i1").over(whole)))


def one_sided(files: DataFrame, lines: int = CONTENT_LINES) -> DataFrame:
    """The lines of added or deleted files that are shown."""
    return files.select("rel", F.posexplode(F.split("text", "\n", -1)).alias("at", "txt")).where(F.col("at") < lines).select("rel", (F.col("at") + 1).alias("line_no"), "txt")
