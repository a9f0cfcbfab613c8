"""What a report is made of, as frames: shown rows of hunk groups, chips, overviews, nodes of the file tree, order and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.names import iface_kind, mode_of, short_name
from driftlens.operators.layout import CONTEXT, LOUD, context_groups, focus, in_file
from driftlens.operators.rollup import PRIORITY, STATUSES, directories

# Sections by status, chips by fact type, and statuses that a reader has to look at.
DETAIL_ORDER = {"error": -1, "real-change": 0, "ignorable-only": 1, "added": 2, "deleted": 3}
CHIPS = {"swc": "SWC", "port": "Port", "runnable": "Runnable", "event": "Event", "iface": "Interface", "rte": "RTE", "a2l": None}
TO_READ = ("error", "real-change", "added", "deleted")


def hunk_groups(hunks: DataFrame) -> DataFrame:
    """hunks (rel, hunk_idx, kind, i1, i2, j1, j2) with grp, lean and mixed.

    Where a file has real or moved hunks, a group is a window around such hunks; other hunks are lean groups of their own,
    shown without context. Where it has none, a group is a run of hunks whose context touches. mixed: it holds a loud hunk.
    """
    runs = context_groups(hunks).select("rel", "hunk_idx", "grp")
    met = focus(hunks).join(runs, ["rel", "hunk_idx"])
    loud = F.max(mode_of(F.col("kind")).isin(*LOUD)).over(Window.partitionBy("rel"))
    name = F.when(F.col("win").isNotNull(), F.concat(F.lit("w"), F.col("win").cast("string"))).when(F.col("lean"), F.concat(F.lit("l"), F.col("hunk_idx").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("grp").cast("string")))
    named = met.withColumn("has_loud", loud).withColumn("grp", name)
    mixed = F.max(mode_of(F.col("kind")).isin(*LOUD)).over(Window.partitionBy("rel", "grp"))
    return named.select(*hunks.columns, "grp", "lean", mixed.alias("mixed"))


def shown_rows(rows: DataFrame, groups: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Rows of a report: (rel, grp, row_no, sub, what, old_no, old_txt, new_no, new_txt, mode, said).

    Of aligned rows (layout.aligned_rows) those of hunks are shown, equal lines between hunks of a group, and context lines
    before and after a group that is not lean, up to the next hunk whichever group it is in. After a hunk of noise that has
    a group to itself comes a placeholder, after a moved hunk a note.
    """
    marks = groups.select("rel", "hunk_idx", "grp", "lean", "mixed", "moved_to", "moved_from")
    met = rows.join(marks, ["rel", "hunk_idx"], "left")
    here = F.when(F.col("hunk_idx").isNotNull(), F.struct("row_no", "grp", "lean"))
    w = Window.partitionBy("rel").orderBy("row_no")
    back = Window.partitionBy("rel").orderBy(F.desc("row_no"))  # frames that grow row by row, unlike those that shrink
    so_far = lambda x: F.last(here, ignorenulls=True).over(x.rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("p", so_far(w)).withColumn("n", so_far(back))
    inside = (F.col("p.grp") == F.col("n.grp")) & ~F.col("p.lean")
    tail = (F.col("row_no") - F.col("p.row_no") <= context) & ~F.col("p.lean")
    lead = (F.col("n.row_no") - F.col("row_no") <= context) & ~F.col("n.lean")
    no = F.lit(False)
    belongs = F.when(F.col("hunk_idx").isNotNull(), F.col("grp")).when(F.coalesce(inside | tail, tail, no), F.col("p.grp")).when(F.coalesce(lead, no), F.col("n.grp"))
    code = met.withColumn("grp", belongs).where("grp is not null")
    last = F.max("row_no").over(Window.partitionBy("rel", "hunk_idx"))
    size = F.count("*").over(Window.partitionBy("rel", "hunk_idx"))
    ends = met.where("hunk_idx is not null").withColumn("size", size).withColumn("last", last).where(F.col("row_no") == F.col("last"))
    quiet = F.col("mode").isin("comment", "minor") & ~F.col("mixed") & ~F.col("lean")
    hidden = F.concat(F.lit("⋯ "), F.col("size").cast("string"), F.lit(" "), F.when(F.col("mode") == "comment", "comment").otherwise(F.concat(F.lit("minor ("), "kind", F.lit(")"))), F.when(F.col("size") == 1, " line hidden").otherwise(" lines hidden"))
    moved = F.when(F.col("moved_to").isNotNull(), F.concat(F.lit("⇄ block moved to CURRENT line "), F.col("moved_to").cast("string"))).otherwise(F.concat(F.lit("⇄ block moved from BASELINE line "), F.coalesce(F.col("moved_from").cast("string"), F.lit("?"))))
    said = ends.withColumn("said", F.when(quiet, hidden).when(F.col("mode") == "moved", moved)).where("said is not null")
    text = ["old_no", "old_txt", "new_no", "new_txt"]
    code = code.select("rel", "grp", "row_no", F.lit(0).alias("sub"), F.lit("code").alias("what"), *text, "mode", F.lit(None).cast("string").alias("said"))
    notes = said.select("rel", "grp", "row_no", F.lit(1).alias("sub"), F.when(F.col("mode") == "moved", "move-note").otherwise("placeholder").alias("what"), *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in text], "mode", "said")
    return code.unionByName(notes)


def group_notes(groups: DataFrame, units: DataFrame, entries: DataFrame) -> DataFrame:
    """(rel, grp, units, reviewed, done): a group is done if it has a real or moved hunk and all of these are signed off."""
    rows = groups.where(F.col("kind").isin("real", "moved")).join(units.select("rel", "hunk_idx", "unit_key"), ["rel", "hunk_idx"], "left").join(entries.select("rel", "unit_key", "reviewed"), ["rel", "unit_key"], "left")
    per = rows.groupBy("rel", "grp").agg(F.count("*").alias("units"), F.count_if(F.coalesce("reviewed", F.lit(False))).alias("reviewed"))
    return per.withColumn("done", F.col("units") == F.col("reviewed"))


def row_labels(rows: DataFrame, old_labels: DataFrame, new_labels: DataFrame) -> DataFrame:
    """rows with label: the scope of the current side's line, or else of the baseline's. Labels: (rel, labels)."""
    a, b = old_labels.select("rel", F.col("labels").alias("_old")), new_labels.select("rel", F.col("labels").alias("_new"))
    at = lambda c, no: F.get(c, F.col(no) - 1)
    return rows.join(a, "rel", "left").join(b, "rel", "left").withColumn("label", F.coalesce(at("_new", "new_no"), at("_old", "old_no"))).drop("_old", "_new")


def chips(facts: DataFrame, key: str = "rel") -> DataFrame:
    """(key, chips): how many facts of each type came, went and changed, such as +2/−1 Port   ·   +1 Characteristic."""
    label = F.when(F.col("fact_type") == "a2l", F.initcap(F.coalesce("descr", "old_descr")))
    place = F.lit(len(CHIPS))
    for k, (kind, name) in enumerate(CHIPS.items()):
        place = F.when(F.col("fact_type") == kind, k).otherwise(place)
        label = F.when(F.col("fact_type") == kind, name).otherwise(label) if name else label
    counts = facts.groupBy(key, place.alias("place"), label.alias("label")).agg(*[F.count_if(F.col("change") == c).alias(n) for c, n in (("+", "a"), ("-", "r"), ("~", "c"))])
    bits = F.array_join(F.array_compact(F.array(*[F.when(F.col(n) > 0, F.concat(F.lit(s), F.col(n).cast("string"))) for n, s in (("a", "+"), ("r", "−"), ("c", "~"))])), "/")
    rows = counts.select(key, F.struct("place", "label", F.concat(bits, F.lit(" "), "label").alias("said")).alias("x"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["said"]), "   ·   ").alias("chips"))


def notes(facts: DataFrame) -> DataFrame:
    """(rel, topic, note): each file's fact changes in a line by topic."""
    topic = F.when(F.col("fact_type") == "iface", "Interfaces").when(F.col("fact_type") == "rte", "RTE").when(F.col("fact_type") == "a2l", "A2L").otherwise("Behavior")
    noun = F.col("fact_type")
    for kind, name in CHIPS.items():
        noun = F.when(F.col("fact_type") == kind, name or "").otherwise(noun)
    sign = F.when(F.col("change") == "-", "−").otherwise(F.col("change"))
    descr = F.coalesce("descr", "old_descr")
    inside = F.concat(noun, F.lit(" "), F.when(F.col("owner").isNotNull(), F.concat(short_name(F.col("owner")), F.lit("."), "name")).otherwise(F.col("name")))
    what = F.when(F.col("fact_type") == "iface", F.concat("name", F.lit(" ("), iface_kind(descr), F.lit(")"))).when(F.col("fact_type") == "a2l", F.concat("name", F.lit(" ("), descr, F.lit(")"))).when(F.col("fact_type") == "rte", F.col("name")).otherwise(inside)
    changed = F.when(F.col("change") == "~", F.concat(F.lit(" ("), "old_descr", F.lit(" → "), "descr", F.lit(")"))).otherwise("")
    order = F.struct(F.when(F.col("change") == "+", 0).when(F.col("change") == "-", 1).otherwise(2).alias("o"), F.concat(sign, what, changed).alias("said"))
    return facts.groupBy("rel", topic.alias("topic")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["said"]), "; ").alias("note"))


def overview(results: DataFrame, groups: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per model: its files by status, and chips."""
    rows = results.join(groups, "rel")
    counts = rows.groupBy("model").agg(F.count("*").alias("files"), *[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES])
    return counts.join(chips(facts.join(groups, "rel"), "model"), "model", "left").withColumn("chips", F.coalesce("chips", F.lit("")))


def nodes(results: DataFrame, said: str = "", hide_identical: bool = False) -> DataFrame:
    """(path, parent, depth, is_dir, status) of the files that are shown and the folders above them; '' is the top.

    A file is shown if its path holds the text, whatever the case; identical ones can be left out. A folder has the status of
    the highest priority below it. In order of parent, is_dir (true first) and path it is a tree.
    """
    files = results.where(F.contains(F.lower("rel"), F.lit(said.strip().lower()))) if said.strip() else results
    files = files.where("status <> 'identical'") if hide_identical else files
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    depth = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "/")))
    up = directories(files).where("dir <> ''").groupBy("dir").agg(F.max_by("status", F.struct(table[F.col("status")], F.col("status"))).alias("status"))
    dirs = up.select(F.col("dir").alias("path"), _parent("dir").alias("parent"), depth("dir").alias("depth"), F.lit(True).alias("is_dir"), "status")
    return dirs.unionByName(files.select(F.col("rel").alias("path"), _parent("rel").alias("parent"), depth("rel").alias("depth"), F.lit(False).alias("is_dir"), "status"))


def _parent(path: str) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def detail_order(results: DataFrame) -> DataFrame:
    """(rel, status, place) of files with a section of their own: sections go by place, then by path."""
    table = F.create_map(*[F.lit(x) for kv in DETAIL_ORDER.items() for x in kv])
    return results.where(F.col("status").isin(*DETAIL_ORDER)).select("rel", "status", table[F.col("status")].alias("place"))


def file_stops(results: DataFrame) -> DataFrame:
    """(folder, rel, next_rel, prev_rel) of files to be read, going round at the ends of a folder."""
    rows = results.where(F.col("status").isin(*TO_READ)).select(_parent("rel").alias("folder"), "rel")
    w = Window.partitionBy("folder").orderBy("rel")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("folder", "rel", F.coalesce(F.lead("rel").over(w), F.first("rel").over(whole)).alias("next_rel"), F.coalesce(F.lag("rel").over(w), F.last("rel").over(whole)).alias("prev_rel"))


def after(results: DataFrame, rel: str, back: bool = False) -> str | None:
    """The next (or previous) file to be read in the whole comparison, from its start (or end) again after the last."""
    rows = results.where(F.col("status").isin(*TO_READ)).select("rel")
    past = F.col("rel") < F.lit(rel) if back else F.col("rel") > F.lit(rel)
    pick = F.max if back else F.min
    found = rows.agg(pick(F.when(past, F.col("rel"))).alias("near"), pick("rel").alias("round")).first()
    return found["near"] or found["round"]


def noise_stops(hunks: DataFrame, shown: tuple[str, ...] = ()) -> DataFrame:
    """hunks at which navigation stops: real and moved ones, and those of the modes of noise that are shown."""
    return hunks.where(F.col("kind").isin(*LOUD) | mode_of(F.col("kind")).isin(*shown)).withColumn("stop", F.row_number().over(in_file()) - 1)
