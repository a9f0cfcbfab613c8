"""The comparison of two trees as one plan: pairing, the ladder of equalities, classification, facts, moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import classify, facts, moves
from driftlens.sources.stored import checkpointed

RESULT = ["rel", "status", "binary", "notes", "renames", "hunks"]


def no_hunks() -> Column:
    return F.array().cast(f"array<{classify.HUNK}>")


def no_renames() -> Column:
    return F.create_map().cast("map<string,string>")


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join by path of two trees (rel, text)."""
    a = old.select("rel", F.col("text").alias("old_text"), F.lit(True).alias("in_old"))
    b = new.select("rel", F.col("text").alias("new_text"), F.lit(True).alias("in_new"))
    return a.join(b, "rel", "full_outer")


def ladder(pairs: DataFrame) -> DataFrame:
    """pairs with the status that equality alone decides, null where lines must be compared, and a first note."""
    unix = {c: text.unix_lines(F.col(c)) for c in ("old_text", "new_text")}
    return _decided(pairs, F.col("old_text") == F.col("new_text"), unix["old_text"] == unix["new_text"])


def _decided(pairs: DataFrame, same: Column, alike: Column) -> DataFrame:
    status = F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "added").when(same, "identical").when(alike, "ignorable-only")
    return pairs.withColumn("status", status).withColumn("note", F.when(F.col("status") == "ignorable-only", "line-endings"))


def statuses(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel, status, note) as by ladder(), kept. Paths and SHA-256 digests meet, texts stay where they are."""

    def slim(tree: DataFrame, side: str) -> DataFrame:
        whole, unix = F.sha2("text", 256), F.sha2(text.unix_lines(F.col("text")), 256)
        has_return = F.contains("text", F.lit("\r"))
        return tree.select("rel", whole.alias(f"{side}_whole"), F.when(has_return, unix).otherwise(whole).alias(f"{side}_unix"), F.lit(True).alias(f"in_{side}"))

    pairs = slim(old, "old").join(slim(new, "new"), "rel", "full_outer")
    return checkpointed(_decided(pairs, F.col("old_whole") == F.col("new_whole"), F.col("old_unix") == F.col("new_unix")).select("rel", "status", "note"))


def texts_of(rels: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel, rules, old_text, new_text) of paths on both sides, with line feeds at line ends: no other text is moved."""
    sides = [t.join(rels.select("rel"), "rel", "left_semi").select("rel", text.unix_lines(F.col("text")).alias(c)) for t, c in ((old, "old_text"), (new, "new_text"))]
    return sides[0].join(sides[1], "rel").select("rel", text.ruleset(F.col("rel")).alias("rules"), "old_text", "new_text")


def only_in(tree: DataFrame, found: DataFrame, status: str) -> DataFrame:
    """Files of tree that have a status in found."""
    return tree.join(found.where(F.col("status") == status).select("rel"), "rel", "left_semi")


def scan_texts(old: DataFrame, new: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Results (RESULT) of two trees (rel, text). Texts of pairs that equality decides are neither moved nor reach Python."""
    old, new = (t.where(text.selected(F.col("rel"), include, exclude)) for t in (old, new))
    found = statuses(old, new)
    notes = F.when(F.col("note").isNull(), F.array().cast("array<string>")).otherwise(F.array("note"))
    plain = found.where("status is not null").select("rel", "status", F.lit(False).alias("binary"), notes.alias("notes"), no_renames().alias("renames"), no_hunks().alias("hunks"))
    judged = classify.classified(texts_of(found.where("status is null"), old, new)).select("rel", "status", F.lit(False).alias("binary"), "notes", "renames", "hunks")
    return plain.unionByName(judged)


def scan(old: DataFrame, new: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Results of two trees (rel, content, list_error) of bytes: binaries by bytes, errors as rows, texts as above, and moved files linked.

    A file seen on one side alone is an error where its folder could not be listed on the other. Listing errors are
    never filtered. Paths and digests of bytes meet; contents are read again only for what these leave undecided.
    """
    sides = []
    for tree, side in ((old, "BASELINE"), (new, "CURRENT")):
        files = tree.where("list_error is null").where(text.selected(F.col("rel"), include, exclude))
        failed = tree.where("list_error is not null").select("rel", F.concat(F.lit(f"folder listing failed on {side} side: "), "list_error").alias("note"))
        sides.append((files.select("rel", "content"), failed))
    (a, a_failed), (b, b_failed) = sides

    def slim(files: DataFrame, side: str) -> DataFrame:
        return files.select("rel", F.sha2("content", 256).alias(f"{side}_sha"), text.looks_binary(F.col("content")).alias(f"{side}_binary"), F.lit(True).alias(f"in_{side}"))

    both = checkpointed(slim(a, "old").join(slim(b, "new"), "rel", "full_outer"))

    def under(rows: DataFrame, failed: DataFrame) -> DataFrame:
        """Rows whose path or a folder above it is among the failed ones: looked up folder by folder."""
        up = F.transform(F.sequence(F.lit(0), F.size(F.split("rel", "/"))), lambda k: F.array_join(F.slice(F.split("rel", "/"), 1, k), "/"))
        at = failed.select(F.when(F.col("rel") == ".", "").otherwise(F.col("rel")).alias("dir")).distinct()
        return rows.select("rel", F.explode(up).alias("dir")).join(at, "dir").select("rel").distinct()

    lost = under(both.where("in_old is null"), a_failed).union(under(both.where("in_new is null"), b_failed)).distinct()
    empty = [no_renames().alias("renames"), no_hunks().alias("hunks")]
    errors = a_failed.unionByName(b_failed).groupBy("rel").agg(F.sort_array(F.collect_list("note")).alias("notes"))
    errors = errors.unionByName(lost.select("rel", F.array(F.lit("not compared: the folder's listing failed on the other side")).alias("notes")).join(errors.select("rel"), "rel", "left_anti"))
    errors = errors.select("rel", F.lit("error").alias("status"), F.lit(False).alias("binary"), "notes", *empty)
    rest = both.join(errors.select("rel"), "rel", "left_anti")
    blob = F.coalesce("old_binary", F.lit(False)) | F.coalesce("new_binary", F.lit(False))
    rest = checkpointed(rest.withColumn("binary", F.coalesce(F.col("old_sha") != F.col("new_sha"), F.lit(False)) & blob))
    blobs = rest.where("binary").select("rel", F.lit("real-change").alias("status"), "binary", F.array(F.lit("binary")).alias("notes"), *empty)
    same = rest.where("not binary and old_sha = new_sha").select("rel", F.lit("identical").alias("status"), "binary", F.array().cast("array<string>").alias("notes"), *empty)
    texts = rest.where("not binary and not (old_sha <=> new_sha)")
    decoded = scan_texts(*(t.join(texts.where(side).select("rel"), "rel", "left_semi").select("rel", text.decode(F.col("content")).alias("text")) for t, side in ((a, "in_old"), (b, "in_new"))))
    # Bytes that differ but decode alike differ in line ends or the mark alone.
    ends = F.col("status") == "identical"
    decoded = decoded.withColumn("notes", F.when(ends, F.array(F.lit("line-endings"))).otherwise(F.col("notes"))).withColumn("status", F.when(ends, "ignorable-only").otherwise(F.col("status")))
    results = errors.unionByName(blobs).unionByName(same).unionByName(decoded)
    return with_moves(results, *(t.select("rel", text.decode(F.col("content")).alias("text"), text.looks_binary(F.col("content")).alias("binary")) for t in (a, b)))


def with_moves(results: DataFrame, old: DataFrame, new: DataFrame, guard: int | None = None) -> DataFrame:
    """results with moved_from and moved_to (paths), move_status and move_similarity: added files and the deleted ones that they were.

    Both keep their status. The added file's hunks and renames are those against the file that it was; move_status is what
    the two would have come to under one path.
    """
    kept = checkpointed(results)
    found = checkpointed(linked_moves(kept, old, new, guard))
    none = F.lit(None)
    there = found.select(F.col("added_rel").alias("rel"), F.col("deleted_rel").alias("moved_from"), none.cast("string").alias("moved_to"), "move_status", F.col("similarity").alias("move_similarity"), F.col("hunks").alias("_hunks"), F.col("renames").alias("_renames"))
    gone = found.select(F.col("deleted_rel").alias("rel"), none.cast("string").alias("moved_from"), F.col("added_rel").alias("moved_to"), "move_status", F.col("similarity").alias("move_similarity"), none.cast(dict(found.dtypes)["hunks"]).alias("_hunks"), none.cast("map<string,string>").alias("_renames"))
    both = kept.join(there.unionByName(gone), "rel", "left")
    return both.withColumns({"hunks": F.coalesce("_hunks", "hunks"), "renames": F.coalesce("_renames", "renames")}).drop("_hunks", "_renames")


def tree_facts(results: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Fact differences of files that really changed or stand on one side, from two trees (rel, text)."""
    wanted = results.where(F.col("status").isin("real-change", "added", "deleted")).select("rel")

    def of(tree: DataFrame) -> DataFrame:
        rows = tree.join(wanted, "rel", "left_semi").select("rel", text.unix_lines(F.col("text")).alias("text"))
        return checkpointed(facts.text_facts(rows).unionByName(facts.xml_facts(rows.where(text.ruleset(F.col("rel")) == "arxml"))))

    return facts.fact_diff(of(old), of(new))


def parsed_files(results: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel, has_facts): whether both sides of a changed XML file could be parsed."""
    changed = results.where((F.col("status") == "real-change") & (text.ruleset(F.col("rel")) == "arxml"))
    sides = [facts.xml_facts(t.join(changed.select("rel"), "rel", "left_semi").select("rel", text.unix_lines(F.col("text")).alias("text"))) for t in (old, new)]
    broken = sides[0].unionByName(sides[1]).where("not parsed").select("rel").distinct()
    return changed.select("rel").join(broken.withColumn("broken", F.lit(True)), "rel", "left").select("rel", F.col("broken").isNull().alias("has_facts"))


def linked_moves(results: DataFrame, old: DataFrame, new: DataFrame, guard: int | None = None) -> DataFrame:
    """(added_rel, deleted_rel, similarity, move_status, hunks, renames) of files that moved, compared across their paths.

    Files whose binary is true, if the trees have that column, meet by content alone. results (rel, status) and the pairs found are kept; texts are read for the pairs alone.
    """
    found = checkpointed(results.select("rel", "status"))
    pairs = checkpointed(moves.find(only_in(new, found, "added"), only_in(old, found, "deleted"), guard))
    olds, news = (t.withColumnRenamed("rel", c) for t, c in ((old, "deleted_rel"), (new, "added_rel")))
    olds = olds.join(pairs.select("deleted_rel", F.col("added_rel").alias("rel")), "deleted_rel").select("rel", "text")
    news = news.join(pairs.select("added_rel"), "added_rel", "left_semi").select(F.col("added_rel").alias("rel"), "text")
    judged = scan_texts(olds, news).select(F.col("rel").alias("added_rel"), F.col("status").alias("move_status"), "hunks", "renames")
    return pairs.join(judged, "added_rel")
