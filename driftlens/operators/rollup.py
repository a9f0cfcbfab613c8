"""Counts and verdicts over results: status totals, folders, models, advisories, exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.text import ruleset
from driftlens.sources.stored import checkpointed

# Fixed values.
STATUSES = ("identical", "comment-only", "ignorable-only", "real-change", "added", "deleted", "error")
FOLDABLE = ("comment-only", "ignorable-only")
CHANGED = ("real-change", "added", "deleted", "error")
PRIORITY = {"error": 5, "real-change": 4, "added": 2, "deleted": 2, "ignorable-only": 1, "comment-only": 0, "identical": -1}
SHARED = "Shared / other"
SPLIT_XML = r"(?i)^(.+)_(component|datatypes?|interfaces?|implementation|behavior|timing)$"


def status_summary(results: DataFrame) -> DataFrame:
    """One row with a count of each status, zeros included."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES])


def exit_code(results: DataFrame, exit_zero: bool = False) -> DataFrame:
    """2 if anything could not be compared; else 1 if anything changed, unless exit_zero."""
    wrong, changed = F.count_if(F.col("status") == "error") > 0, F.count_if(F.col("status").isin("real-change", "added", "deleted")) > 0
    return results.agg(F.when(wrong, 2).when(changed & F.lit(not exit_zero), 1).otherwise(0).alias("exit_code"))


def fold(results: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Noise statuses counted as identical, with a note; hunks stay. No file is read again."""
    folded = F.col("status").isin(*[s for s in statuses if s in FOLDABLE]) if set(statuses) & set(FOLDABLE) else F.lit(False)
    notes = F.when(folded, F.concat("notes", F.array(F.concat(F.lit("folded: "), "status")))).otherwise(F.col("notes"))
    return results.withColumns({"notes": notes, "status": F.when(folded, "identical").otherwise(F.col("status"))})


def directories(files: DataFrame, path_col: str = "rel") -> DataFrame:
    """One row per file and folder above it, the root being ''."""
    parts = F.split(path_col, "/", -1)
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return files.withColumn("dir", F.explode(up))


def directory_rollup(results: DataFrame) -> DataFrame:
    """Per folder: its files, and the status of the highest priority below it; of equals the one of the least path."""
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    rows = directories(results).withColumn("priority", table[F.col("status")])
    return rows.groupBy("dir").agg(F.count("*").alias("files"), F.max("priority").alias("priority"), F.min_by("status", F.struct(-F.col("priority"), F.col("rel"))).alias("status"))


def stem(rel: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(rel, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def model_names(files: DataFrame) -> DataFrame:
    """Names that own files: stems of C files and of split XML exports; X_data gives way to X."""
    s, low = stem(F.col("rel")), F.lower("rel")
    name = F.when(low.endswith(".c"), s).when(low.endswith(".arxml") & s.rlike(SPLIT_XML), F.regexp_extract(s, SPLIT_XML, 1))
    found = files.select(name.alias("model")).where("model is not null").distinct()
    base = found.select(F.col("model").alias("base"))
    data = found.withColumn("base", F.regexp_extract("model", r"(?i)^(.+)_data$", 1))
    return data.join(base, "base", "left_anti").select("model")


def model_groups(files: DataFrame) -> DataFrame:
    """(rel, model) of files. A file belongs to the longest model that its stem is, begins with (and _) or has after Rte_.

    Each stem's possible owners (its prefixes up to a _) are made and looked up, so that files meet models by equality.
    A model needs three files or an .arxml file; other files are shared.
    """
    s = stem(F.col("rel"))
    parts = F.split(s, "_", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))
    owners = F.array_distinct(F.concat(prefixes, F.when(s.startswith("Rte_"), F.array(F.substr(s, F.lit(5)))).otherwise(F.array())))
    rows = files.select("rel", F.explode(owners).alias("model")).join(model_names(files), "model")
    best = rows.groupBy("rel").agg(F.max_by("model", F.struct(F.length("model"), F.col("model"))).alias("model"))
    big = best.groupBy("model").agg(F.count("*").alias("n"), F.max(F.lower("rel").endswith(".arxml")).alias("xml")).where("n >= 3 or xml").select("model")
    kept = best.join(big, "model")
    return files.select("rel").join(kept, "rel", "left").select("rel", F.coalesce("model", F.lit(SHARED)).alias("model"))


def model_counts(results: DataFrame, groups: DataFrame) -> DataFrame:
    """Status counts of each model."""
    return results.join(groups, "rel").groupBy("model").agg(F.count("*").alias("files"), *[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES])


def fact_counts(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Facts added, removed and changed, of each model and type."""
    rows = facts.join(groups, "rel").groupBy("model", "fact_type")
    return rows.agg(*[F.count_if(F.col("change") == c).alias(n) for c, n in (("+", "added"), ("-", "removed"), ("~", "changed"))])


def advisories(results: DataFrame, groups: DataFrame, facts: DataFrame) -> DataFrame:
    """(model, message): surfaces that changed while the C did not, and access points gained while a peer stayed identical.

    An XML file with a status of change and no parse (has_facts false) counts as changed; so does a binary A2L file.
    """
    moved = facts.groupBy("rel").agg(F.max(F.col("fact_type").isin("iface", "swc", "port", "runnable", "event")).alias("xml_moved"), F.max(F.col("fact_type") == "a2l").alias("a2l_moved"), F.max((F.col("fact_type") == "rte") & (F.col("change") == "+")).alias("rte_added"))
    rows = results.join(groups, "rel").where(F.col("model") != SHARED).join(moved, "rel", "left").withColumn("family", ruleset(F.col("rel")))
    changed = F.col("status").isin(*CHANGED)
    is_c, is_xml, is_a2l = (F.col("family") == k for k in ("c", "arxml", "a2l"))
    no = F.lit(False)
    per = checkpointed(rows.groupBy("model").agg(
        F.max(is_c).alias("has_c"), F.max(is_c & changed).alias("c_changed"), F.min(~is_c | (F.col("status") == "identical")).alias("c_same"),
        F.max(is_xml & (F.coalesce("xml_moved", no) | (changed & ~F.coalesce("has_facts", no)))).alias("xml"),
        F.max(is_a2l & (F.coalesce("a2l_moved", no) | (changed & F.coalesce("binary", no)))).alias("a2l"), F.max(F.coalesce("rte_added", no)).alias("rte")))  # a row per model, read three times
    surfaces = F.array_join(F.filter(F.array(F.when(F.col("xml"), "ARXML"), F.when(F.col("a2l"), "A2L")), lambda x: x.isNotNull()), " and ")
    stale = per.where(F.col("has_c") & ~F.col("c_changed") & (F.col("xml") | F.col("a2l"))).select("model", F.concat(surfaces, F.lit(" changed but the generated C did not")).alias("message"))
    a_peer_stayed = not per.where("has_c and c_same").isEmpty()
    gained = per.where(F.col("rte") & F.lit(a_peer_stayed)).select("model", F.lit("gained an RTE access while a peer model stayed identical -- regenerate the architecture before integrating").alias("message"))
    return stale.unionByName(gained)
