"""Benchmark decontamination: broadcast hash set of normalised test n-grams, scanned over training token windows.

Native: DataFrame functions alone. Words are [0-9a-z] and non-ASCII runs after lower-casing A-Z. A window is
`size` consecutive words of a benchmark item, or all of a shorter item. The windows' 64-bit hashes are joined by
broadcast to the hashes of all document windows; a hit counts only if the words are equal too.

The windows are broadcast if they are few enough and their text is short enough. Beyond that the hashes of document
windows alone, with the row's number and place, are shuffled to them; the few that hit go back to their rows' words.

Nulls and empty texts have no words, no hits and no items. Rows are kept apart even if ids repeat or are null; equal
texts have equal results. Very long texts are scanned whole. Extra columns of either input are ignored, and none can
clash with those made here. An empty benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import ascii_lower, checkpointed, small, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def norm_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """One row per distinct window: its length, its words joined by a space, their hash, the items that hold it."""
    words = benchmark.select(F.col(item_col).cast("string").alias("item"), norm_words(F.col(text_col)).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(size)))
    at = words.select("item", "len", "words", F.explode_outer(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"))
    grams = at.select("item", "len", F.slice("words", F.col("at"), F.col("len")).alias("gram"))
    grams = grams.select("item", "len", F.xxhash64("gram").alias("window_hash"), F.array_join("gram", " ").alias("gram"))
    return grams.groupBy("len", "window_hash", "gram").agg(F.collect_set("item").alias("items"))


#: Windows, and bytes of their words and items, that are broadcast at most.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 256 << 20


def _fits(windows: DataFrame, most: int) -> tuple[list[int], bool]:
    """The lengths of windows, and whether they may be broadcast."""
    size = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8)
    found = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.collect_set("len").alias("lens")).first()
    return sorted(found["lens"]), found["n"] <= most and found["bytes"] <= BROADCAST_BYTES


def _places(rows: DataFrame, lens: list[int], first: int = 1) -> DataFrame:
    """rows (with _words) with _at and _len of each window that fits, from place first; place 0 is no window and stands for the row."""
    lens = lens or [1]
    n = F.size("_words")
    rows = rows.withColumn("_at", F.explode_outer(F.when(n - lens[0] + 1 >= first, F.sequence(F.lit(first), F.greatest(n - lens[0] + 1, F.lit(first))))))
    if first == 0:
        rows = rows.withColumn("_at", F.coalesce("_at", F.lit(0)))
    if len(lens) == 1:
        return rows.withColumn("_len", F.lit(lens[0]))
    rows = rows.withColumn("_len", F.explode_outer(F.lit(lens)))
    return rows.where((F.col("_at") > 0) & (F.col("_at") + F.col("_len") <= n + 1) | (F.col("_at") == 0) & (F.col("_len") == lens[0]))


def _named(windows: DataFrame) -> DataFrame:
    return windows.select(F.col("len").alias("_wlen"), F.col("window_hash").alias("_whash"), F.col("gram").alias("_gram"), F.col("items").alias("_items"))


def _union(hits: Column) -> Column:
    """Words in the union of windows (_at, _len), which are in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(hits, start, lambda a, h: F.struct(
        (a["n"] + F.greatest(F.lit(0), h["_at"] + h["_len"] - F.greatest(a["end"], h["_at"]))).alias("n"), F.greatest(a["end"], h["_at"] + h["_len"]).alias("end")))["n"].cast("long")


def window_hits(docs: DataFrame, windows: DataFrame, text_col: str = "text", keep: list[str] = (), broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """For each row of docs: the columns of keep, n_words, n_hit and items (ids of the items with occurring windows)."""
    lens, few = _fits(windows, broadcast_windows)
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct(*[F.col(c) for c in keep]).alias("_keep"), norm_words(F.col(text_col)).alias("_words"))
    w, on = _named(windows), (F.col("_hash") == F.col("_whash")) & (F.col("_len") == F.col("_wlen"))
    gram = F.slice("_words", F.col("_at"), F.col("_len"))
    if few:
        rows = _places(rows, lens, first=0)
        head = F.col("_at") == 0
        rows = rows.withColumn("_hash", F.when(~head, F.xxhash64(F.when(~head, gram))))
        said = F.array_join(F.when(~head & F.col("_gram").isNotNull(), gram), " ")
        joined = rows.join(F.broadcast(w), on, "left").where(head | F.col("_whash").isNotNull())
        joined = joined.select("_uid", "_at", "_len", "_items", (~head & (F.col("_gram") == said)).alias("_hit"), F.when(head, F.struct(F.size("_words").alias("_n"), "_keep")).alias("_row"))
        per = joined.groupBy("_uid").agg(
            F.first("_row", ignorenulls=True).alias("_row"), F.sort_array(F.collect_set(F.when(F.col("_hit"), F.struct("_at", "_len")))).alias("_hits"),
            F.array_distinct(F.flatten(F.collect_set(F.when(F.col("_hit"), F.col("_items"))))).alias("items"))
        return per.select(*[F.col("_row")["_keep"][c].alias(c) for c in keep], F.col("_row")["_n"].cast("long").alias("n_words"), _union(F.col("_hits")).alias("n_hit"), "items")
    rows = written(rows, "words")  # numbers stay with their rows from here on
    places = _places(rows.select("_uid", "_words"), lens).where("_at is not null").select("_uid", "_at", "_len", F.xxhash64(gram).alias("_hash"))
    maybe = places.join(w.select("_whash", "_wlen").distinct(), on).groupBy("_uid").agg(F.collect_set(F.struct("_at", "_len", "_hash")).alias("_maybe"))
    found = rows.select("_uid", "_words").join(maybe, "_uid").select("_uid", "_words", F.explode("_maybe").alias("m")).select("_uid", "m.*", F.array_join(F.slice("_words", F.col("m._at"), F.col("m._len")), " ").alias("_said"))
    hits = found.join(w, on & (F.col("_said") == F.col("_gram"))).groupBy("_uid").agg(F.sort_array(F.collect_set(F.struct("_at", "_len"))).alias("_hits"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_found"))
    none = F.array().cast("array<string>")
    joined = rows.select("_uid", "_keep", F.size("_words").cast("long").alias("_n")).join(hits, "_uid", "left")
    return joined.select(*[F.col("_keep")[c].alias(c) for c in keep], F.col("_n").alias("n_words"), F.coalesce(_union(F.col("_hits")), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_found", none).alias("items"))


def contaminated() -> Column:
    """The contamination rule: a hit, and a twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; all columns and whole texts stay as they are.

    Contamination is a matter of the text alone, so that only hits are shuffled, by a digest of their text, and the few
    contaminated digests are joined back. Rows are not moved for it.
    """
    windows = benchmark_windows(benchmark)
    lens, few = _fits(windows, BROADCAST_WINDOWS)
    if not few:
        rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_text"))
        hits = window_hits(rows, windows, "_text", keep=["_doc"])
        return hits.where(~contaminated()).select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
    gram = F.slice("_words", F.col("_at"), F.col("_len"))
    places = _places(docs.select(F.sha2(F.col(text_col).cast("string"), 256).alias("_key"), norm_words(F.col(text_col)).alias("_words")), lens).where("_at is not null")
    met = places.withColumn("_hash", F.xxhash64(gram)).join(F.broadcast(_named(windows)), (F.col("_hash") == F.col("_whash")) & (F.col("_len") == F.col("_wlen")))
    hits = met.where(F.col("_gram") == F.array_join(gram, " ")).select("_key", F.size("_words").alias("n_words"), "_at", "_len")
    per = hits.groupBy("_key", "n_words").agg(F.sort_array(F.collect_set(F.struct("_at", "_len"))).alias("_hits")).withColumn("n_hit", _union(F.col("_hits")))
    gone = small(checkpointed(per.where(contaminated()).select(F.col("_key").alias("_contaminated"))))
    return docs.join(gone, F.sha2(docs[text_col].cast("string"), 256) == gone["_contaminated"], "left_anti")
