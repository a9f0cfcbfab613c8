"""Quality rules: weak supervision over rules that vote or abstain. Native: DataFrame functions alone.

Each rule looks at counts of one whole text and votes good or bad or abstains. Expectation-maximisation over the
counts of all vote patterns (3 ** rules at most, whatever the corpus) estimates how often each rule casts each vote
on good and on bad documents. The posterior probability of good replaces all-must-pass filtering.

Null and empty texts have no words: all counts 0, base_failed; very long ones are counted whole. Rows are judged one by one, so ties, repeated rows and
null ids do not matter; extra columns are ignored. An empty table gives an empty result. Repeated 8-word windows are
found by 64-bit hashes within a text; unlike windows meet there with a chance of about n * n / 2 ** 65.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import SPACE, space_words, written

WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_upper", "n_bang", "n_odd_words", "n_ended"]

#: name: (numerator, denominator, good up to, bad from); with good above bad, high values are good.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.02, 0.15),
    "repeats": ("n_repeat_words", "n_words", 0.05, 0.2),
    "dup_lines": ("n_dup_lines", "n_lines", 0.1, 0.5),
    "shouting": ("n_upper", "word_chars", 0.1, 0.35),
    "exclaims": ("n_bang", "n_words", 0.05, 0.3),
    "odd_words": ("n_odd_words", "n_words", 0.1, 0.3),
    "variety": ("n_distinct", "n_words", 0.45, 0.2),
    "word_length": ("word_chars", "n_words", 6.5, 9.0),
    "endings": ("n_ended", "n_lines", 0.8, 0.3),
}


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of WINDOW words whose hash comes twice or more in the text.

    Only texts with a repeated hash get past the first step. Their (hash, place) pairs are sorted; a place counts if
    a neighbour has the same hash; then the windows' union is measured in order of place.
    """
    n = F.size("_words")
    df = df.withColumn("_h", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_more", F.size(F.array_distinct("_h")) < F.size("_h"))
    df = df.withColumn("_s", F.when(F.col("_more"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    before = F.concat(F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("i"))), F.slice("_s", 1, F.size("_s") - 1))
    df = df.withColumn("_b", F.when(F.col("_more"), before)).withColumn("_a", F.when(F.col("_more"), F.slice("_s", 2, F.size("_s"))))
    df = df.withColumn("_z", F.when(F.col("_more"), F.arrays_zip("_s", "_b", "_a")))
    twice = F.filter("_z", lambda z: (z["_s"]["h"] == z["_b"]["h"]) | F.coalesce(z["_s"]["h"] == z["_a"]["h"], F.lit(False)))
    df = df.withColumn("_p", F.when(F.col("_more"), F.sort_array(F.transform(twice, lambda z: z["_s"]["i"]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    n_repeat = F.aggregate("_p", start, lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + WINDOW).alias("end")))
    return df.withColumn("n_repeat_words", F.when(F.col("_more"), n_repeat["n"]).otherwise(F.lit(0))).drop("_h", "_more", "_s", "_b", "_a", "_z", "_p")


def features(docs: DataFrame, text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """keep, as a struct _keep, with COUNTS and MORE of each row's whole text, base_failed, and the rules' votes.

    A vote is 1 for good, 0 for bad, -1 to abstain. keep is wrapped so that its names can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_keep"), text.alias("_text"), space_words(text).alias("_words"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _with_repeats(df)
    df = df.select(
        "_keep",
        F.size("_words").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").alias("n_lines"),
        F.size(F.array_distinct("_words")).alias("n_distinct"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("_text", F.lit("!")).alias("n_bang"),
        F.size(F.filter("_words", lambda w: ~w.rlike(r"\p{L}"))).alias("n_odd_words"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?…。\"'»”)][\x20\x09-\x0D]*$"))).alias("n_ended"),
    )
    df = df.select("_keep", *[F.col(c).cast("long").alias(c) for c in COUNTS + MORE])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumns({f"v_{k}": vote(*r) for k, r in RULES.items()})


def vote(top: str, bottom: str, good: float, bad: float) -> Column:
    """1 for good, 0 for bad, -1 for neither or where there is nothing to divide by."""
    x = F.col(top) / F.col(bottom)
    is_good, is_bad = (x <= good, x >= bad) if good < bad else (x >= good, x <= bad)
    return F.when(F.col(bottom) == 0, F.lit(-1)).when(is_good, F.lit(1)).when(is_bad, F.lit(0)).otherwise(F.lit(-1))


def fit(votes: DataFrame, rounds: int = 50) -> dict:
    """EM on all rows of votes (columns v_<rule>). Returns the prior of good and, per rule, P(vote | good or bad).

    Only the counts of distinct vote patterns come to the driver: 3 ** len(RULES) rows at most.
    """
    names = [f"v_{k}" for k in RULES]
    # base_failed is a key, not a filter: Spark would repeat the counting of a text in a filter below it.
    counted = votes.groupBy("base_failed", *names).count().collect()
    return em({tuple(r[k] for k in names): r["count"] for r in counted if not r["base_failed"]}, rounds)


def em(patterns: dict[tuple, int], rounds: int = 50) -> dict:
    """The E and M steps over counted vote patterns, in a fixed order so that sums come out the same."""
    m = len(RULES)
    prior = 0.8
    # At the start a rule's bad vote is five times as likely on a bad document; votes count a little beforehand.
    good = [{1: 0.6, 0: 0.05, -1: 0.35} for _ in range(m)]
    bad = [{1: 0.4, 0: 0.25, -1: 0.35} for _ in range(m)]
    rows = sorted(patterns.items())
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        sums = [[{1: 1.0, 0: 0.01, -1: 0.5} for _ in range(m)], [{1: 0.3, 0: 1.0, -1: 0.5} for _ in range(m)]]
        n_good = 0.0
        for vs, n in rows:
            p = posterior(vs, {"prior": prior, "good": good, "bad": bad})
            n_good += n * p
            for j, v in enumerate(vs):
                sums[0][j][v] += n * p
                sums[1][j][v] += n * (1 - p)
        prior = min(max((n_good + 4) / (total + 5), 0.05), 0.99)
        good, bad = ([{v: s / sum(d.values()) for v, s in d.items()} for d in side] for side in sums)
    return {"prior": prior, "good": good, "bad": bad}


def posterior(votes: tuple, model: dict) -> float:
    x = math.log(model["prior"] / (1 - model["prior"])) + sum(math.log(g[v] / b[v]) for v, g, b in zip(votes, model["good"], model["bad"], strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def p_good(model: dict) -> Column:
    """The posterior as a column over v_<rule>, the rules' log ratios added in the order of RULES."""
    terms = [F.lit(math.log(model["prior"] / (1 - model["prior"])))]
    for k, g, b in zip(RULES, model["good"], model["bad"], strict=True):
        w = {v: math.log(g[v] / b[v]) for v in (1, 0, -1)}
        terms.append(F.when(F.col(f"v_{k}") == 1, F.lit(w[1])).when(F.col(f"v_{k}") == 0, F.lit(w[0])).otherwise(F.lit(w[-1])))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def judged(scored: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """scored with p_good, and kept: passed the base, and good by the threshold or more."""
    return scored.withColumn("p_good", p_good(model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def good_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept rows of docs with all their columns. The model is fitted on every row, then every row is judged.

    Counts are made once and written beside the rows; fitting reads the votes alone.
    """
    scored = written(features(docs, text_col, keep=docs.columns).drop(*COUNTS, *MORE), "scored")
    return judged(scored, fit(scored)).where("kept").select(*[F.col("_keep")[c].alias(c) for c in docs.columns])
