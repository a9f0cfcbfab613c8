"""URL filters: rules by host and path, then naive Bayes over segmented host and path tokens.

Concatenated host names are split into words by unigram Viterbi; the unigrams are counted over the titles of all pages.
Multinomial naive Bayes learns from the urls that a rule decides, all of them, and judges the others. Neither model is
fetched or held as a whole: each distinct host label is segmented with the words found in it alone, and tokens meet their
counts in joins. No word, token or length is left out. Log ratios are summed as whole billionths, so that the order of
addition does not matter.

A null url, or one without ://, has an empty host and path and no tokens: the prior decides. Rows are judged one by
one, so repeated rows, ties and null ids do not matter; at even odds a url is allowed. Kept columns may have any name but
give way to those of the result. Very long hosts and paths are judged whole. Without any decided url all are allowed. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import ascii_lower, checkpointed, looked_up, written

# Fixed values: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
MATCHES = "array<struct<start:int,length:int,log_p:double>>"
OWN = ("host", "path", "rule", "verdict")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, whole."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host and path, and its verdict; null if none fits. Of equal lengths the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def unigrams(texts: DataFrame, text_col: str) -> DataFrame:
    """w, count: the words of all rows."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[a-z]+"), 0)).alias("w"))
    return checkpointed(words.groupBy("w").count())


def segment(name: str, matches: list[tuple[int, int, float]], floor: float) -> list[str]:
    """The most probable words of a concatenated name, of which matches (first place, length, log probability) are known.

    An unknown stretch costs floor, and floor for each character. At equal probability the longer last word is taken.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, length, p in sorted(matches):
        ends.setdefault(start + length, []).append((start, p))
    n = len(name)
    # Best ends in a word and in an unknown stretch, and where that began.
    word, stretch = [(0.0, 0)] + [(-math.inf, 0)] * n, [(-math.inf, 0)] * (n + 1)
    for i in range(1, n + 1):
        for start, p in ends.get(i, ()):
            if (q := max(word[start][0], stretch[start][0]) + p) > word[i][0]:
                word[i] = q, start
        begun, going = word[i - 1][0] + 2 * floor, stretch[i - 1][0] + floor
        stretch[i] = (begun, i - 1) if begun > going else (going, stretch[i - 1][1])
    out, i = [], n
    while i:
        start = (word if word[i][0] >= stretch[i][0] else stretch)[i][1]
        out.append(name[start:i])
        i = start
    return out[::-1]


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label and words of each label (distinct, not empty), by the unigrams in counts (w, count).

    Of a label only stretches as long as some word are looked up, each place and length once.
    """
    total, least, lengths = counts.agg(F.sum("count"), F.min("count"), F.collect_set(F.length("w"))).first()
    floor = (math.log(least / (total + 1)) if total else 0.0) - 2
    at = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("s"))
    left = F.length("label") - F.col("s") + 1
    parts = at.select("label", "s", F.explode_outer(F.filter(F.lit(sorted(lengths) or [1]), lambda n: n <= left)).alias("n"))
    parts = parts.select("label", "s", "n", F.when(F.col("n").isNotNull(), F.expr("substring(label, s, n)")).alias("w"))
    known = counts.select("w", F.log(F.col("count") / F.lit(float((total or 0) + 1))).alias("log_p"))
    match = F.struct((F.col("s") - 1).cast("int").alias("start"), F.col("n").cast("int").alias("length"), "log_p")
    per = looked_up(parts, known, "w").groupBy("label").agg(F.collect_list(F.when(F.col("log_p").isNotNull(), match)).cast(MATCHES).alias("matches"))

    @F.pandas_udf("array<string>")
    def run(names: pd.Series, matches: pd.Series) -> pd.Series:
        return pd.Series([segment(x, [(m["start"], m["length"], m["log_p"]) for m in found], floor) for x, found in zip(names, matches, strict=True)], dtype=object)

    return checkpointed(per.select("label", run("label", "matches").alias("words")))


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host and words of each distinct host: those of its labels, in order."""
    labels = hosts.select("host", F.posexplode(F.split("host", "[^a-z0-9]+")).alias("at", "label")).where("label <> ''")
    found = looked_up(labels, segmented(labels.select("label").distinct(), counts), "label")
    per = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("all"))
    return checkpointed(per.select("host", F.flatten(F.transform("all", lambda x: x["words"])).alias("words")))


def tokens(words: Column, path: Column) -> Column:
    """Host words, and path words with numbers made one."""
    hosts = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w))
    parts = F.array_remove(F.split(F.lower(path), "[^a-z0-9]+"), "")
    return F.concat(hosts, F.transform(parts, lambda w: F.concat(F.lit("p:"), F.regexp_replace(w, "[0-9]+", "0"))))


def train(judged: DataFrame) -> tuple[DataFrame, float, float]:
    """From rows (tokens, verdict): each token's log ratio of block to allow in billionths, what every token adds, the prior's.

    A token's probability is its count and one, over all tokens of the verdict and one for each distinct token.
    """
    counts = judged.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "block")])
    counts = checkpointed(counts)
    distinct, allowed, blocked = counts.agg(F.count("*"), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    prior = judged.agg(F.log((F.count_if(F.col("verdict") == "block") + 1) / (F.count_if(F.col("verdict") == "allow") + 1))).first()[0]
    ratio = F.round(F.log((F.col("block") + 1) / (F.col("allow") + 1)) * 1e9).cast("long")
    return counts.select("token", ratio.alias("ratio")), math.log((allowed + distinct) / (blocked + distinct)) if distinct else 0.0, prior


def judge(pages: DataFrame, counts: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", keep: list[str] = ()) -> DataFrame:
    """keep with host, path, rule, verdict of each row. counts: unigrams()."""
    keep = [c for c in keep if c.lower() not in OWN]
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.struct(*[F.col(c) for c in keep]).alias("_keep"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = looked_up(rows, host_words(rows.select("host").distinct(), counts), "host")
    rows = rows.select(F.monotonically_increasing_id().alias("_uid"), "_keep", "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens(F.col("words"), F.col("path")).alias("tokens"))
    rows = written(rows, "urls")  # numbers stay with their rows from here on
    ratios, each, prior = train(rows.where("verdict is not null").select("tokens", "verdict"))
    open_rows = rows.where("verdict is null").select("_uid", F.explode("tokens").alias("token"))
    sums = looked_up(open_rows, ratios, "token").groupBy("_uid").agg((F.coalesce(F.sum("ratio"), F.lit(0)) / 1e9 + F.count(F.lit(1)) * each).alias("odds"))
    bayes = F.when(F.coalesce("odds", F.lit(0.0)) + prior > 0, "block").otherwise("allow")
    judged = rows.drop("tokens").join(sums, "_uid", "left")
    return judged.select(*[F.col("_keep")[c].alias(c) for c in keep], "host", "path", "rule", F.coalesce("verdict", bayes).alias("verdict"))
