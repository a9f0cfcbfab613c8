"""Secret scans: fixed patterns, and character Markov models that tell random strings from identifiers.

Native: DataFrame functions alone. Two first-order models over ASCII characters, one of random strings (labelled
samples drawn from hashes) and one of ordinary identifiers (words of a bounded sample of rows), are compared by the
mean log-likelihood ratio per character step. Tokens of MIN_TOKEN characters or more that look random are added as
spans of kind `markov` to those of the patterns; pattern spans always stay, and spans of two kinds may overlap.

Null and empty texts have no spans; very long ones are scanned whole. Rows are scanned one by one, so repeated rows, ties and null ids each keep their
row; extra columns are ignored or kept, whatever their names; an empty table gives an empty result, with the model of random strings against a
uniform one. Spans are in code points with the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns, and the least length of the group that decides.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
KINDS = [*PATTERNS, "markov"]
#: Rows whose words train the identifier model, and random strings of each alphabet.
SAMPLE_ROWS, RANDOM_STRINGS = 2000, 2000


def _steps(tokens: DataFrame, label: int) -> DataFrame:
    """Counts of character pairs within the tokens, by cell first * 128 + second."""
    at = tokens.select("tok", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.length("tok") - 1, F.lit(1)))).alias("i")).where(F.length("tok") > 1)
    cell = F.ascii(F.substr("tok", F.col("i"), F.lit(1))) * 128 + F.ascii(F.substr("tok", F.col("i") + 1, F.lit(1)))
    return at.groupBy(cell.alias("cell")).count().withColumn("label", F.lit(label))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-likelihood ratio of each character step, random over ordinary, as 128 * 128 cells.

    About sample_rows rows, those whose ids have the smallest hashes, give the ordinary identifiers. Two times
    128 * 128 counts at most come to the driver.
    """
    spark = docs.sparkSession
    n = max(1, docs.select(F.count("*")).first()[0])
    few = docs.where(F.xxhash64(id_col).bitwiseAND(2**31 - 1) < int(min(1.0, sample_rows / n) * 2**31))
    words = few.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"[A-Za-z0-9_-]{3,}"), 0)).alias("tok"))
    words = words.where(~F.col("tok").rlike("[0-9]{4,}"))
    digest = F.sha2(F.col("id").cast("string"), 512)
    rnd = spark.range(RANDOM_STRINGS).select(F.explode(F.array(F.substr(digest, F.lit(1), F.lit(40)), F.substr(F.base64(F.unhex(digest)), F.lit(1), F.lit(48)), F.concat(F.lit("AKIA"), F.substr(F.upper(F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 36)), F.lit(1), F.lit(16))))).alias("tok"))
    counts = [{}, {}]
    for r in _steps(words, 0).unionByName(_steps(rnd, 1)).collect():
        counts[r["label"]][r["cell"]] = r["count"]
    used = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]

    def logs(cells: dict) -> dict:
        out = {}
        for a in used:
            total = sum(cells.get(a * 128 + b, 0) for b in used) + 0.5 * len(used)
            out |= {a * 128 + b: math.log((cells.get(a * 128 + b, 0) + 0.5) / total) for b in used}
        return out

    ordinary, random = logs(counts[0]), logs(counts[1])
    return [round(random.get(c, 0.0) - ordinary.get(c, 0.0), 6) for c in range(128 * 128)]


def llr(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character step of an ASCII token; above 0: more like a random string."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    step = lambda i: F.element_at(table, F.ascii(F.substr(token, i, F.lit(1))) * 128 + F.ascii(F.substr(token, i + 1, F.lit(1))) + 1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda a, i: a + step(i))
    return total / (F.length(token) - 1)


def _matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """For each match, in order: kind, number, characters before it since the last match, its own, whether it counts, the token."""
    full = F.regexp_extract_all(text, F.lit(pattern), 0)
    deciding = F.regexp_extract_all(text, F.lit(pattern), group) if group else full
    gaps = F.split(text, pattern, -1)
    rows = F.transform(F.arrays_zip(full.alias("m"), deciding.alias("g"), F.slice(gaps, 1, F.size(full)).alias("b")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("no"), F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("len"),
        (F.length(x["g"]) >= least).alias("ok"), (x["m"] if kind == 3 else F.lit("")).alias("tok")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,no:int,gap:int,len:int,ok:boolean,tok:string>>"))


def scan(docs: DataFrame, model: list[float], text_col: str = "text", keep: list[str] = (), threshold: float = 1.0) -> DataFrame:
    """keep of each row, with spans: array of (start, kind, end) in order of start and then kind, kind as in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct(*[F.col(c) for c in keep]).alias("_keep"), text.alias("_text"))
    found = [_matches(F.col("_text"), p, i, g, n) for i, (p, g, n) in enumerate(PATTERNS.values())] + [_matches(F.col("_text"), TOKEN, 3, 0, MIN_TOKEN)]
    head = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("no"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(False).alias("ok"), F.lit("").alias("tok")))
    rows = rows.select("_uid", "_keep", F.explode_outer(F.concat(head, *found)).alias("_m"))
    rows = rows.select("_uid", F.when(F.col("_m.kind") < 0, F.col("_keep")).alias("_keep"), "_m.*")
    # A match of the last kind counts if the random model likes it better.
    rows = rows.withColumn("ok", F.when(F.col("kind") == 3, F.when(F.length("tok") >= MIN_TOKEN, llr(F.col("tok"), model) > threshold).otherwise(False)).otherwise(F.col("ok"))).drop("tok")
    so_far = Window.partitionBy("_uid", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int"))
    span = F.struct((F.col("end") - F.col("len")).cast("int").alias("start"), F.col("kind"), F.col("end"))
    per = rows.groupBy("_uid").agg(F.first(F.when(F.col("kind") < 0, F.col("_keep")), ignorenulls=True).alias("_keep"), F.sort_array(F.collect_list(F.when(F.col("ok"), span))).alias("spans"))
    return per.select(*[F.col("_keep")[c].alias(c) for c in keep], "spans")


def said(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mask: str = "[SECRET]", threshold: float = 1.0) -> DataFrame:
    """docs with mask in place of each secret, kind after kind; failing matches, null texts and other columns stay."""
    text = F.col(text_col)
    for kind, (pattern, group, least) in {**PATTERNS, "markov": (TOKEN, 0, MIN_TOKEN)}.items():
        full = F.regexp_extract_all(text, F.lit(pattern), 0)
        deciding = F.regexp_extract_all(text, F.lit(pattern), group)
        gaps = F.split(text, pattern, -1)
        if kind == "markov":
            new = F.transform(full, lambda m: F.when(llr(m, model) > threshold, F.lit(mask)).otherwise(m))
        else:
            long_enough = F.lit(least)
            new = F.zip_with(full, deciding, lambda m, g: F.when(F.length(g) >= long_enough, F.lit(mask)).otherwise(m))
        text = F.when(text.rlike(pattern), F.array_join(F.zip_with(gaps, new, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")).otherwise(text)
        docs = docs.withColumn(text_col, text)
        text = F.col(text_col)
    return docs
