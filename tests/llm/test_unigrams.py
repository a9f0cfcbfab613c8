"""URL judgements against a plain version that shares no code, and segmentation against all ways to cut."""

import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftlens.llm import queries_web, urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def best_cut(name, words, floor):
    """By dynamic programming over all stretches; the cost is what counts."""
    best = [(0.0, [])]
    for end in range(1, len(name) + 1):
        best.append(max(((best[s][0] + words.get(name[s:end], floor * (1 + end - s)), best[s][1] + [name[s:end]]) for s in range(end)), key=lambda x: x[0]))
    return best[-1]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def judged(rows):
    titles = Counter(w for r in rows for t in re.findall(r"(?is)<title[^>]*>(.*?)</title", r["html"] or "")[:1] for w in re.findall("[a-z]+", t.lower()))
    total = sum(titles.values()) + 1
    words = {w: math.log(n / total) for w, n in titles.items()}
    floor = min(words.values(), default=0.0) - 2
    cut: dict = {}

    def toks(h, p):
        for x in re.split("[^a-z0-9]+", h):
            if x and x not in cut:
                cut[x] = best_cut(x, words, floor)[1]
        return [f"h:{w}" for x in re.split("[^a-z0-9]+", h) if x for w in cut[x]] + ["p:" + re.sub("[0-9]+", "0", w) for w in re.split("[^a-z0-9]+", p.lower()) if w]

    counts, docs = {"allow": Counter(), "block": Counter()}, {"allow": 1, "block": 1}
    for h, p in map(parts, (r["url"] for r in rows)):
        if v := ruled(h, p)[1]:
            counts[v].update(toks(h, p))
            docs[v] += 1
    distinct = len(set(counts["allow"]) | set(counts["block"]))
    sums = {v: sum(c.values()) + distinct for v, c in counts.items()}
    out = []
    for h, p in map(parts, (r["url"] for r in rows)):
        rule, verdict = ruled(h, p)
        if verdict is None:
            s = math.log(docs["block"] / docs["allow"]) + sum(math.log((counts["block"][t] + 1) / sums["block"]) - math.log((counts["allow"][t] + 1) / sums["allow"]) for t in toks(h, p))
            verdict = None if abs(s) < 1e-6 else "block" if s > 0 else "allow"
        out.append((h, p, rule, verdict))
    return out


LONG = "spam" * 30 + "farm"
PAGES = [(k, f"http://{h}/{p}", f"<title>{t}</title>") for k, (h, p, t) in enumerate(itertools.product(
    ["a.example.com", "www.example.com", "spamfarm.net", "goodnews.org", "spamnews.org", LONG + ".org", "com", "x"], ["en/1", "es/22?q", "fr/a-b/333", ""], ["Spam farm spam", "good News", ""]))]
PAGES += [(None, None, None), (None, "http://É.ORG/Ä/x", "<title>é</title>"), (3, "no scheme", ""), (1000, "http://spamfarm.org/" + "deep/" * 5000, ""), (1000, "http://spamfarm.org/" + "deep/" * 5000, "")]


def test_query_against_a_plain_version(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    for where in (str(tmp_path), "/root/testdata/sf0.001"):
        rows = spark.read.parquet(f"{where}/pages.parquet").collect()
        got = Counter(tuple(r) for r in queries_web.op6_url_filter(spark, where).collect())
        want = Counter((r["page_id"], *j) for r, j in zip(rows, judged(rows)))
        both = {k: n for k, n in want.items() if k[-1] is not None}
        assert sum(got.values()) == len(rows) and all(got[k] == n for k, n in both.items())


def test_segmentation_is_the_best():
    model, floor = {"the": -1.0, "r": -4.0, "her": -2.0, "t": -5.0, "rha": -2.5, "ha": -2.2}, -7.0
    for name in ("therha", "hathe", "xther", "q", "zzthezz", "herherzz", "t" * 9):
        known = [(s, n, model[name[s : s + n]]) for s in range(len(name)) for n in range(1, len(name) - s + 1) if name[s : s + n] in model]
        cuts = [[name[a:b] for a, b in itertools.pairwise((0, *c, len(name)))] for n in range(len(name)) for c in itertools.combinations(range(1, len(name)), n)]
        cost = lambda ws: sum(model.get(w, floor * (1 + len(w))) for w in ws)
        assert abs(cost(urls.segment(name, known, floor)) - max(map(cost, cuts))) < 1e-9


def test_rare_and_long_words_are_counted(spark):
    digits = "translate(cast(id as string), '0123456789', 'abcdefghij')"
    many = spark.range(60_000).select(F.expr(f"concat('q', {digits}, ' q', {digits})").alias("title"))
    long_word = "donau" * 8
    counts = urls.unigrams(many.union(spark.createDataFrame([("zebra",), ("lion",), (long_word,)], "title string")), "title")
    labels = spark.createDataFrame([("zebralion",), (long_word + "lion",), ("zebra",)], "label string")
    assert counts.count() == 60_003
    assert {r["label"]: r["words"] for r in urls.segmented(labels, counts).collect()} == {"zebralion": ["zebra", "lion"], long_word + "lion": [long_word, "lion"], "zebra": ["zebra"]}


def test_kept_columns_may_have_any_name(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/", "mine", 5, 6)], "page_id long, url string, host string, tokens int, _uid int")
    rows = urls.judge(pages, urls.unigrams(pages.limit(0), "url"), keep=["page_id", "host", "tokens", "_uid"]).collect()
    assert [r.asDict() for r in rows] == [{"page_id": 1, "tokens": 5, "_uid": 6, "host": "x.net", "path": "/es/", "rule": "net/es/", "verdict": "block"}]
