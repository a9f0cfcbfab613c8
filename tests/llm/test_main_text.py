"""Main text of pages whose article is known: shapes that sites use, and the given pages."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from driftlens.llm import html_text, queries_web

PARAGRAPHS = ["First paragraph with some long text that goes on, and on. It ends.", "Second paragraph, it also has many words in it, so that it looks like content. Yes.", "A third one; short enough, but a sentence."]
BODY = "<h1>Title &amp; more</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n".join(["Title & more", *PARAGRAPHS])
NAV, FOOT = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>", "<footer><p>&copy; someone</p></footer>"
LONG = "".join(f"<div class=comment><p>I am reader {k} and I have an opinion, which I write down here at some length. Really.</p></div>" for k in range(40))

SHAPES = {
    "article": f"<body>{NAV}<article>{BODY}</article>{FOOT}</body>",
    "body classes": f"<html><body class='single right-sidebar comments-open'>{NAV}<article>{BODY}</article>{FOOT}</body></html>",
    "page form": f"<body><form id=aspnetForm>{NAV}<article>{BODY}</article>{FOOT}</form></body>",
    "form alone": f"<form><article>{BODY}</article></form>",
    "wrapper": f"<body><div class='content-sidebar-wrap'><main>{BODY}</main><div class=sidebar><p>About me, a short text.</p></div></div>{FOOT}</body>",
    "article header": f"<body><header><a href=x>Site</a></header><article><header><h1>Title &amp; more</h1></header>{BODY.split('</h1>')[1]}<footer>Filed under things.</footer></article></body>",
    "teasers": f"<body><article>{BODY}</article><aside class=related><article><h2>Other</h2><p>Another text, which is told in short. Read it.</p></article></aside></body>",
    "long comments": f"<body>{NAV}<article>{BODY}</article><section class=comments>{LONG}</section>{FOOT}</body>",
    "comments as articles": f"<body><main><article>{BODY}</article><ol class=comment-list><li><article class=comment-body><p>I am a reader, and I think that this text is wrong.</p></article></li></ol></main></body>",
    "advert inside": f"<body><article><h1>Title &amp; more</h1><p>{PARAGRAPHS[0]}</p><div class='ad-slot ad'><p>Buy this, it is a good thing to have, they say.</p></div><p>{PARAGRAPHS[1]}</p><p>{PARAGRAPHS[2]}</p></article></body>",
    "plain divs": f"<body><div class='nav menu'><a href=a>Home</a> <a href=b>News</a></div><div class=cookie-notice><p>We use cookies to make this site better.</p></div><div class='site header-fixed'><div class=post>{BODY}</div></div><div id=footer>&copy; someone</div></body>",
}


ALERT = f"<body>{NAV}<article><h1>Title &amp; more</h1><p>{PARAGRAPHS[0]}</p><div class=alert><p>Since then closed</p></div><p>{PARAGRAPHS[1]}</p><p>{PARAGRAPHS[2]}</p></article>{FOOT}</body>"
UNSURE_NAMES = {
    "search result": (f"<main><article class='post search-result'>{BODY}</article></main>", WANT),
    "share price": (f"<body>{NAV}<main><h1>Title &amp; more</h1><section id=share-price><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p></section><p>{PARAGRAPHS[2]}</p></main>{FOOT}</body>", WANT),
    "entry header": (f"<body>{NAV}<article><header class=entry-header><h1>Title &amp; more</h1></header>{BODY.split('</h1>')[1]}</article>{FOOT}</body>", WANT),
    "alert": (ALERT, WANT.replace("\nSecond", "\nSince then closed\nSecond")),
    "discussion": (f"<body>{NAV}<main>{BODY}<section id=discussion>{LONG.replace('class=comment', '')}</section></main>{FOOT}</body>", WANT),
}


@pytest.mark.parametrize("shape", UNSURE_NAMES)
def test_names_that_articles_have_too(odds, shape):
    page, want = UNSURE_NAMES[shape]
    assert html_text.main_text(page, odds) == want


def test_neighbours_turn_blocks(odds):
    """A heading, which by itself looks like boilerplate, stays among paragraphs of an unmarked page and goes among menus: the cut tells."""
    heading = "<h4>Since then closed</h4>"
    kept = f"<body>{NAV}<div><p>{PARAGRAPHS[0]}</p>{heading}<p>{PARAGRAPHS[1]}</p></div>{FOOT}</body>"
    found = html_text.blocks(kept)
    weights, edges = html_text.graph(found, odds)
    own = next(i for i, b in enumerate(found) if b.text == "Since then closed")
    assert weights[own] < 0 and html_text.min_cut(weights, edges)[own]
    assert html_text.main_text(kept, odds) == f"{PARAGRAPHS[0]}\nSince then closed\n{PARAGRAPHS[1]}"
    assert html_text.main_text(f"<body>{NAV}{heading}{NAV}<div>{BODY}</div></body>", odds) == WANT


def test_given_pages_without_their_article_element(spark, odds):
    """With the element that marks the article taken out, classifier and neighbours must find it."""
    hit = said = want = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r["html"] or "")
        words = html_text.html.unescape(re.sub(r"<[^>]*>", " ", inner[1])).split() if inner else []
        got = html_text.main_text(re.sub(r"</?article>", "", r["html"] or ""), odds).split()
        hit, said, want = hit + (len(words) if got == words else len(set(got) & set(words))), said + len(got), want + len(words)
    assert hit >= 0.98 * want and hit >= 0.98 * said


@pytest.fixture(scope="module")
def odds(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(odds, shape):
    assert html_text.main_text(SHAPES[shape], odds) == WANT


def test_given_pages(spark):
    """The given pages hold one article each. Recall and precision of its words, and of whole texts."""
    rows = queries_web.op9_html_text(spark, "/root/testdata/sf0.01").select("page_id", "text").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    same = hit = said = want = 0
    for r in rows:
        inner = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]] or "")
        words = re.sub(r"<[^>]*>", " ", inner[1]).split() if inner else []
        words = [html_text.html.unescape(w) for w in words]
        got = r["text"].split()
        same, said, want = same + (got == words), said + len(got), want + len(words)
        hit += len(words) if got == words else len(set(got) & set(words))
    assert same >= 0.98 * len(rows) and hit >= 0.99 * want and hit >= 0.99 * said


def test_very_long_pages(odds):
    began = time.perf_counter()
    page = "<body>" + "<div>" * 3 + "".join(f"<div><span>word {k}</span></div>" for k in range(100_000))
    assert html_text.main_text(page, odds) is not None
    assert time.perf_counter() - began < 30


def test_undecided_chains_are_cut_fast():
    rnd = random.Random(2)
    n = 100_000
    weights = [rnd.uniform(-1, 1) for _ in range(n)]
    edges = [(i - 1, i, 0.6) for i in range(1, n)] + [(i - 2, i, 0.8) for i in range(2, n, 2)]
    began = time.perf_counter()
    html_text.min_cut(weights, edges)
    assert time.perf_counter() - began < 20


def test_nested_graphs_are_cut_at_least_cost():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randint(1, 9)
        w = [rnd.choice([rnd.uniform(-2, 2), 0.0]) for _ in range(n)]
        parents, last, e = [rnd.randint(0, 2) for _ in range(n)], {}, []
        for i in range(n):
            e += [(i - 1, i, 0.6)] if i else []
            e += [(last[parents[i]], i, 0.8)] if parents[i] in last else []
            last[parents[i]] = i
        cost = lambda s: sum(max(-x, 0) if q else max(x, 0) for x, q in zip(w, s)) + sum(c for i, j, c in e if s[i] != s[j])  # noqa: B023, E731
        assert abs(cost(html_text.min_cut(w, e)) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-6


def test_a_text_column_gives_way(spark):
    pages = spark.createDataFrame([(1, "mine", "<article><p>theirs</p></article>"), (None, None, None)], "page_id long, text string, html string").withColumn("zone", F.lit(1))
    rows = html_text.extract(pages, {}).collect()
    assert {(r["page_id"], r["text"], r["zone"]) for r in rows} == {(1, "theirs", 1), (None, "", 1)}
