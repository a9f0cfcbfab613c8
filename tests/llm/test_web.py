"""Operators on pages against brute force."""

import base64
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from driftlens.llm import html_text, queries_web, warc
from driftlens.llm.common import scratch

PAGES = [
    (0, "https://www.a.example.com/en/1?x#y", "<p>one</p>"),
    (1, "http://B.Example.NET/fr/2.html", "<p>one</p>"),
    (2, None, None),
    (3, "no scheme", ""),
    (4, "https://net", "<p>one</p>"),
    (5, "https://therha.example.org/de/3/", "WARC/1.1\r\n\r\n\r\n<p>é&amp;</p>\r\n\r\n"),
    (6, "https://www.example.com/en/", "x" * 300_000),
    (7, "https://user@example.com:80?q", ""),
    (8, "https://spam-farm.example.org/en/9#top", "<article><p>a</p></article>"),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2).write.parquet(f"{path}/pages.parquet")
    return path


def test_warc_round_trip(spark, sf):
    for where in (sf, "/root/testdata/sf0.001"):
        rows = spark.read.parquet(f"{where}/pages.parquet").collect()
        last = {}
        for r in rows:
            b = (r["html"] or "").encode()
            last[b] = max(last.get(b, -1), r["page_id"])
        got = {r["page_id"]: tuple(r)[1:] for r in queries_web.op8_warc(spark, where).collect()}
        assert len(got) == len(rows)
        for r in rows:
            b = (r["html"] or "").encode()
            first = last[b] == r["page_id"]
            assert got[r["page_id"]] == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else last[b])


def test_warc_captures_are_whole(spark, sf):
    path = scratch(spark, "warc")
    warc.write(spark.read.parquet(f"{sf}/pages.parquet"), path)
    rows = warc.captures(warc.read(spark, path)).collect()
    assert len(rows) == len(PAGES) and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in rows)
    payloads = {bytes(r["answer"]["payload"]) for r in rows if r["answer"]["type"] == "response"}
    assert payloads == {(h or "").encode() for _, _, h in PAGES}


def test_warc_members_one_by_one(spark, tmp_path):
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 21\r\n\r\nH\r\n\r\n\xff body\r\n\r\nmore\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one.replace(b"<a>", b"<b>")))
    (tmp_path / "b.warc").write_bytes(one.replace(b"<a>", b"<c>"))
    found = warc.read(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [(r["record_id"], bytes(r["payload"])) for r in found] == [(k, b"\xff body\r\n\r\nmore\r\n") for k in ("<a>", "<b>", "<c>")]
    (tmp_path / "c.warc").write_bytes(one[:-12])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, str(tmp_path)).collect()


def test_warc_repeated_and_null_ids(spark):
    rows = [(None, "u", "x"), (None, "v", "x"), (None, "w", "y"), (5, "u", "y"), (5, "u", "y"), (5, "u", "z"), (4, "t", "y"), (6, None, None), (7, "", "\r\n\r\nWARC/1.1\r\n\r\n")]
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, largest int").repartition(2), path)
    found = warc.captures(warc.read(spark, path)).collect()
    assert len(found) == len({r["capture"] for r in found}) == len(rows) and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in found)
    said = sorted((r["answer"]["record_id"].split(":")[2], r["answer"]["type"], bytes(r["answer"]["payload"] or b"")) for r in found)
    y = [("5", "response", b"y")] * 2 + [("5", "response", b"z")]
    assert said == sorted([("null", "response", b"x")] * 2 + [("null", "revisit", b""), ("4", "revisit", b""), *y, ("6", "response", b""), ("7", "response", b"\r\n\r\nWARC/1.1\r\n\r\n")])
    records = {r["capture"] for r in found}
    assert all(r["answer"]["refers_to"] in records for r in found if r["answer"]["type"] == "revisit")


def test_empty_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    for f in queries_web.QUERIES.values():
        assert f(spark, path).count() == 0


def test_html_text(spark):
    odds = html_text.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    page = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice"><p>We use cookies.</p></div><header><a href=x>Home</a></header>
    <div id=sidebar><ul><li><a>Link</a></li></ul></div><div class=post><h1>Title &amp; more</h1><p>First   paragraph with some long text that goes on, and on. It ends.</p>
    <p>Second paragraph, it also has many words in it, so that it looks like content. Yes.</p><form><label>Name</label></form></div>
    <section class="comments"><p>I am a reader and I have an opinion.</p></section><footer>&copy; me</footer><script>var a = "<p>no</p>";</script></body></html>"""
    assert html_text.main_text(page, odds).split("\n") == ["Title & more", "First paragraph with some long text that goes on, and on. It ends.", "Second paragraph, it also has many words in it, so that it looks like content. Yes."]
    assert html_text.main_text(None, odds) == "" and html_text.main_text("<<<a '\"", odds) is not None


def test_html_query(spark, sf):
    rows = queries_web.op9_html_text(spark, sf).collect()
    assert len(rows) == len(PAGES) and all(r["n_chars"] == len(r["text"]) for r in rows)
    text = {r["page_id"]: r["text"] for r in rows}
    assert text[2] == "" and text[8] == "a"


def test_min_cut_is_minimal():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 7)
        w = [rnd.uniform(-2, 2) for _ in range(n)]
        e = [(i, j, rnd.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
        cost = lambda s: sum(max(-x, 0) if q else max(x, 0) for x, q in zip(w, s)) + sum(c for i, j, c in e if s[i] != s[j])  # noqa: B023, E731
        assert abs(cost(html_text.min_cut(w, e)) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-6


def test_extra_columns(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("payload", F.lit(1)).withColumn("same", F.lit(2)).withColumn("verdict_", F.lit(3))
    assert warc.with_roles(pages).count() == len(PAGES)
    assert html_text.extract(pages, {}).columns[-1] == "text"
