"""Nulls, empties, ties, very long texts, empty tables and clashing names, for each operator and stage; models made again apart."""

import base64
import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import brute
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_near_duplicates import similarity_components

import corpus_pipeline
from driftlens.llm import decontaminate, queries_native, queries_pipeline, queries_text, quality, repeats, secrets, sentencepiece as sp, shingles, simhash, tokenize
from driftlens.llm.common import checkpointed, scratch

WORDS = "the house of many people that went to see a river and its old stone bridge".split()
rnd = random.Random(21)
LONG = " ".join(rnd.choice(WORDS) + str(k % 23) for k in range(30_000)) + " x" * 500
GOOD = [" ".join(rnd.choice(WORDS) for _ in range(60)) + "." for _ in range(8)]
TEXTS = [(None, None), (None, "twice"), (1, None), (1, ""), (2, GOOD[0]), (2, GOOD[1]), (3, GOOD[0]), (3, GOOD[0]), (4, LONG), (5, "\n\t  \n"), (None, GOOD[2]), (-7, GOOD[3] + " " + GOOD[4]), (2**62, GOOD[3] + " " + GOOD[4]),
         (8, "key AKIA" + "Q7ZJ" * 5 + " and " + "9fK2xQ7mLp0ZtR4vBn8W" + " password: hunter2hunter2"), (9, "!!! $$$ ### " * 30), (10, "ÉCOLE " * 25)]
CLASHING = "_uid _keep _text _words _at _hash part before spans print packed cell fp label key kept n_words n_hit items rows first own doc id count".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(*r, "en", "s", None) for r in TEXTS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return checkpointed(rows.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)}))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_query_of_sentencepiece_is_the_library(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=queries_text.tokenizer_file("piece_bpe_32k.model"))
    rows = queries_pipeline.op1_sentencepiece(spark, str(tmp_path)).collect()
    assert pairs(rows, "doc_id", "ids", "n_ids", "round_trip") == sorted(((i, lib.encode(t or ""), len(lib.encode(t or "")), True) for i, t in TEXTS), key=repr)


def test_sentencepiece_names_and_empty_tables(docs, empty):
    model = queries_text.tokenizer_file("piece_bpe_32k.model")
    odd = docs.withColumns({"ids": F.lit("mine"), "N_ids": F.lit(1)})
    assert sp.encoded_and_checked(odd, model, ["doc_id", "ids", "N_ids", "cell"]).columns == ["doc_id", "cell", "n_ids", "ids", "round_trip"]
    assert sp.encoded_and_checked(empty, model, ["doc_id"]).isEmpty() and sp.decode(sp.encode(empty, model), model).isEmpty()


def test_token_output_with_ties_and_names(spark, docs, empty):
    path = scratch(spark, "t")
    tokenize.write_tokens(tokenize.encoded(docs, queries_text.tokenizer_file("word_bpe_49k.json"), 2), path)
    rows = tokenize.digests(tokenize.read_tokens(spark, path)).orderBy("start").collect()
    assert len(rows) == len(TEXTS)
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]
    want = Counter((i, *brute.op2([(0, t)], queries_text.tokenizer_file("word_bpe_49k.json"))[0][1:]) for i, t in TEXTS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    none = scratch(spark, "t")
    tokenize.write_tokens(tokenize.encoded(empty, queries_text.tokenizer_file("word_bpe_49k.json"), 2), none)
    assert tokenize.digests(tokenize.read_tokens(spark, none)).isEmpty()


def test_repeats_with_ties_and_names(docs, empty):
    rows = repeats.digests(repeats.without_repeats(docs)).collect()
    assert len(rows) == len(TEXTS)
    # Rows with one id never remove each other's bytes; a null id is larger than any other.
    data = [((2**63 - 1 if i is None else i), (t or "").encode()) for i, t in TEXTS]
    want = []
    for i, b in data:
        smaller = {x[k : k + 50] for j, x in data if j < i for k in range(len(x) - 49)}
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if b[k : k + 50] in smaller:
                gone[k : k + 50] = [True] * 50
        want.append((None if i == 2**63 - 1 else i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), brute.sha(bytes(x for x, g in zip(b, gone) if not g))))
    assert pairs(rows, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert repeats.digests(repeats.without_repeats(empty)).isEmpty()


@pytest.mark.parametrize("one_of_each", [simhash.one_of_each, shingles.one_of_each])
def test_survivors_keep_all_columns(docs, empty, one_of_each):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and one_of_each(empty).columns == docs.columns and one_of_each(empty).isEmpty()
    said = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert max(said.values()) == 1 and (4, LONG) in said and (2, GOOD[0]) in said and (3, GOOD[0]) not in said and (-7, GOOD[3] + " " + GOOD[4]) in said


def test_scan_and_windows_keep_any_column(spark, docs, empty):
    model = secrets.train(docs)
    found = secrets.scan(docs, model, keep=["doc_id", "_uid", "kept", "count"])
    assert found.columns == ["doc_id", "_uid", "kept", "count", "spans"] and found.count() == len(TEXTS) and secrets.scan(empty, secrets.train(empty), keep=["doc_id"]).isEmpty()
    items = spark.createDataFrame([(1, GOOD[0]), (2, None), (3, "")], "item_id long, text string").withColumn("_words", F.lit(1))
    windows = decontaminate.benchmark_windows(items)
    for most in (10**6, 0):
        hits = decontaminate.window_hits(docs, windows, keep=["doc_id", "_at", "_words", "items"], broadcast_windows=most)
        assert hits.columns[:4] == ["doc_id", "_at", "_words", "items"] and hits.count() == len(TEXTS)
        assert sum(r["n_hit"] > 0 for r in hits.select("doc_id", "n_hit").collect()) == 3
        assert decontaminate.window_hits(empty, windows, keep=["doc_id"], broadcast_windows=most).isEmpty()
    assert decontaminate.window_hits(docs, windows.limit(0), keep=["doc_id"]).agg(F.sum("n_hit")).first()[0] == 0


def test_windows_beyond_the_broadcast_move_no_words(spark, docs):
    """What is shuffled for each window of a document is its number, place, length and hash."""
    windows = decontaminate.benchmark_windows(spark.createDataFrame([(1, GOOD[0])], "item_id long, text string"))
    plan = decontaminate.window_hits(docs, windows, keep=["doc_id"], broadcast_windows=0)._jdf.queryExecution().optimizedPlan().toString()
    generated = [x for x in plan.split("\n") if "Generate explode(" in x and "_at" in x]
    assert generated and "xxhash64(slice" in plan


def plain_quality(rows):
    """Counts, votes, fifty rounds of EM over single documents, and posteriors."""
    table = {}
    for k, (_, t) in enumerate(rows):
        t = t or ""
        w, lines = brute.SPACE_WORD.findall(t), [x for x in t.split("\n") if brute.SPACE_WORD.search(x)]
        n, chars, symbols, dups, repeat, failed = brute.op3([(k, t)])[k][0], *brute.op3([(k, t)])[k][1:]
        letters = lambda x: any(unicodedata.category(c)[0] == "L" for c in x)
        upper, bang, odd = sum(unicodedata.category(c) == "Lu" for c in t), t.count("!"), sum(not letters(x) for x in w)
        ended = sum(bool(re.search(r"[.!?…。\"'»”)][\x20\x09-\x0D]*$", x)) for x in lines)
        ratios = [(symbols, n, 0.02, 0.15), (repeat, n, 0.05, 0.2), (dups, len(lines), 0.1, 0.5), (upper, chars, 0.1, 0.35), (bang, n, 0.05, 0.3), (odd, n, 0.1, 0.3), (len(set(w)), n, 0.45, 0.2), (chars, n, 6.5, 9.0), (ended, len(lines), 0.8, 0.3)]
        votes = []
        for top, bottom, good, bad in ratios:
            x = top / bottom if bottom else None
            votes.append(-1 if x is None else 1 if (x <= good if good < bad else x >= good) else 0 if (x >= bad if good < bad else x <= bad) else -1)
        table[k] = votes, failed
    fitted = [v for v, failed in table.values() if not failed]
    prior, good, bad = 0.8, [{1: 0.6, 0: 0.05, -1: 0.35}] * 9, [{1: 0.4, 0: 0.25, -1: 0.35}] * 9

    def p_of(v):
        x = math.log(prior / (1 - prior)) + sum(math.log(good[j][a] / bad[j][a]) for j, a in enumerate(v))
        return 1 / (1 + math.exp(-x))

    for _ in range(50 if fitted else 0):
        ps = [p_of(v) for v in fitted]
        g = [{a: s + sum(p for p, v in zip(ps, fitted) if v[j] == a) for a, s in ((1, 1.0), (0, 0.01), (-1, 0.5))} for j in range(9)]
        b = [{a: s + sum(1 - p for p, v in zip(ps, fitted) if v[j] == a) for a, s in ((1, 0.3), (0, 1.0), (-1, 0.5))} for j in range(9)]
        prior = min(max((sum(ps) + 4) / (len(ps) + 5), 0.05), 0.99)
        good, bad = ([{a: s / sum(d.values()) for a, s in d.items()} for d in side] for side in (g, b))
    return [(not failed and p_of(v) >= 0.5, round(p_of(v), 5)) for v, failed in table.values()]


def test_quality_against_plain_em(spark, tmp_path):
    for rows in (TEXTS, [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]):
        path = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        got = Counter((r["doc_id"], r["n_words"], r["kept"], round(r["p_good"], 5)) for r in queries_native.op3_quality_rules(spark, path).collect())
        assert got == Counter((i, len(brute.SPACE_WORD.findall(t or "")), *q) for (i, t), q in zip(rows, plain_quality(rows)))


def plain_markov(rows):
    """Log-likelihood ratios from all rows' words and the drawn strings."""
    used = [c for c in map(chr, range(128)) if c.isalnum() or c in "+/_=-"]
    ordinary = Counter(p for _, t in rows for w in re.findall("[A-Za-z0-9_-]{3,}", t or "") if not re.search("[0-9]{4,}", w) for p in zip(w, w[1:]))
    drawn: Counter = Counter()
    for k in range(2000):
        digest = hashlib.sha512(str(k).encode()).hexdigest()
        n, base36 = int(digest[:15], 16), ""
        while n:
            n, r = divmod(n, 36)
            base36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[r] + base36
        for s in (digest[:40], base64.b64encode(bytes.fromhex(digest)).decode()[:48], "AKIA" + base36[:16]):
            drawn.update(zip(s, s[1:]))
    logs = []
    for counts in (drawn, ordinary):
        total = {a: sum(counts[a, b] for b in used) + 0.5 * len(used) for a in used}
        logs.append({(a, b): math.log((counts[a, b] + 0.5) / total[a]) for a in used for b in used})
    return {k: logs[0][k] - logs[1][k] for k in logs[0]}


def test_markov_spans_against_a_plain_model(spark, tmp_path):
    extra = [(100 + k, f"see {x} here") for k, x in enumerate(("a" * 25, "thisisalonganddullidentifier_of_words", "Zx9Qw8Er7Ty6Ui5Op4As3Df2", "0123456789" * 3, "path/to/some/ordinary/place/of/files"))]
    rows = [r for r in TEXTS if r[0] != 4] + extra
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ratio = plain_markov(rows)
    want = []
    for i, t in rows:
        spans = [(s, k, e) for k, kind in enumerate(("assign", "access", "hex")) for s, e in base_spans(kind, t or "")]
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or ""):
            if sum(ratio[p] for p in zip(m[0], m[0][1:])) / (len(m[0]) - 1) > 1.0:
                spans.append((m.start(), 3, m.end()))
        want.append((i, ",".join(f"{['assign', 'access', 'hex', 'markov'][k]}:{s}:{e}" for s, k, e in sorted(spans))))
    assert pairs(queries_native.op7_secret_scan(spark, str(tmp_path)).collect(), "doc_id", "spans") == sorted(want, key=repr)
    assert any("markov" in x for _, x in want)


def base_spans(kind, t):
    if kind == "assign":
        found = re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A)
        return [m.span() for m in found if len(m[2]) >= 12]
    pattern, least = ("AKIA[A-Z0-9]+", 18) if kind == "access" else ("[0-9a-f]+", 16)
    return [m.span() for m in re.finditer(pattern, t) if len(m[0]) >= least]


def test_stages_take_any_row(spark, docs, empty):
    """Nulls, repeated ids, very long texts and clashing columns go through each stage; empty tables stay empty."""
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "decontamination":
            sf = scratch(spark, "sf")
            spark.createDataFrame([(1, GOOD[0]), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        else:
            sf = ""
        out, none = stage(spark, docs, sf), stage(spark, empty, sf)
        assert none.isEmpty() and out.count() > 0, name
        assert k == 4 or out.columns == none.columns == docs.columns, name
    assert len(similarity_components(TEXTS)) == len(TEXTS)


def test_groups_of_near_copies_give_few_pairs(spark):
    """A group of near copies gives about as many pairs as copies under a shingle, not their square."""
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(400):
        t = list(base)
        t[k % 200], t[(7 * k) % 200] = f"own{k}", f"too{k}"
        rows.append((k, " ".join(t)))
    texts = shingles._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    distinct = checkpointed(shingles.sets(texts, shingles.common_shingles(texts, 400)).drop("doc_id").dropDuplicates(["fp"]))
    met = shingles.candidates(distinct).where("b is not null").count()
    assert met < 30 * 400 < 400 * 399 / 2
    components = simhash.components(shingles.links(distinct, texts)).select("label").distinct().count()
    assert components == len(set(similarity_components(rows)))
