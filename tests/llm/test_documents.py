"""Operators on documents against brute force, on a table with nulls, copies, ties and long texts."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from driftlens.llm import decontaminate, quality, queries_native, queries_text, repeats, secrets, simhash, tokenize
from driftlens.llm.common import checkpointed, scratch


def texts():
    rnd = random.Random(7)
    words = ["the", "Of", "and", "éau", "la", "tion", "AKIA" + "Q7Z" * 6, "ab12", "x|y", "***", "to", "in"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(6)]
    out = [None, "", " \n\t ", "a", "a a a a a a a a a a a a a a a a a a a a a a", "x\ny\nx\n\nx", "password = 'hunter2hunter2' token: short", "é" * 300]
    out += ["A" * 40, "deadbeef" * 5, "api_key=" + "Zq8" * 9 + " secret token: secret: abcdefghijklmnop"]
    for _ in range(40):
        b = rnd.choice(base)
        out.append(b if rnd.random() < 0.4 else b[rnd.randint(0, 30) :] + rnd.choice(["", "\nnew words here", " " + rnd.choice(base)]))
    out.append(" ".join(rnd.choice(words) + str(k % 17) for k in range(20_000)))
    return list(enumerate(out))


ITEMS = [(1, "la the of"), (10, " ".join(f"w{k}" for k in range(20))), (2, None), (3, ""), (4, "the"), (5, "the and éau la tion to in the of and la to in ab12"), (6, "THE")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", None, None) for i, t in texts()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def by_id(df, n):
    rows = df.collect()
    out = {r[0]: tuple(r[1 : 1 + n]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_token_output(spark, sf):
    path = queries_text.tokenizer_file("word_bpe_49k.json")
    assert by_id(queries_text.op2_token_output(spark, sf), 3) == brute.op2(texts(), path)


def test_token_files_are_selective(spark, sf):
    path = scratch(spark, "t")
    tokens = tokenize.encoded(spark.read.parquet(f"{sf}/documents.parquet"), queries_text.tokenizer_file("word_bpe_49k.json"), 2)
    tokenize.write_tokens(tokens, path, encoding="delta")
    some = tokenize.read_tokens(spark, path, 10, 12, ["doc_id", "ids"])
    assert sorted(r["doc_id"] for r in some.collect()) == [10, 11, 12]
    assert "GreaterThanOrEqual(doc_id,10)" in some._jdf.queryExecution().toString()


def test_quality_counts(spark, sf):
    want = brute.op3(texts())
    got = by_id(queries_native.op3_quality_rules(spark, sf), 7)
    assert {i: g[:6] for i, g in got.items()} == want
    assert not any(g[5] and g[6] for g in got.values())


def test_quality_model_matches_python(spark, sf):
    scored = checkpointed(quality.features(spark.read.parquet(f"{sf}/documents.parquet"), keep=["doc_id"]))
    model = quality.fit(scored)
    for r in quality.judged(scored, model).collect():
        p = quality.posterior(tuple(r[f"v_{k}"] for k in quality.RULES), model)
        assert abs(p - r["p_good"]) < 1e-9 and r["kept"] == (not r["base_failed"] and p >= 0.5)


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = checkpointed(quality.features(docs, keep=["doc_id"]))
    rows = quality.judged(scored, quality.fit(scored)).select(F.col("_keep.doc_id").alias("doc_id"), "base_failed", "kept")
    found = rows.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_good_documents_keep_columns_and_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(3))
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in queries_native.op3_quality_rules(spark, sf).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_repeat_removal(spark, sf):
    assert by_id(queries_text.op4_repeat_removal(spark, sf), 4) == brute.op4(texts())


def test_simhash(spark, sf):
    assert by_id(queries_text.op5_simhash(spark, sf), 2) == brute.op5(texts())


def test_simhash_links_of_random_fingerprints(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for f in list(fps):
        for _ in range(3):
            g = f
            for _ in range(rnd.randint(1, 5)):
                g ^= 1 << rnd.randrange(64)
            fps.add(g)
    ids = {f: k for k, f in enumerate(sorted(fps))}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    both = sorted(fps)
    for k, a in enumerate(both):
        for b in both[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {ids[f]: ids[find(f)] for f in fps}
    rows = spark.createDataFrame([(k, f - 2**64 if f >= 2**63 else f) for f, k in ids.items()], "doc_id long, fp long")
    assert {r["doc_id"]: r["component_id"] for r in simhash.with_components(rows).collect()} == want
    # Blocks of a crowded cell lose no link.
    edges = simhash.links(rows.select("fp"), 3, block=8).collect()
    root = {f: f for f in fps}
    for e in edges:
        a, b = (x % 2**64 for x in (e["a"], e["b"]))
        assert (a ^ b).bit_count() <= 3
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {ids[f]: ids[find(f)] for f in fps} == want


def test_one_of_each(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = simhash.one_of_each(docs)
    want = {c for _, c in brute.op5(texts()).values()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and kept.columns == docs.columns
    twice = simhash.one_of_each(docs.union(docs))
    assert sorted(r["doc_id"] for r in twice.collect()) == sorted(want)


def test_secret_scan(spark, sf):
    assert by_id(queries_native.op7_secret_scan(spark, sf), 4) == brute.op7(texts())


def test_secret_model_tells_random_from_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.train(docs)
    rnd = random.Random(3)
    random_strings = ["".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24)) for _ in range(200)]
    words = [r["w"] for r in docs.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{14,}"), 0)).alias("w")).distinct().limit(200).collect()]
    rows = spark.createDataFrame([(t, 1) for t in random_strings] + [(w, 0) for w in words], "t string, label int")
    n = {(r["label"], r["hit"]): r["count"] for r in rows.select("label", (secrets.llr(F.col("t"), model) > 1.0).alias("hit")).groupBy("label", "hit").count().collect()}
    assert n.get((1, False), 0) <= 10 and n.get((0, True), 0) <= 2


def test_redaction(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = secrets.train(docs)
    before = dict(texts())
    after = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).collect()}
    assert len(after) == len(before) and after[0] is None and after[6] == "[SECRET]' token: short"
    left = secrets.scan(secrets.redact(docs, model), model, keep=["doc_id"]).where(F.size("spans") > 0)
    assert left.isEmpty()
    clean = {i for i, s in brute.op7(texts()).items() if s[:3] == (0, 0, 0)}
    assert all(after[i] == before[i] for i in clean if "[SECRET]" not in (after[i] or ""))


def test_decontamination(spark, sf):
    assert by_id(queries_native.op10_decontaminate(spark, sf), 5) == brute.op10(texts(), ITEMS)


def test_decontamination_without_broadcast(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    w = decontaminate.benchmark_windows(spark.read.parquet(f"{sf}/benchmark.parquet"))
    a = decontaminate.window_hits(docs, w, keep=["doc_id"]).select("doc_id", "n_words", "n_hit", F.array_sort("items").alias("items"))
    b = decontaminate.window_hits(docs, w, keep=["doc_id"], broadcast_windows=0).select("doc_id", "n_words", "n_hit", F.array_sort("items").alias("items"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_hit", F.lit("clash")).withColumn("_words", F.lit(1))
    kept = decontaminate.clean_documents(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    want = {i for i, r in brute.op10(texts(), ITEMS).items() if not r[4]}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns


def test_empty_and_null_tables(spark, tmp_path):
    for name, rows in (("empty", []), ("nulls", [(None, None), (None, None), (1, None)])):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        for f in (*queries_text.QUERIES.values(), *queries_native.QUERIES.values()):
            assert f(spark, path).count() == len(rows), f
        docs = spark.read.parquet(f"{path}/documents.parquet")
        assert repeats.without_repeats(docs).count() == len(rows)
        assert quality.good_documents(docs).count() == 0
        assert simhash.one_of_each(docs).count() == (1 if rows else 0)
