"""SentencePiece against the library, and the pipeline against brute force stage by stage."""

import random

import brute
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_near_duplicates import similarity_components

import corpus_pipeline
from driftlens.llm.queries_text import tokenizer_file
from driftlens.llm.sentencepiece import Transducer, decode, encode, encoded_and_checked

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(MODEL, "rb") as f:
        return Transducer(f.read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_shortest_paths_are_the_librarys_encodings(both):
    t, lib = both
    rnd = random.Random(3)
    for _ in range(1500):
        x = "".join(rnd.choice("abcdeinrst  \n▁éñßАБ漢字🎉<>|{}0123456789.,\t'\"-_THE") for _ in range(rnd.randint(0, 60)))
        ids = t.encode(x).tolist()
        assert ids == lib.encode(x)
        assert t.decode(ids) == lib.decode(ids) == x.replace("▁", " ")


def test_long_cuts(both):
    t, lib = both
    x = "a" * 5000 + "   " * 300 + "zq" * 2000
    assert t.encode(x).tolist() == lib.encode(x)


def test_columns(spark):
    docs = spark.createDataFrame([(1, "Hello  World\nfoo", 5), (2, None, 6), (2, "", 7), (None, "ß🎉", 8)], "doc_id long, text string, ids int")
    back = decode(encode(docs, MODEL), MODEL, out_col="back").collect()
    assert [r["back"] for r in back] == ["Hello  World\nfoo", "", "", "ß🎉"]
    rows = encoded_and_checked(docs, MODEL, ["doc_id"]).collect()
    assert [r["n_ids"] for r in rows] == [len(r["ids"]) for r in rows] and all(r["round_trip"] for r in rows)


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        assert len(rows) == len({r["doc_id"] for r in rows})
        if k < 4:
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in rows}
        if name == "quality rules":
            assert not [i for i, r in brute.op3(before.items()).items() if r[5] and i in after]
            assert all(after[i] == before[i] for i in after)
        elif name == "near duplicates":
            rows = sorted(before.items())
            assert set(after) == {rows[k][0] for k in similarity_components(rows)}
        elif name == "decontamination":
            assert set(after) == {i for i, r in brute.op10(before.items(), items).items() if not r[4]}
        elif name == "secret scan":
            assert set(after) == set(before)
            assert all(r[:3] == (0, 0, 0) for r in brute.op7(after.items()).values())
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
            assert {r["doc_id"]: r["ids"] for r in rows} == {i: lib.encode(t) for i, t in before.items()}
            assert all(r["round_trip"] for r in rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where(~F.col("round_trip")).isEmpty()
