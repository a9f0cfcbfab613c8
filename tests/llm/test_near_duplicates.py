"""The pipeline's near-duplicates against brute-force similarity."""

import random

from test_survivors import check_rows

import corpus_pipeline
from driftlens.llm import shingles, simhash


def similarity_components(rows):
    """{row number: least row number that links of similarity 0.8 lead to}, over plain sets of five words."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def edited_texts():
    """Texts with copies edited more and more, around 0.8, and a passage that many share."""
    rnd = random.Random(11)
    words, shared = [f"w{k}" for k in range(400)], " ".join(f"same{k}" for k in range(12))
    out = [None, "", "a", "A", "one two three four", "one two three four five"]
    for n in (6, 9, 14, 30, 80, 300, 900):
        for _ in range(4):
            base = [rnd.choice(words) for _ in range(n)]
            for edits in (0, 1, 2, n // 60, n // 45, n // 40, n // 20):
                t = list(base)
                for _ in range(edits):
                    t[rnd.randrange(len(t))] = "new" + str(rnd.randrange(1000))
                out.append(" ".join(t) + ("" if n < 80 else " " + shared))
    rnd.shuffle(out)
    return list(enumerate(out))


def test_stage_links_all_pairs_of_similarity(spark):
    rows = edited_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(similarity_components(rows))) and kept.columns == docs.columns


def test_blocks_lose_no_link(spark):
    rows = edited_texts()
    texts = shingles._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    none = shingles.common_shingles(texts.limit(0), 1)
    distinct = shingles.checkpointed(shingles.sets(texts, none).drop("doc_id").dropDuplicates(["fp"]))
    n = {block: {(r["node"], r["label"]) for r in simhash.components(shingles.links(distinct, texts, block)).collect()} for block in (4096, 16)}
    assert n[4096] == n[16] and n[16]


def test_unlike_texts_under_one_id_stay_in_the_stage(spark):
    check_rows(spark, shingles.one_of_each)


def test_manhattan_distance_is_a_lower_bound():
    import numpy as np

    rnd = random.Random(6)
    a = np.array([rnd.getrandbits(64) for _ in range(2000)], np.uint64)
    b = np.array([int(x) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 6))) & (2**64 - 1) for x in a], np.uint64)
    counts = lambda x: [(int(x) >> k & 3).bit_count() for k in range(0, 64, 2)]
    want = [sum(abs(p - q) for p, q in zip(counts(x), counts(y))) for x, y in zip(a, b)]
    assert simhash.manhattan(a, b).tolist() == want
    assert all(w <= (int(x) ^ int(y)).bit_count() for w, x, y in zip(want, a, b))


def test_grid_meets_all_at_the_distance(spark):
    rnd = random.Random(8)
    pairs = []
    for _ in range(300):
        f = rnd.getrandbits(64)
        pairs.append((f, f ^ sum(1 << k for k in rnd.sample(range(64), 3))))
    signed = [x - 2**64 if x >= 2**63 else x for p in pairs for x in p]
    found = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert all((a, b) in found or (b, a) in found for a, b in pairs)


def test_bits_that_are_too_large_to_broadcast_travel_along(spark, monkeypatch):
    from driftlens.llm import shingles as module

    rows = edited_texts()
    texts = shingles._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    distinct = shingles.checkpointed(shingles.sets(texts, shingles.common_shingles(texts.limit(0), 1)).drop("doc_id").dropDuplicates(["fp"]))
    labelled = shingles.checkpointed(distinct.withColumn("label", simhash.F.col("fp")))
    want = {tuple(r) for r in shingles.candidates(labelled).collect()}
    monkeypatch.setattr(module, "small", lambda table: table)
    assert {tuple(r) for r in shingles.candidates(labelled).collect()} == want and want


def dense_cell(sets, columns):
    """A batch of one cell of sets that all may be similar and have labels of their own."""
    import numpy as np
    import pyarrow as pa

    own = np.arange(sets)
    cells = pa.array([[5, 6, 7]] * sets, pa.list_(pa.int64()))
    held = {"cell": np.full(sets, 5), "role": np.zeros(sets, np.int32), "fp": own, "n": np.full(sets, 100), "label": own, "parity": pa.array([bytes(32)] * sets), "homes": cells, "cells": cells}
    return pa.RecordBatch.from_pydict({c: held[c] for c in columns})


def peak_mb(run):
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_pairs_of_a_dense_cell_are_not_held_at_once():
    names = ["cell", "role", "fp", "n", "label", "parity"]
    one = dense_cell(3000, names)
    found, mb = peak_mb(lambda: sum(b.num_rows for b in shingles._in_pairs(iter([one]))))
    assert found == 3000 and mb < 16
    all_of_it = dense_cell(1500, [*names, "homes", "cells"])
    found, mb = peak_mb(lambda: sum(b.num_rows for b in shingles._met_pairs(iter([all_of_it]))))
    assert found == 1500 * 1499 // 2 and mb < 32


def test_tasks_let_go_of_what_the_tokens_stage_left():
    from driftlens.llm import sentencepiece

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    with open(corpus_pipeline.tokenizer_file(corpus_pipeline.PIECES), "rb") as f:
        sentencepiece.transducer(f.read())
    assert sentencepiece._compiled
    assert list(shingles.sets(Frame(), (shingles.np.empty(0, "u8"), shingles.np.empty(0, "i8")))(iter([]))) == []
    assert not sentencepiece._compiled
