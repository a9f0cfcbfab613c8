"""The network's gradients against differences, its fast steps against its slow ones, and scores of texts held out."""

import random
import zlib

import numpy as np
import pytest

from driftlens.llm import toxicity as tox


def small_model(kind=np.float64):
    vocabulary = ["the", "idiot", "of"]
    chars = np.array(sorted(map(ord, "theidofabcé")), np.uint32)
    params = {k: v.astype(kind) for k, v in tox.new_params(3, len(chars)).items()}
    rng = np.random.default_rng(4)
    params["words"] = rng.standard_normal(params["words"].shape).astype(kind) * 0.3
    params["words"][0] = 0
    return tox.Model(params, vocabulary, chars)


WINDOWS = [["the", "idiot", "of", "abcé"], [], ["the"] * tox.WINDOW, ["zzz", "of", "fab" * 8]]


def test_gradients_are_differences():
    model, labels = small_model(), np.array([1.0, 0, 0, 1])
    _, g = model.gradients(WINDOWS, labels)
    rng = np.random.default_rng(0)
    for name, v in model.params.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if name == "words" and at[0] == 0:
                continue
            old, e = v[at], 1e-5
            v[at] = old + e
            up = model.gradients(WINDOWS, labels)[0]
            v[at] = old - e
            down = model.gradients(WINDOWS, labels)[0]
            v[at] = old
            assert abs((up - down) / (2 * e) - g[name][at]) < 1e-6, name


def test_fast_steps_are_the_slow_ones():
    model = small_model(np.float32)
    fast, _ = model.best_windows([[w] for w in WINDOWS])
    slow = []
    for w in WINDOWS:
        loss = model.gradients([w], np.zeros(1))[0]  # log(1 + e^x)
        slow.append(np.log(np.expm1(loss)))
    assert np.allclose(fast, slow, atol=1e-4)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 100, 1000):
        s = tox.starts(n)
        assert {i for k in s for i in range(k, min(k + tox.WINDOW, n))} == set(range(n)) and all(k + tox.WINDOW <= n for k in s if n >= tox.WINDOW)
        assert (np.diff(s) <= tox.WINDOW // 2).all()
    assert tox.words("A_b é1 " + "x" * 60) == ["a", "b", "é1"] + ["x" * 24] * 4


def test_a_score_is_that_of_the_highest_window():
    model = small_model(np.float32)
    rnd = random.Random(2)
    texts = ["", "!!! ---", "idiot", "The idiot of"] + [" ".join(rnd.choice(["the", "of", "idiot", "abc", "fé", "zz"]) for _ in range(rnd.randint(1, 400))) for _ in range(30)]
    got = tox.Scorer(model)(texts)
    most = [model.best_windows([[w[i : i + tox.WINDOW] for i in tox.starts(len(w))]])[0][0] for w in map(tox.words, texts)]
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(most))), atol=1e-5)


def made(n=900):
    """Texts of made-up words; toxic ones have rude words, or words with a rude beginning, in one place."""
    rnd, rows, labels = random.Random(9), [], []
    parts = ["an", "er", "lo", "mi", "ta", "ré", "so", "ku"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    for i in range(n):
        w, bad = [word() for _ in range(rnd.choice([3, 20, 90, 300]))], rnd.random() < 0.3
        for _ in range(3 if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "Clown!", "vequ" + word()]))
        rows.append((i, " ".join(w), "en"))
        if i % 6:
            labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = made()
    docs = spark.createDataFrame([*rows, (None, None, "x"), (None, rows[3][1], "x"), (3, rows[3][1], "x"), (5000, "", "x"), (5001, "idiot " * 40_000, "x")], "doc_id long, text string, lang string")
    more = [(None, 1, 1), (77_777, 1, 1), (4, 1, None)]
    return docs.repartition(3), spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int"), rows, labels


def test_toxic_texts_are_told_from_others(spark, tables):
    docs, labels, rows, given = tables
    model = tox.train(docs, labels)
    found = tox.scored(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    truth = {i: t for i, _, t in given}
    by_id = {r["doc_id"]: r for r in found}
    out = [by_id[i] for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r in out) and not any(r["held_out"] for r in found if r["doc_id"] is None)
    right = [r["predicted"] == truth[r["doc_id"]] for r in out]
    assert len(right) > 100 and sum(right) / len(right) > 0.95
    assert len({r["score"] for r in found if r["doc_id"] == 3}) == 1 and by_id[5001]["predicted"] == 1


def test_labels_of_one_kind_and_empty_tables(spark, tables):
    docs, labels, _, _ = tables
    assert tox.train(docs, labels.where("toxic = 0")) == 0.0 and tox.train(docs, labels.limit(0)) == 0.5 and tox.train(docs.limit(0), labels) == 0.5
    assert {r["score"] for r in tox.scored(docs, 0.5).collect()} == {0.5}
    assert tox.scored(docs.limit(0), 0.5).isEmpty()


def test_held_out_labels_are_not_in_the_sample(spark, tables):
    docs, labels, _, given = tables
    used = {r["doc_id"] for r in tox.sample(docs, labels).collect()}
    assert used == {i for i, _, _ in given if zlib.crc32(str(i).encode()) % 5}
