"""Four-Russians scores against products, and hard negatives against a plain search."""

import math
import random

import numpy as np
import pytest

from driftlens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, q int, block int"


@pytest.mark.parametrize("top", [1, 2, 150, 2**20, 2**31])
def test_scores_are_inner_products(top):
    rng = np.random.default_rng(top)
    for d in (1, 7, 8, 9, 64):
        a, c = rng.integers(-top, top, (5, d)), rng.integers(-top, top, (9, d))
        for _, _, s in negatives._tiles(a, c):
            assert (s == a @ c.T).all()


def test_widest_numbers_wrap_like_products():
    a, c = np.array([[-(2**63), 3], [2**63 - 1, -1], [1, 0]]), np.array([[1, 2], [-1, -1], [2**63 - 1, 5], [-(2**63), 0]])
    with np.errstate(over="ignore"):
        for _, _, s in negatives._tiles(a, c):
            assert (s == a @ c.T).all()


def plain(rows):
    known = []
    for k, (i, v, label, *_) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.append((k, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for k, i, label, q in known:
        if i % 100:
            continue
        score = [(sum(x * y for x, y in zip(q, r[3])), r) for r in known if r[0] != k]
        order = sorted(score, key=lambda x: (-x[0], x[1][1]))
        for ps, p in [x for x in order if x[1][2] == label][:5]:
            fit = [(s, r) for s, r in order if r[2] != label and 30 * ps <= 100 * s <= 90 * ps][:10]
            out += [(i, p[1], n, r[1], ps, s) for n, (s, r) in enumerate(fit, 1)]
    return sorted(out)


def rows(n=400):
    rnd = random.Random(3)
    vec = lambda: [rnd.gauss(0, 0.2) for _ in range(rnd.choice([16, 16, 16, 13, 0]))]
    hot = [0.25] * 16
    out = [(i, hot if rnd.random() < 0.35 else vec(), rnd.choice([0, 1, 1, 2])) for i in range(n)]
    out += [(100, out[100][1], 1), (100, vec(), 1), (-700, vec(), 1), (None, hot, 1), (800, None, 1), (801, hot, None), (900, [0.1, None], 1), (901, [0.1, float("nan")], 1), (1000, [0.1, float("inf")], 1), (1100, [], 3)]
    return [(*r, "x", 1, 2) for r in out]


@pytest.mark.parametrize(("block", "part"), [(2, 50), (1024, 1 << 17)])
def test_hard_negatives_are_those_of_a_plain_search(spark, block, part):
    found = negatives.mine(spark.createDataFrame(rows(), SCHEMA).repartition(3), block=block, part=part)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows())
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_empty_table(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).isEmpty()
