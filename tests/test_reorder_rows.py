"""Proofs of reordering are made row by row, whatever the lines of the newer side look like."""

import random

from driftlens.operators import classify, edits

BLOCKS = "rel string, old array<string>, new array<string>"


def test_nothing_is_shuffled_or_stored(spark, tmp_path):
    blocks = spark.createDataFrame([("a", ["x = 1;", "y = 2;"], ["y = 2;", "x = 1;"]), ("a", ["x = 1;", "y = x;"], ["y = x;", "x = 1;"]), ("b", None, None)], BLOCKS)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    got = edits.reordered(blocks)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [tuple(r) for r in got.collect()] == [("a", True), ("a", False), ("b", False)]


def test_lines_that_only_the_newer_side_has(spark):
    """Generated names and white space may differ in a line that says the same; what it writes and reads may not."""
    rnd, rows = random.Random(3), []
    texts = ["p = q;", "p  = q;", "q = p;", "r = rtb_Sum_a1 + p;", "r = rtb_Sum_k2 + p;", "rtb_Sum_a1 = s;", "rtb_Sum_k2 = s;", "t = rtb_A_b1 + rtb_A_c2;", "t = rtb_A_c2 + rtb_A_b1;", "u = sum_ab12cd34_x;", "v = 'a' + \"b\";", "w = 3.5e1;", " p = q;"]
    for k in range(600):
        old = rnd.sample(texts, rnd.randint(2, 6))
        new = rnd.sample(old, len(old))
        if k % 2:
            new[0] = rnd.choice([*texts, f"  {new[0]}  "])
        rows.append((str(k), old, new))
    rows.append(("swap", ["t = rtb_A_b1 + rtb_A_c2;", "w = 1;"], ["w = 1;", "t = rtb_A_c2 + rtb_A_b1;"]))
    got = {r["rel"]: r["proven"] for r in edits.reordered(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got == {rel: classify.rescheduled(old, new) for rel, old, new in rows}
    assert got["swap"] and 20 < sum(got.values()) < 500
