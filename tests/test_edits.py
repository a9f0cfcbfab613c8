"""Renames, reordered statements and moved blocks as relations, against those found file by file."""

import random

from driftlens.operators import classify, edits, linediff

LINES = ["rtb_Sum_a1 = p;", "rtb_Sum_k2 = p;", "x = rtb_Sum_a1 + q;", "x = rtb_Sum_k2 + q;", "tmp_1 = x;", "LIMIT = 3;", "Rte_Read_A_b = x;", "y = old_name;", "y = new_name;", "", "}", "f(x);"]


def files(n, rnd):
    out = []
    for k in range(n):
        a = [rnd.choice(LINES) for _ in range(rnd.randint(1, 14))]
        b = list(a)
        if rnd.random() < 0.6:
            p, q = rnd.choice([("old_name", "fresh"), ("rtb_Sum_a1", "rtb_Sum_z9"), ("LIMIT", "LIMITS"), ("x", "y"), ("sum_ab12cd34_x", "sum_ef56ab78_x")])
            b = [x.replace(p, q) for x in b]
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(b) + 1)
            if rnd.random() < 0.5 and len(b) > 4:
                block = b[:3]
                del b[:3]
                b[i:i] = block
            else:
                b[i : i + rnd.randint(0, 2)] = [rnd.choice(LINES) for _ in range(rnd.randint(0, 2))]
        out.append((f"f{k}.c", a or [""], b or [""]))
    return out


def given(spark, rows, real):
    made = []
    for rel, a, b in rows:
        r = classify._real(a, b) if real else linediff.changed(a, b)
        made.append((rel, "c", a, b, [dict(zip(("i1", "i2", "j1", "j2"), h, strict=True)) for h in r]))
    return spark.createDataFrame(made, f"rel string, rules string, old_lines array<string>, new_lines array<string>, ranges {linediff.RANGES}").repartition(3)


def test_renames_are_those_of_each_file(spark):
    rows = files(250, random.Random(1))
    got = sorted(tuple(r) for r in edits.renames(given(spark, rows, False)).collect())
    want = sorted((rel, p, q) for rel, a, b in rows for p, q in classify.file_renames(a, b, linediff.changed(a, b)).items())
    assert got == want and len(want) > 20


def test_moved_blocks_are_those_of_each_file(spark):
    rows = files(300, random.Random(2)) + [("long.c", [f"a{k % 3} = 1;" for k in range(300)] + ["b1 = 2;", "b2 = 3;", "c = 4;"], ["b1 = 2;", "b2 = 3;", *[f"a{k % 3} = 1;" for k in range(300)], "c = 4;"])]
    got = sorted(map(repr, (tuple(r) for r in edits.moved_blocks(given(spark, rows, True)).collect())))
    want = []
    for rel, a, b in rows:
        gone, come = classify.moved_blocks(classify._real(a, b), a, b, "c")
        want += [(rel, *h, n, None) for h, n in gone.items()] + [(rel, *h, None, n) for h, n in come.items()]
    assert got == sorted(map(repr, want)) and len(want) > 20


def test_a_block_slides_as_far_as_it_can(spark):
    lines = ["x", *["a", "b"] * 200, "c"]
    row = spark.createDataFrame([(lines,)], "lines array<string>")
    from pyspark.sql import functions as F

    slide = lambda lo, hi: row.select(edits.slid(F.col("lines"), F.lit(lo), F.lit(hi))).first()[0]
    for lo, hi in ((1, 3), (0, 1), (399, 401), (401, 402), (3, 5)):
        a, z = lo, hi
        while z < len(lines) and lines[a] == lines[z]:
            a, z = a + 1, z + 1
        assert slide(lo, hi) == a - lo


def test_reordering_is_proven_as_by_all_pairs(spark):
    rnd, names, rows, want = random.Random(12), ["p", "q", "r", "rtb_Sum_a1"], [], {}
    for k in range(400):
        n = rnd.randint(1, 5)
        block = [(rnd.choice(names), tuple(rnd.choice(names) for _ in range(rnd.randint(0, 2))), i) for i in range(n)]
        line = lambda s: f"  {s[0]} = {' + '.join([*s[1], str(s[2]) + '.5'])};"
        moved = rnd.sample(block, n)
        clash = lambda a, b: a[0] == b[0] or a[0] in b[1] or b[0] in a[1]
        kept = all(moved.index(a) < moved.index(b) for i, a in enumerate(block) for b in block[i + 1 :] if clash(a, b))
        rows.append((str(k), list(map(line, block)), list(map(line, moved))))
        want[str(k)] = kept and moved != block and n > 1
    more = [("call", ["a = f(x);", "b = 1;"], ["b = 1;", "a = f(x);"]), ("twice", ["a = 1;", "a = 1;", "b = 2;"], ["b = 2;", "a = 1;", "a = 1;"]), ("word", ["if = 1;", "b = 2;"], ["b = 2;", "if = 1;"]), ("fewer", ["a = 1;", "b = 2;"], ["b = 2;"])]
    more += [("none", [], []), ("many", [f"v{k} = {k};" for k in range(201)], [f"v{k} = {k};" for k in range(200, -1, -1)]), ("most", [f"v{k} = {k};" for k in range(200)], [f"v{k} = {k};" for k in range(199, -1, -1)])]
    want |= {r[0]: r[0] == "most" for r in more}
    got = {r["rel"]: r["proven"] for r in edits.reordered(spark.createDataFrame(rows + more, "rel string, old array<string>, new array<string>")).collect()}
    assert got == want
    for rel, a, b in rows + more:
        assert classify.rescheduled(a, b) == want[rel]
