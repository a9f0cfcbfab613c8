"""Known verdicts of the comparison: a tree with a file for each rule, pairs for each proof, and made inputs."""

import random

import pytest

from driftlens.operators.classify import classify, classified
from driftlens.operators.linediff import changed
from driftlens.plans import compare

OLD = {
    "src/comment_only.c": "/* v 1.0 */\n/* date 1 */\nint a;\nint b; /* one */\n",
    "src/rename_only.c": "void f(void)\n{\n  real_T rtb_Sum1;\n  real_T rtb_Gain2;\n  rtb_Sum1 = in1;\n  rtb_Gain2 = rtb_Sum1 * 2.0;\n  out = rtb_Gain2;\n}\n",
    "src/rename_conflict.c": "void f(void)\n{\n  x = rtu_A;\n  y = rtu_A;\n}\n",
    "src/real_change.c": "/* date 1 */\nx = 1.0;\nint k;\ny = 2.0;\n",
    "src/same.h": "int s;\n", "src/deleted.h": "int gone;\n",
    "arxml/uuid_only.arxml": '<A UUID="1">\n<SHORT-NAME>N</SHORT-NAME>\n</A>\n',
    "arxml/admindata.arxml": "<A>\n<ADMIN-DATA>\n<SD>1</SD>\n</ADMIN-DATA>\n</A>\n",
    "arxml/real_change.arxml": '<A UUID="1">\n<SHORT-NAME>Speed_T</SHORT-NAME>\n</A>\n',
    "a2l/comment_only.a2l": "/* one */\n/begin MEASUREMENT M \"\"\n/end MEASUREMENT\n",
    "a2l/cal.a2l": "/begin CHARACTERISTIC K_Gain \"\"\n/end CHARACTERISTIC\n",
}
NEW = {
    "src/comment_only.c": "/* v 1.1 */\n/* date 2 */\nint a;\nint b; /* two */\n",
    "src/rename_only.c": OLD["src/rename_only.c"].replace("rtb_Sum1", "rtb_Sum_k2j").replace("rtb_Gain2", "rtb_Gain_p0f"),
    "src/rename_conflict.c": "void f(void)\n{\n  x = rtu_B;\n  y = rtu_C;\n}\n",
    "src/real_change.c": "/* date 2 */\nx = 1.5;\nint k;\ny = 2.5;\n",
    "src/same.h": "int s;\n", "src/added.c": "int n;\n",
    "arxml/uuid_only.arxml": OLD["arxml/uuid_only.arxml"].replace('"1"', '"2"'),
    "arxml/admindata.arxml": OLD["arxml/admindata.arxml"].replace(">1<", ">2<"),
    "arxml/real_change.arxml": '<A UUID="2">\n<SHORT-NAME>Velocity_T</SHORT-NAME>\n</A>\n',
    "a2l/comment_only.a2l": OLD["a2l/comment_only.a2l"].replace("one", "two"),
    "a2l/cal.a2l": "/begin MEASUREMENT VehSpd \"\"\n/end MEASUREMENT\n",
}
VERDICTS = {
    "src/comment_only.c": "comment-only", "src/rename_only.c": "ignorable-only", "src/rename_conflict.c": "real-change", "src/real_change.c": "real-change", "src/same.h": "identical", "src/added.c": "added", "src/deleted.h": "deleted",
    "arxml/uuid_only.arxml": "ignorable-only", "arxml/admindata.arxml": "ignorable-only", "arxml/real_change.arxml": "real-change", "a2l/comment_only.a2l": "comment-only", "a2l/cal.a2l": "real-change",
}


def test_tree_of_rules(spark):
    sides = [spark.createDataFrame(list(t.items()), "rel string, text string") for t in (OLD, NEW)]
    res = {r["rel"]: r for r in compare.scan_texts(*sides).collect()}
    assert {k: r["status"] for k, r in res.items()} == VERDICTS
    kinds = {k: {h["kind"] for h in r["hunks"]} for k, r in res.items()}
    assert kinds["src/comment_only.c"] == {"comment"} and kinds["src/real_change.c"] == {"comment", "real"} and kinds["arxml/uuid_only.arxml"] == {"uuid"} and kinds["arxml/admindata.arxml"] == {"timestamp"} and kinds["arxml/real_change.arxml"] == {"uuid", "real"}
    assert kinds["src/rename_only.c"] == {"rename"} and res["src/rename_only.c"]["renames"] == {"rtb_Sum1": "rtb_Sum_k2j", "rtb_Gain2": "rtb_Gain_p0f"}


def verdict(old, new):
    """Of C text without comments, so that a text is its own shadow."""
    return classify("c", old, new, old, new, [])


INDEPENDENT = "  a = in1;\n  b = in2;\n  c = in3;"
BLOCK = "void moved(void)\n{\n  one = 1;\n  two = 2;\n}\n"
PAIRS = {
    "independent statements in another order": (f"{{\n{INDEPENDENT}\n}}", "{\n  c = in3;\n  a = in1;\n  b = in2;\n}", "ignorable-only", {"reorder"}),
    "a read before its write": ("{\n  a = in1;\n  b = a;\n}", "{\n  b = a;\n  a = in1;\n}", "real-change", None),
    "two writes of one name": ("{\n  a = in1;\n  a = in2;\n}", "{\n  a = in2;\n  a = in1;\n}", "real-change", None),
    "a write moved over a read": ("{\n  b = a;\n  a = in1;\n  c = in2;\n}", "{\n  a = in1;\n  b = a;\n  c = in2;\n}", "real-change", None),
    "order across a call": ("{\n  a = f(in1);\n  b = in2;\n}", "{\n  b = in2;\n  a = f(in1);\n}", "real-change", None),
    "checksums in names": ("x = rtb_Sum_k2jq8d9e1_o;\n", "x = rtb_Sum_a1b2c3d4e_o;\n", "ignorable-only", {"rename"}),
    "a generator's root changed": ("x = rtb_Sum_a + rtb_Gain_a;\ny = rtb_Sum_b;\n", "x = rtb_Gain_a + rtb_Gain_a;\ny = rtb_Sum_b;\n", "real-change", None),
    "names swapped round": ("x = rtb_S_a;\ny = rtb_S_b;\n", "x = rtb_S_b;\ny = rtb_S_a;\n", "real-change", None),
    "an access point renamed": ("x = Rte_Read_P_A();\n", "x = Rte_Read_P_B();\n", "real-change", None),
    "a literal beside a rename": ("x = rtb_Sum1;\ny = 1;\n", "x = rtb_Sum_k2;\ny = 2;\n", "real-change", None),
    "a block that moved": (BLOCK + "int a1;\nint a2;\nint a3;\n", "int a1;\nint a2;\nint a3;\n" + BLOCK, "real-change", {"moved"}),
    "blank lines": ("int a;\nint b;\n", "int a;\n\n\nint b;\n", "ignorable-only", {"whitespace"}),
}


@pytest.mark.parametrize("name", PAIRS)
def test_pairs(name):
    old, new, status, kinds = PAIRS[name]
    got, hunks, _ = verdict(old, new)
    assert got == status
    if kinds:
        assert {h["kind"] for h in hunks} == kinds


def test_reordering_is_proven_by_brute_force():
    """A shuffled block is noise exactly if every two statements that touch a name, one of them writing it, keep their order."""
    rnd = random.Random(12)
    names = ["p", "q", "r", "s"]
    seen = set()
    for _ in range(400):
        n = rnd.randint(2, 5)
        block = [(rnd.choice(names), tuple(rnd.choice(names) for _ in range(rnd.randint(0, 2))), k) for k in range(n)]
        line = lambda s: f"  {s[0]} = {' + '.join([*s[1], str(s[2]) + '.5'])};"
        moved = rnd.sample(block, n)
        if moved == block:
            continue
        clash = lambda a, b: a[0] == b[0] or a[0] in b[1] or b[0] in a[1]
        kept = all(moved.index(a) < moved.index(b) for i, a in enumerate(block) for b in block[i + 1 :] if clash(a, b))
        got = verdict("{\n" + "\n".join(map(line, block)) + "\n}", "{\n" + "\n".join(map(line, moved)) + "\n}")[0]
        assert (got == "ignorable-only") == kept, (block, moved)
        seen.add(kept)
    assert seen == {True, False}


def test_ranges_tile_both_sides():
    rnd = random.Random(20260807)
    for _ in range(400):
        a, b = ([rnd.choice(["a", "b", "c", "}", ""]) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        i = j = 0
        for i1, i2, j1, j2 in changed(a, b):
            assert i1 - i == j1 - j and a[i:i1] == b[j:j1]
            i, j = i2, j2
        assert a[i:] == b[j:] and len(a) - i == len(b) - j


def test_inputs_without_unique_lines_stay_aligned():
    element = ["<E>", "<N>x</N>", "<V>1</V>", "</E>"]
    a = element * 300
    b = element * 100 + element + element * 100 + element + element * 100 + element
    assert sum(max(i2 - i1, j2 - j1) for i1, i2, j1, j2 in changed(a, b)) < 40


def test_every_second_of_many_lines_replaced():
    a = [f"l{k}" for k in range(4000)]
    b = [x if k % 2 else f"new{k}" for k, x in enumerate(a)]
    assert changed(a, b) == [(k, k + 1, k, k + 1) for k in range(0, 4000, 2)]


def test_two_edits_in_a_rewritten_file(spark):
    old = "\n".join(f'<P UUID="a{k}">\n<DATE>2024-01-{k}</DATE>\n<SHORT-NAME>P{k}</SHORT-NAME>\n<LEN>{k}</LEN>\n</P>' for k in range(120))
    new = "\n".join(f'<P UUID="b{k}">\n<DATE>2025-01-{k}</DATE>\n<SHORT-NAME>P{k}</SHORT-NAME>\n<LEN>{k + (k in (0, 119)) * 1000}</LEN>\n</P>' for k in range(120))
    r = classified(spark.createDataFrame([("x.arxml", "arxml", old, new)], "rel string, rules string, old_text string, new_text string")).first()
    lines = {}
    for h in r["hunks"]:
        lines[h["kind"]] = lines.get(h["kind"], 0) + max(h["i2"] - h["i1"], h["j2"] - h["j1"])
    assert r["status"] == "real-change" and lines["real"] < 40 and lines["uuid"] > 100 and lines["timestamp"] > 100
