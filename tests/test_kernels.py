"""The order-dependent kernels: line diff and pair classification."""

import random
import time

import pytest

from driftlens.operators.classify import canonical, classify, file_renames, generated_swaps, rescheduled
from driftlens.operators.linediff import changed


def plain_shadow(t):
    return "\n".join(" ".join(x.split()) for x in t.split("\n"))


def c_shadow(t):
    import re

    t = re.sub(r"/\*.*?\*/|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), t, flags=re.S)
    return plain_shadow(t)


def judge(old, new, rules="c"):
    sh = c_shadow if rules == "c" else plain_shadow
    variants = [("whitespace", plain_shadow(old), plain_shadow(new))] + ([("comment", sh(old), sh(new))] if rules == "c" else [])
    return classify(rules, old, new, sh(old), sh(new), variants)


def test_ranges_tile_both_sides():
    rnd = random.Random(11)
    for _ in range(400):
        a, b = ([rnd.choice(["a", "b", "c", "}", ""]) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        i = j = 0
        for i1, i2, j1, j2 in changed(a, b):
            assert a[i:i1] == b[j:j1] and (i1 < i2 or j1 < j2)
            i, j = i2, j2
        assert a[i:] == b[j:]


def test_repeated_elements_stay_apart():
    element = ["<e>", "  <x/>", "  <y/>", "</e>"]
    a = element * 300
    b = element * 100 + element + element * 100 + element + element * 100 + element
    assert sum(i2 - i1 + j2 - j1 for i1, i2, j1, j2 in changed(a, b)) < 40


def test_alternating_edits_are_quick():
    a = [f"line {k}" for k in range(4000)]
    b = [f"other {k}" if k % 2 else x for k, x in enumerate(a)]
    began = time.perf_counter()
    assert sum(i2 - i1 for i1, i2, _, _ in changed(a, b)) == 2000
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    ("old", "new", "status", "kinds"),
    [
        ("int a; /* one */\n", "int a; /* two */\n", "comment-only", {"comment"}),
        ("int  a;\n", "int a;\n", "ignorable-only", {"whitespace"}),
        ("x = 1;\n", "x = 2;\n", "real-change", {"real"}),
        ("rtb_Sum1 = u;\ny = rtb_Sum1;\n", "rtb_Sum_k2j = u;\ny = rtb_Sum_k2j;\n", "ignorable-only", {"rename"}),
        ("a = b;\nc = a;\n", "a = b;\nd = a;\ne = a;\n", "real-change", {"real"}),
        ("p = a;\nq = b;\n", "q = b;\np = a;\n", "ignorable-only", {"reorder"}),
        ("p = a;\nq = p;\n", "q = p;\np = a;\n", "real-change", {"real"}),
        ("p = f(a);\nq = b;\n", "q = b;\np = f(a);\n", "real-change", {"real"}),
        ("IDLE_STATE = x;\n", "DRIVE_STATE = x;\n", "real-change", {"real"}),
        ("x = rtb_AND_c4nxjoom3d;\n", "x = rtb_AND_j2kqp1wxab;\n", "ignorable-only", {"rename"}),
        ("u = rtb_AND_c4nxjoom3d;\nf(1);\nw = rtb_OR_j2kqp1wxab;\n", "u = rtb_OR_j2kqp1wxab;\nf(1);\nw = rtb_AND_c4nxjoom3d;\n", "real-change", {"real"}),
    ],
)
def test_c_pairs(old, new, status, kinds):
    got, hunks, _ = judge(old, new)
    assert (got, {h["kind"] for h in hunks}) == (status, kinds)


def test_noise_beside_a_real_change_stays_noise():
    status, hunks, _ = judge("/* a */\nx = 1;\nz = 3;\ny = 2;\n", "/* b */\nx = 1;\nz = 3;\ny = 4;\n")
    assert status == "real-change" and [h["kind"] for h in hunks] == ["comment", "real"]


def test_moved_block():
    f, g, h = ("void f(void)\n{\n  p(1);\n}\n", "void g(void)\n{\n  q(2);\n}\n", "void h(void)\n{\n  r(3);\n}\n")
    status, hunks, _ = judge(f + g + h, g + h + f)
    assert status == "real-change" and {x["kind"] for x in hunks} == {"moved"}
    assert any(x["moved_to"] for x in hunks) and any(x["moved_from"] for x in hunks)


def test_parts():
    assert canonical("rtb_AND_c4nxjoom3d + Sub_c4nxjoom3d_step + x") == "rtb_AND + Sub__step + x"
    assert file_renames(["a = q;"], ["b = q;"], [(0, 1, 0, 1)]) == {"a": "b"}
    assert not generated_swaps(["i_0 = i_1;"], ["i_1 = i_0;"], set(), set())
    assert generated_swaps(["f(rtb_A_c,", "  x);"], ["f(rtb_A_d, x);"], set(), set())
    assert not rescheduled(["a = 1;"], ["a = 1;"])


def test_scopes():
    from driftlens.operators.scopes import labels

    c = "\nint v;\nstatic void f(int a)\n{\n  if (a) {\n  }\n}\nint t[] = {\n1 };\nstruct s {\n int x;\n};"
    assert labels(c, "c") == [None, None, "f", "f", "f", "f", "f", None, None, "s", "s", "s"]
    cpp = "namespace n {\nclass A {\n void f() {\n  g();\n }\n};\n}\nint x;"
    assert labels(cpp, "cpp") == ["n", "n / A", "A / f", "A / f", "A / f", "n / A", "n", None]
    xml = "<P>\n<SHORT-NAME>Ctrl</SHORT-NAME>\n<R>\n<SHORT-NAME>Step</SHORT-NAME>\n</R>\n</P>"
    assert labels(xml, "arxml") == ["Ctrl", "Ctrl", "Ctrl / Step", "Ctrl / Step", "Ctrl / Step", "Ctrl"]
    assert labels("/begin MOD M\n/begin KIND\nx\n/end KIND\n/end MOD\ny", "a2l") == ["M", "KIND", "KIND", "KIND", "M", None]
    assert labels("class A:\n  def f(self):\n    pass\n\nx = 1", "python") == ["A", "A / f", "A / f", "A / f", None]
    assert labels("a\nb", "json") == [None, None]
