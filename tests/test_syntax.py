"""Lexing by blocks against one pass over the whole text by character, and given lines with their spans."""

import random

import pytest
from pyspark.sql import functions as F

from driftlens.operators import syntax
from driftlens.operators.syntax import COMMENT, DOUBLE, LANGUAGES, PLAIN, SINGLE, spans

# (line comment, block comment, quotes, escape, doubled quote, three quotes)
GRAMMAR = {
    "c": ("//", ("/*", "*/"), "\"'", True, False, False), "cpp": ("//", ("/*", "*/"), "\"'", True, False, False), "a2l": ("//", ("/*", "*/"), '"', False, True, False),
    "arxml": (None, ("<!--", "-->"), "\"'", False, False, False), "python": ("#", None, "\"'", True, False, True), "json": (None, None, '"', True, False, False), "yaml": ("#", None, "\"'", False, False, False),
}


def kinds_by_character(text, rules):
    """c, s or a dot for each character: a machine that reads the whole text once."""
    line, block, quotes, escape, twice, triples = GRAMMAR[rules]
    out, i = [], 0

    def put(upto, k):
        out.extend("\n" if text[j] == "\n" else k for j in range(len(out), min(upto, len(text))))
        return len(out)

    def string(i, q, lines):
        while i < len(text):
            if not lines and text[i] == "\n":
                return i
            if escape and text[i] == "\\" and (lines or text[i + 1 : i + 2] != "\n"):
                # at a line's end a backslash takes nothing along
                i += 1 if lines and text[i + 1 : i + 2] == "\n" else 2
                continue
            if text.startswith(q, i):
                if twice and text.startswith(q, i + 1):
                    i += 2
                    continue
                return i + len(q)
            i += 1
        return i

    while i < len(text):
        three = next((q for q in ("'''", '"""') if triples and text.startswith(q, i)), None)
        if three:
            i = put(string(i + 3, three, True), "s")
        elif line and text.startswith(line, i) and not (rules == "yaml" and i and text[i - 1] not in " \t\n"):
            i = put(text.find("\n", i) if "\n" in text[i:] else len(text), "c")
        elif block and text.startswith(block[0], i):
            end = text.find(block[1], i + len(block[0]))
            i = put(end + len(block[1]) if end >= 0 else len(text), "c")
        elif text[i] in quotes:
            i = put(string(i + 1, text[i], False), "s")
        else:
            i = put(i + 1, ".")
    return "".join(out)


def made(rules, rnd, n):
    parts = ["/*", "*/", "//", "<!--", "-->", "#", " #", '"', "'", "'''", '"""', "\\", "\n", "\n", "\n", " ", "a1", "if", "x = 2", "<TAG b="]
    return "".join(rnd.choice(parts) for _ in range(n))


def given(rows):
    out = []
    for r in sorted(rows, key=lambda r: r["line"]):
        out.append([(s["lo"], s["hi"], s["kind"]) for s in r["spans"]])
    return out


@pytest.mark.parametrize("rules", LANGUAGES)
def test_comments_and_strings_are_those_of_one_pass(rules):
    rnd = random.Random(1)
    for n in [*range(1, 40), *[200] * 150]:
        text, state, got = made(rules, rnd, n), PLAIN, []
        for x in text.split("\n"):
            found, state = spans(x, LANGUAGES[rules], state)
            row = ["."] * len(x)
            for lo, hi, kind in found:
                if kind in ("comment", "string"):
                    row[lo:hi] = kind[0] * (hi - lo)
            assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
            got.append("".join(row))
        want = kinds_by_character(text, rules)
        # A directive takes a word with it, which may hold no comment or string.
        assert "\n".join(got) == want, (text, rules)


@pytest.mark.parametrize(
    ("rules", "state", "line", "want", "then"),
    [
        ("c", PLAIN, "static uint8_T f(int x) { return 0x1F; } // end", "keyword:static type:uint8_T call:f type:int keyword:return number:0x1F comment:// end", PLAIN),
        ("c", PLAIN, '  #define A "x" /* open', 'preproc:  #define string:"x" comment:/* open', COMMENT),
        ("c", COMMENT, "still */ if (a_T)", "comment:still */ keyword:if type:a_T", PLAIN),
        ("cpp", PLAIN, "namespace n { bool b = f<int>(nullptr); }", "keyword:namespace type:bool type:int keyword:nullptr", PLAIN),
        ("arxml", PLAIN, '<P UUID="a">x</P> <!-- a --> <Q', 'tag:P attr:UUID string:"a" tag:/P comment:<!-- a --> tag:Q', PLAIN),
        ("a2l", PLAIN, '/begin CHARACTERISTIC K_1 "say ""no""" VALUE 0x10 FORMAT', 'keyword:/begin type:CHARACTERISTIC string:"say ""no""" type:VALUE number:0x10 keyword:FORMAT', PLAIN),
        ("python", PLAIN, 'def f(self): """doc', 'keyword:def call:f type:self string:"""doc', DOUBLE),
        ("python", SINGLE, "a ''' + len('b') # c", "string:a ''' type:len string:'b' comment:# c", PLAIN),
        ("json", PLAIN, '{"a": [1, true, "\\""]}', 'string:"a" number:1 keyword:true string:"\\""', PLAIN),
        ("yaml", PLAIN, "key: yes # note", "attr:key keyword:yes comment:# note", PLAIN),
        ("yaml", PLAIN, "url:#frag 12", "attr:url number:12", PLAIN),
        ("c", COMMENT, "", "", COMMENT),
    ],
)
def test_given_lines(rules, state, line, want, then):
    found, after = spans(line, LANGUAGES[rules], state)
    assert " ".join(f"{k}:{line[a:z]}" for a, z, k in found) == want and after == then


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_blocks_are_one_pass(spark, size):
    rnd = random.Random(2)
    ends = {"c": "c", "arxml": "arxml", "a2l": "a2l", "python": "py", "yaml": "yaml", "cpp": "cpp", "json": "json"}
    files = [(f"f{k}.{e}", made(r, rnd, 60)) for r, e in ends.items() for k in range(4)] + [("x.txt", "/* a\nb"), ("none.c", None), ("empty.c", "")]
    got = syntax.lexed(spark.createDataFrame(files, "rel string, text string").repartition(3), size).collect()
    for rel, text in files:
        rows = sorted((r for r in got if r["rel"] == rel), key=lambda r: r["line"])
        lang = LANGUAGES.get({v: k for k, v in ends.items()}.get(rel.rsplit(".")[-1]))
        lines = text.split("\n") if text is not None else []
        before = syntax.states(lines, lang)[:-1] if lang else [0] * len(lines)
        assert [r["line"] for r in rows] == list(range(len(lines))) and [r["state"] for r in rows] == before
        assert given(rows) == [spans(x, lang, s)[0] if lang else [] for x, s in zip(lines, before, strict=True)]
    assert syntax.lexed(spark.createDataFrame([], "rel string, text string"), size).isEmpty()


def test_functions_compose(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(256), rnd.randrange(256)) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame(pairs, "f int, g int").coalesce(1).select(syntax.composed(F.col("f"), F.col("g"))).collect()]
    assert got == [sum((g >> 2 * (f >> 2 * s & 3) & 3) << 2 * s for s in range(4)) for f, g in pairs]
