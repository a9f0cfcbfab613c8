"""Scopes by matching brackets against those of one pass over each file."""

import random

from driftlens.functions import text
from driftlens.operators import brackets, scopes
from pyspark.sql import functions as F

C = ["void f(int a)", "{", "}", "}", "{", ";", "if (x) {", "struct s {", "int g (", ")", "int v;", "for (i = 0; i < 3; i++)", "static int h(void) {", "", "typedef union u_t", "#define A {", "a = b(c);", "enum e { A, B };", "x = y(", "é_f(void)"]
A2L = ["/begin CHARACTERISTIC K_1", "/begin MODULE", "/end CHARACTERISTIC", "/end MODULE /begin X a.b[1]", "/END x", "/Begin measurement M", "", "VALUE 1", '"/begin no"', "/begin"]


def test_scopes_are_those_of_one_pass(spark):
    rnd, files = random.Random(3), []
    for k in range(160):
        own = C if k % 2 else A2L
        files.append((f"f{k}.{'c' if k % 2 else 'a2l'}", "\n".join(" ".join(rnd.choice(own) for _ in range(rnd.choice([0, 1, 1, 2]))) for _ in range(rnd.randint(1, 25)))))
    frame = spark.createDataFrame([*files, ("x.py", "def f():\n  pass"), ("e.c", "")], "rel string, text string").repartition(3)
    got = {}
    for r in brackets.label_rows(frame).collect():
        got.setdefault(r["rel"], {})[r["line"]] = r["label"]
    want = {r["rel"]: dict(enumerate(r["labels"])) for r in scopes.scope_labels(frame).collect() if not r["rel"].endswith(".py")}
    assert got == want
    assert sum(x is not None for f in want.values() for x in f.values()) > 300
    assert brackets.label_rows(frame.limit(0)).isEmpty()
    assert frame.where(text.ruleset(F.col("rel")) == "c").count() == 81
