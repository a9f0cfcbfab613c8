"""scope_labels over its whole table."""

from driftlens.plans import queries


def test_every_document_has_scopes(spark):
    sf = "/root/testdata/sf0.001"
    want = {f"d{r['doc_id']}" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r["rel"].split(".")[0] for r in queries.scope_labels(spark, sf).select("rel").distinct().collect()} == want


def test_directives_open_no_scope(spark):
    from driftlens.operators.scopes import scope_labels

    c = "#define X { \\\n  more { \nint v;\nstatic void f(int a)\n{\n #if A\n  if (a) {\n  }\n #endif // {\n}\nint t[] = {\n1 };\nwhile (x) {\n}\nenum e {\n x };"
    cpp = "namespace n {\nclass A : B {\n  ~A() {\n  }\n  void if_(int x) {\n  }\n};\n}\nint A::g(int y) {\n}"
    rows = spark.createDataFrame([("a.c", c), ("b.cpp", cpp)], "rel string, text string")
    found = {r["rel"]: r["labels"] for r in scope_labels(rows).collect()}
    assert found["a.c"] == [None] * 3 + ["f"] * 7 + [None] * 4 + ["e"] * 2
    assert found["b.cpp"] == ["n", "n / A", "A / ~A", "A / ~A", "A / if_", "A / if_", "n / A", "n", "A::g", "A::g"]
