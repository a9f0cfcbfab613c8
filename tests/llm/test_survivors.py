"""Of each component one row stays, chosen by row and not by id."""

from driftlens.llm import simhash

UNLIKE = [f"{w} " * 3 + " ".join(f"{w}{k}" for k in range(30)) for w in ("red", "green", "blue", "grey")]


def check_rows(spark, one_of_each):
    red, green, blue, grey = UNLIKE
    rows = [(None, red), (None, green), (None, blue), (1, blue), (2, blue), (2, grey), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(((r["doc_id"], r["text"] or "") for r in one_of_each(docs).collect()), key=repr)
    assert found == sorted([(None, red), (None, green), (1, blue), (2, grey), (3, "")], key=repr)
    twice = one_of_each(docs.union(docs))
    assert sorted(((r["doc_id"], r["text"] or "") for r in twice.collect()), key=repr) == found


def test_unlike_texts_under_one_id_stay(spark):
    check_rows(spark, simhash.one_of_each)
