"""Files of tokens hold each row's number of ids, so that starts need no second look at the ids."""

import pytest
from pyspark.sql import functions as F

from driftlens.llm import tokenize
from driftlens.llm.queries_text import tokenizer_file


@pytest.mark.parametrize("ids", [[3, 1, 2, 4], [2, 1, 2, None]])
def test_numbers_of_ids_are_those_of_the_lists(spark, tmp_path, ids):
    docs = spark.createDataFrame(list(zip(ids, ["A few words, and more.", None, "ÉTÉ été x", "one two"])), "doc_id long, text string")
    path = str(tmp_path / "tokens")
    tokenize.write_tokens(tokenize.encoded(docs, tokenizer_file("word_bpe_49k.json"), 2), path)
    rows = tokenize.read_tokens(spark, path)
    assert rows.where(F.col("n_ids") == F.size("ids")).count() == 4
    got = tokenize.digests(rows).orderBy("start").collect()
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(4)]
    assert [r["doc_id"] for r in got] == sorted(ids, key=lambda x: -1 if x is None else x)
