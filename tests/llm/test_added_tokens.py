"""Texts that hold the tokenizer's added tokens literally."""

import brute

from driftlens.llm import queries_text

TEXTS = ["hello<|endoftext|>", "a<|endoftext|>.", "<|startoftext|>Hello there<|endoftext|>, more", "x <|endoftext|> y", "<|EndOfText|>!", "no<|endoftext", "b|>", "<|startoftext|><|endoftext|>>", "Word|endoftext|>;", "<|endoftext|>end"]


def test_added_tokens_in_text(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r[1:4]) for r in queries_text.op2_token_output(spark, str(tmp_path)).collect()}
    assert got == brute.op2(rows, queries_text.tokenizer_file("word_bpe_49k.json"))
