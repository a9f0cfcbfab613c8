"""Thin queries of the operators on documents that run Python in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import repeats, simhash, tokenize
from driftlens.llm.common import read, scratch

END_ID = 2


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenize.write_tokens(tokenize.encoded(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), END_ID), path)
    return tokenize.digests(tokenize.read_tokens(spark, path))


def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(read(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_token_output": op2_token_output, "op4_repeat_removal": op4_repeat_removal, "op5_simhash": op5_simhash}
SQL: dict[str, str] = {}
