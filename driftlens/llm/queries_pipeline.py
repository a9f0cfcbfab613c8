"""The pipeline, and SentencePiece on its own, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import sentencepiece
from driftlens.llm.common import read
from driftlens.llm.queries_text import tokenizer_file


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encoded_and_checked(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), ["doc_id"])


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
SQL: dict[str, str] = {}
