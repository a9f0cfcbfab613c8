"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.sources.stored import checkpointed, looked_up, scratch, shared_dir, small, written

__all__ = ["ascii_lower", "batches_of", "checkpointed", "fresh", "looked_up", "read", "remembered", "scratch", "shared_dir", "small", "space_words", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is. Plain ASCII takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def space_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Within it, jobs send Python workers batches of at most this size, which each side of the pipe holds in full."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


_remembered: list[dict] = []


def remembered() -> dict:
    """An empty dict for what an operator keeps in a Python worker beyond a task, which other operators' tasks may clear."""
    _remembered.append(found := {})
    return found


def let_go() -> None:
    if any(_remembered):
        for found in _remembered:
            found.clear()
        gc.collect()


def fresh(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for tasks that need the memory themselves: first all that is remembered in the worker goes, as jobs share workers."""

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)

    return started
