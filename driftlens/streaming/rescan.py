"""Comparison again and again, as snapshots of files arrive: a stream of (snapshot, rel, text) against a baseline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlens.plans.compare import scan_texts


def rescan(snapshots: DataFrame, baseline: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch's latest files are compared with the baseline's files of the same paths; put gets the results."""

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("rel").agg(F.max_by("text", "snapshot").alias("text"))
        put(scan_texts(baseline.join(latest.select("rel"), "rel", "left_semi"), latest), number)

    return snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
