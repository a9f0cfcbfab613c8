"""Intermediate tables in the folder that driver and executors share, and lookups that hot keys don't slow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one, on a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="driftlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost a reread and not a rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for files that a job writes and reads again."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet files in the shared folder: computed once, compressed, and read again by column."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, and characters as JSON, of a table that is broadcast at most.
SMALL_ROWS, SMALL_SIZE = 500_000, 64 << 20


def small(table: DataFrame) -> DataFrame:
    """table, to be broadcast if its size, which is looked at, allows it; else as it is. Pass one that is stored."""
    if table.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        return table
    size = table.agg(F.sum(F.length(F.to_json(F.struct(*table.columns))))).first()[0] or 0
    return F.broadcast(table) if size <= SMALL_SIZE else table


#: A key with more than this share of all rows is hot; there are no more than 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows left-joined to table, which has one row per key and is stored, however unevenly rows are spread over the keys.

    A small table is broadcast. Of another the hot keys are, 1 / HOT_SHARE at most; rows with a hot key, or none, are then
    dealt by a value of their own, under which they find nothing, when the others are joined.
    """
    if (few := small(table)) is not table:
        return rows.join(few, key, "left").select(*rows.columns, *[c for c in table.columns if c != key])
    return dealt(rows, table, key)


def dealt(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """looked_up() of a table that is not small."""
    counts = checkpointed(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    names = [c for c in table.columns if c != key]
    hot = counts.where(F.col("_n") > total * HOT_SHARE).select(key).join(table, key).select(F.col(key).alias("_hot"), F.struct(*names).alias("_found"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    cold = table.select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("_cold"), F.struct(*names).alias("_other"))
    own = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string")))
    joined = met.withColumn("_cold_key", own).join(cold, F.col("_cold_key") == F.col("_cold"), "left")
    found = F.coalesce("_found", "_other")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in names])
