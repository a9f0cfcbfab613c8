"""Lookups of hot keys, and shared folders."""

import pytest
from pyspark.sql import functions as F

from driftlens.sources import stored


def test_dealt_lookups_are_left_joins(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else "hot" if k % 3 == 0 else f"k{k % 40}") for k in range(5000)], "id long, key string")
    table = stored.checkpointed(spark.createDataFrame([("hot", 1, "x")] + [(f"k{k}", k, None) for k in range(30)], "key string, n int, s string"))
    want = sorted(map(tuple, rows.join(table, "key", "left").select("id", "key", "n", "s").collect()))
    for f in (stored.looked_up, stored.dealt):
        found = f(rows, table, "key")
        assert found.columns == ["id", "key", "n", "s"] and sorted(map(tuple, found.collect())) == want
    assert stored.dealt(rows.limit(0), table, "key").isEmpty()


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(stored, "SMALL_ROWS", 10)
    table = spark.range(11).withColumn("n", F.lit(1))
    assert stored.small(table) is table and stored.small(spark.range(5)) is not None
    rows = spark.range(20)
    assert sorted(r["n"] or 0 for r in stored.looked_up(rows, stored.checkpointed(table), "id").collect()) == [0] * 9 + [1] * 11


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getCheckpointDir():  # noqa: N802
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stored.shared_dir(Session())
