"""Queries on keys that larger copies of the given tables have."""

import duckdb
import pandas as pd

import __spark_entry__


def test_an_edit_leaves_the_digits_of_keys_alone(spark, tmp_path):
    """Keys that hold 2024, the year of an edited date."""
    pd.DataFrame({"c_custkey": [2024, 20240, 20242, 20245, 120242, 202402, 3]}).to_parquet(f"{tmp_path}/customer.parquet")
    got = __spark_entry__.queries()["edited_verdicts"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(__spark_entry__.oracle_sql()["edited_verdicts"]).fetchall())
