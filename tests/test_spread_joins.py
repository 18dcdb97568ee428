"""Joins of a large catch keep all shuffle partitions, and depths are broadcast only where counted few."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from survey_queries import estimates, relations
from trawlframe.operators import cpue

N = 200


@pytest.fixture
def tables(spark, tmp_path):
    lines = [(i, 1, p, datetime(1995 + y, 5, 1), "A", "O", 16.0)
             for i, (p, y) in enumerate((p, y) for p in range(1, N + 1) for y in range(3))]
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp, l_returnflag string, "
               "l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"Brand#{p % 3 + 11}", 900.0 + p) for p in range(1, N + 1)],
                          "p_partkey long, p_brand string, p_retailprice double"
                          ).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_large_catch_is_joined_in_all_partitions(spark, tables, monkeypatch):
    few = estimates.cpue_frame(spark, tables)
    monkeypatch.setattr(cpue, "SPREAD_ROWS", 3 * N - 1)
    many = estimates.cpue_frame(spark, tables)
    where = many.select(F.spark_partition_id().alias("p")).distinct().count()
    assert where == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str)


def test_many_depths_are_joined_by_key(spark, tables, monkeypatch):
    def joined():
        rows = relations.taxa_rows(spark, tables)
        return rows._jdf.queryExecution().sparkPlan().toString(), sorted(rows.collect(), key=str)

    def depth(plan):
        return next(line for line in plan.splitlines() if "Join" in line and "year" not in line and "brand" not in line)

    plan, rows = joined()
    assert "BroadcastHashJoin" in depth(plan)
    monkeypatch.setattr(relations, "BROADCAST_BYTES", 0)
    plan, same_rows = joined()
    assert "SortMergeJoin" in depth(plan) and rows == same_rows and len(rows) > 0
