"""Cells of the complete panel are grouped in all shuffle partitions, however few bytes come in."""

from datetime import datetime

from pyspark.sql import functions as F

from survey_queries import relations


def test_cells_of_the_complete_panel_lie_in_all_partitions(spark, tmp_path, monkeypatch):
    lines = [(i, 1, p, datetime(1995 + y, 5, 1), "A", "O", 16.0)
             for i, (p, y) in enumerate((p, y) for p in range(1, 201) for y in range(3))]
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp, l_returnflag string, "
               "l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"Brand#{p % 3 + 11}") for p in range(1, 201)], "p_partkey long, p_brand string"
                          ).write.parquet(f"{tmp_path}/part.parquet")
    held = []
    monkeypatch.setattr(relations, "cut_lineage", lambda df: held.append(df) or df)
    relations.complete_cells(spark, str(tmp_path))
    where = held[0].select(F.spark_partition_id().alias("p")).distinct().count()
    assert where == int(spark.conf.get("spark.sql.shuffle.partitions"))
