"""Strata of many years are joined by key, however few bytes the planner takes them for."""

from datetime import datetime

from survey_queries import views


def test_strata_are_not_broadcast_by_an_estimate_that_leaves_out_the_years(spark, tmp_path):
    lines = [(i, 1, p, datetime(1995 + y, 5, 1), "A", "O", 4.0)
             for i, (p, y) in enumerate((p, y) for p in (1, 2, 3, None) for y in range(3))]
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp, l_returnflag string, "
               "l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(1, "Brand#11"), (1, "Brand#11"), (2, "Brand#3"), (3, None), (None, "Brand#25")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")

    strata = views.strata(spark, str(tmp_path))
    rows = sorted(((r.station, r.year, r.district, r.stratum, r.total_area) for r in strata.collect()), key=str)
    brands = [(1, "Brand#11", 11, 802.0)] * 2 + [(2, "NBS All", 3, 401.0), (None, "Brand#25", 999, 401.0)]
    assert rows == sorted(((p, 1995 + y, d, s, a) for p, d, s, a in brands for y in range(3)), key=str)

    both = views.catch(spark, str(tmp_path)).join(strata, ["year", "station"])
    plan = both._jdf.queryExecution().sparkPlan().toString()
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "SortMergeJoin" in top and both.count() == 9
