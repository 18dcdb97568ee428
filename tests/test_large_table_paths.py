"""The ways taken when side tables are too large to broadcast, and hot keys."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from survey_queries.check import compare, duck
from trawlframe import session
from trawlframe.operators import bootstrap, cpue, grid, spatial

SF = "/root/testdata/sf0.001"
NAMES = [
    "abundance_bootstrap", "abundance_1mm", "anomaly", "d95_members", "factor_regression",
    "factor_residuals", "histogram", "influence_area", "microstructure_index",
    "nearest_point_grid_unlimited", "patch_summary", "share_of_total", "spatial_patches",
    "spatial_pca_loadings", "spreading_area", "cross_correlation", "weighted_quantile",
]


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(bootstrap, "BROADCAST_VALUES", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_result_without_any_broadcast(spark, con, no_broadcast, name):
    df = contract.queries()[name](spark, SF)
    assert compare(df, con, contract.oracle_sql()[name]) == ""


def test_haul_with_a_third_of_the_catch(spark):
    n = 3000
    catch = spark.range(n).select(
        F.when(F.col("id") < n // 3, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("station"),
        F.lit(2018).alias("year"), F.lit(1).alias("sex"), F.lit(40.0).alias("cw"),
        F.lit(0).alias("clutch"), F.lit(1.5).alias("sample_factor"))
    haul = catch.select("station", "year").distinct().select(
        "*", F.lit(58.0).alias("lat"), F.lit(-170.0).alias("lon"), F.lit(2.0).alias("distance_fished"),
        F.lit(15.0).alias("net_width"), F.lit(10).alias("stratum_fish"))
    strata = haul.select("station", "year", F.lit("X").alias("district"), F.lit(1).alias("stratum"),
                         F.lit(401.0).alias("total_area"))
    out = cpue.cpue_long(catch, haul, strata).filter("size_sex = 'male31to60'")
    assert out.count() == n - n // 3 + 1
    assert out.filter("station = 'hot'").first().num_crab == 1.5 * (n // 3)


def test_ties_and_a_hot_position_keep_every_row(spark):
    n = 2000
    points = spark.range(n).select(
        F.lit(1).alias("g"), F.col("id").alias("station"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 10).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 7).cast("double").alias("y"),
        F.lit(1.0).alias("z"))
    members = spatial.d95_members(points, "z", ["g"])
    assert members.count() == n and members.filter("d95").count() == int(n * 0.95)
    # Equal values are taken in the order of the stations.
    assert members.filter("d95").agg(F.max("station")).first()[0] == int(n * 0.95) - 1
    areas = grid.influence_area(points, 1.0, 25, ["g"])
    assert areas.count() == n
    assert areas.filter("x = 5 AND y = 5").select(F.round("influence_area", 9)).distinct().count() == 1


def test_points_sharing_one_coordinate_have_no_grid(spark):
    points = spark.createDataFrame([(1, 1, 2.0, 1.0), (1, 2, 2.0, 3.0)], "g int, station int, x double, y double")
    areas = grid.influence_area(points, 0.5, 10, ["g"])
    assert sorted(r.influence_area for r in areas.collect()) == [0.0, 0.0]
