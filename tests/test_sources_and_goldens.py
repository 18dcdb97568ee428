"""Files in and out, published values, and properties of single expressions."""

import pytest
from pyspark.sql import functions as F

from trawlframe import functions as fx
from trawlframe.operators import series
from trawlframe.sources import (
    CATCH_SCHEMA, null_sentinels, read_imputations, read_table, write_imputations, write_table,
)

# Log likelihood, parameters, criterion and distance to the best
# of four fits to 96 observations.
FITS = [
    ("unconstrained", -64.4943697805999, 9, 149.081762817014, 0.0),
    ("diagonal and unequal", -72.4533426562817, 6, 157.850505537283, 8.7687427202687),
    ("diagonal and equal", -78.3451168229565, 4, 165.129794085473, 16.0480312684596),
    ("equalvarcov", -77.8811659658528, 5, 166.428998598372, 17.3472357813585),
]
# Estimate, standard error and 95 % limits of a trend.
LIMITS = [
    (-2.25520856196935, 1.13385203740912, -4.47751771908858, -0.0328994048501192),
    (-2.79534550134758, 1.05637371013659, -4.86579992743024, -0.724891075264908),
]


def test_aicc_of_published_fits(spark):
    df = spark.createDataFrame([(r, ll, k, 96) for r, ll, k, _, _ in FITS], "r string, ll double, k int, n int")
    out = {r.r: (r.aicc, r.delta_aicc) for r in series.delta_aicc(df, "ll", "k", "n").collect()}
    for name, _, _, score, delta in FITS:
        assert out[name] == pytest.approx((score, delta), abs=1e-10)


def test_normal_limits_of_a_published_trend(spark):
    df = spark.createDataFrame([r[:2] for r in LIMITS], "e double, s double")
    low, high = fx.normal_ci("e", "s")
    got = [tuple(r) for r in df.select(low, high).collect()]
    for g, want in zip(got, LIMITS):
        assert g == pytest.approx(want[2:], abs=1e-12)
    low, _ = fx.normal_ci("e", "s", z=1.96)
    assert df.select(low).first()[0] == pytest.approx(LIMITS[0][0] - 1.96 * LIMITS[0][1])


def test_csv_with_na_and_explicit_schema(spark, tmp_path):
    path = tmp_path / "catch.csv"
    path.write_text("hauljoin,station,year,cruise,cw,sc,sex,clutch,sample_factor\n"
                    "h1,A-1,2018,201801,NA,2,1,0,1.5\nh2,B-2,2018,201801,45.5,NA,2,NA,NA\n")
    df = read_table(spark, str(path), CATCH_SCHEMA)
    assert df.schema == CATCH_SCHEMA
    assert [r.cw for r in df.orderBy("hauljoin").collect()] == [None, 45.5]
    assert [r[0] for r in df.select(fx.station_key()).orderBy("hauljoin").collect()] == ["A1", "B2"]
    with pytest.raises(ValueError):
        read_table(spark, str(path))


def test_tables_round_trip_and_are_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(2018, 1.0), (2019, None)], "year int, v double")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / f"out_{fmt}")
        write_table(df, path, fmt)
        back = spark.read.csv(path, schema="year int, v double", header=True, nullValue="NA") if fmt == "csv" \
            else read_table(spark, path)
        assert sorted(back.collect(), key=lambda r: r.year) == df.orderBy("year").collect()
        with pytest.raises(Exception):
            write_table(df, path, fmt)
    path = str(tmp_path / "by_year")
    write_table(df, path, partition_by=["year"])
    assert read_table(spark, path).filter("year = 2018").count() == 1


def test_imputations_are_partitioned_and_pruned(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "A", float(i + t)) for i in (1, 2, 3) for t in (1, 2)],
                               "imputation int, t int, s string, v double")
    path = str(tmp_path / "imputed")
    write_imputations(df, path)
    assert read_imputations(spark, path).count() == 6
    some = read_imputations(spark, path, [2])
    assert {r.imputation for r in some.collect()} == {2}
    pooled = series.pool_imputations(read_imputations(spark, path), "t", "s", "v").orderBy("t").first()
    assert (pooled["mean"], pooled["sd"]) == (3.0, 1.0)
    assert pooled["std_error"] == pytest.approx(1 / 3**0.5)


def test_sentinels_become_null(spark):
    df = spark.createDataFrame([(-9999.0,), (1.0,), (None,)], "t double")
    assert [r[0] for r in null_sentinels(df, {"t": -9999.0}).collect()] == [None, 1.0, None]


def test_expressions_at_their_edges(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (None,), (16.0,)], "v double")
    got = [tuple(r) for r in df.select(
        fx.log_positive("v"), fx.zero_to_null("v"), fx.null_to_zero("v"), fx.floor_at_zero("v"),
        fx.presence("v"), fx.safe_div(F.lit(1.0), "v")).collect()]
    assert got[0] == (None, None, 0.0, 0.0, 0, None)
    assert got[1][:4] == (None, -1.0, -1.0, 0.0)
    assert got[2] == (None, None, 0.0, None, None, None)
    assert got[3][1:5] == (16.0, 16.0, 16.0, 1)
    assert df.select(fx.fourth_root("v")).collect()[3][0] == 2.0


def test_polygon_membership(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (1.0, 3.0), (-0.1, 1.0)], "x double, y double")
    triangle = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    assert [r[0] for r in df.select(fx.inside_polygon("x", "y", triangle)).collect()] == [True, False, False, False]
    # (3, 1) and (1, 3) lie on the slanted edge, which counts as outside here.
