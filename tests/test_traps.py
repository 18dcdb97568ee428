"""The points where a rewrite goes wrong, each on a few rows."""

import math

import pytest
from pyspark.sql import functions as F

from trawlframe import functions as fx
from trawlframe.operators import cpue, estimate, joins, panel, patches, prep, series, spatial

CATCH = ("station string, year int, sex int, cw double, clutch int, sample_factor double")
HAUL = ("station string, year int, lat double, lon double, distance_fished double, "
        "net_width double, stratum_fish int")
STRATA = "station string, year int, district string, stratum int, total_area double"
CPUE = ("year int, region string, stratum_crab int, size_sex string, total_area double, "
        "cpue double, num_crab double, area_swept double")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_strict_aggregates_give_null_with_a_gap(frame):
    df = frame("g int, v double", (1, 1.0), (1, None), (2, 1.0), (2, 3.0), (3, 5.0))
    out = {r.g: r for r in df.groupBy("g").agg(
        fx.strict_sum("v").alias("s"), fx.strict_avg("v").alias("m"),
        fx.strict_var("v").alias("v"), fx.std_error("v").alias("e")).collect()}
    assert (out[1].s, out[1].m, out[1].v) == (None, None, None)
    assert (out[2].s, out[2].m, out[2].v) == (4.0, 2.0, 2.0)
    assert out[2].e == pytest.approx(1.0)
    assert out[3].s == 5.0 and out[3].v is None and out[3].e is None


def survey(frame, catch):
    haul = frame(HAUL, ("A", 2018, 58.0, -170.0, 2.0, 15.0, 10), ("B", 2018, 59.0, -171.0, 2.0, 15.0, 20),
                 ("C", 2018, 60.0, -172.0, None, 15.0, 20))
    strata = frame(STRATA, ("A", 2018, "NBS All", 1, 401.0), ("B", 2018, "Matthew", 999, 802.0),
                   ("C", 2018, "Matthew", 999, 802.0), ("D", 2018, "Matthew", 999, 802.0))
    return frame(CATCH, *catch), haul, strata


def test_missing_factor_makes_the_class_zero_unless_lenient(frame):
    tables = survey(frame, [("A", 2018, 1, 40.0, 0, 2.0), ("A", 2018, 1, 41.0, 0, None),
                            ("A", 2018, 2, 40.0, 1, 3.0)])
    strict = {r.size_sex: r.num_crab for r in cpue.cpue_long(*tables).filter("station = 'A'").collect()}
    lenient = {r.size_sex: r.num_crab for r in cpue.cpue_long(
        *tables, strict_catch=False).filter("station = 'A'").collect()}
    assert strict["male31to60"] == 0.0 and strict["mature_female"] == 3.0
    assert lenient["male31to60"] == 2.0
    assert len(strict) == 5


def test_cpue_long_stations_strata_and_effort_side(frame):
    tables = survey(frame, [("A", 2018, 1, 40.0, 0, 2.0)])
    out = cpue.cpue_long(*tables)
    # B was fished without catch, C has no effort, D was never fished.
    assert {r.station for r in out.collect()} == {"A", "B"}
    b = out.filter("station = 'B'").first()
    assert (b.stratum_crab, b.stratum_fish, b.region, b.num_crab) == (10, 20, "EBS", 0.0)
    assert out.filter("station = 'A'").first().region == "NBS"
    assert {r.station for r in cpue.cpue_long(*tables, effort_side="catch").collect()} == {"A"}


def test_catch_with_hauls_keeps_both_sides_and_marks_clashes(frame):
    catch = frame("hauljoin int, station string, cruise int", (1, "A", 5), (3, "C", 6))
    haul = frame("hauljoin int, station string, cruise int, lat double", (1, "A", 7, 1.0), (2, "B", 8, 2.0))
    both = joins.catch_with_hauls(catch, haul, ["hauljoin", "station"])
    assert rows(both.na.fill(0), "hauljoin", "cruise", "cruise_haul") == [(1, 5, 7), (2, 0, 8), (3, 6, 0)]
    assert joins.catch_with_hauls(catch, haul, ["hauljoin", "station"], "catch").count() == 2


def test_double_haul_keeps_two_rows_and_fans_out_over_strata(frame):
    catch = frame(CATCH, ("A", 2018, 1, 40.0, 0, 2.0))
    haul = frame(HAUL, ("A", 2018, 58.0, -170.0, 2.0, 15.0, 10), ("A", 2018, 58.5, -170.0, 2.0, 15.0, 20))
    strata = frame(STRATA, ("A", 2018, "X", 1, 401.0))
    out = cpue.cpue_long(catch, haul, strata)
    assert out.count() == 2 * 2 * 5


def test_one_station_stratum_leaves_the_region_without_error(frame):
    df = frame(CPUE, *[(2018, "EBS", s, "m", 100.0, c, c, 1.0) for s, c in
                       ((1, 1.0), (1, 3.0), (2, 5.0))])
    out = estimate.abundance_naive(df).first()
    assert out.abundance_mil == pytest.approx((2 + 5) * 100 / 1e6)
    assert out.stderr_mil is None and out.lwr_95 is None


def test_error_rules_and_weighted_mean_of_totals(frame):
    df = frame(CPUE, *[(2018, "EBS", s, "m", a, c, c, 1.0) for s, a, c in
                       ((1, 1e6, 1.0), (1, 1e6, 3.0), (2, 3e6, 2.0), (2, 3e6, 6.0))])
    se1, se2 = 1.0, 3e6 * math.sqrt(8 / 2) / 1e6
    naive = estimate.abundance_naive(df).first()
    assert naive.stderr_mil == pytest.approx(se1 + se2)
    quad = estimate.abundance_naive(df, se_rule="quadrature").first()
    assert quad.stderr_mil == pytest.approx(math.hypot(se1, se2))
    weighted = estimate.abundance_weighted(df).first()
    assert weighted.weighted_abundance == pytest.approx(0.25 * 2 + 0.75 * 12)
    assert weighted.stderr_mil == pytest.approx(0.25**2 * se1 + 0.75**2 * se2)


def test_weighted_mean_with_missing_weights(frame):
    df = frame("t int, x double, w double", (1, 1.0, 1.0), (1, 3.0, None), (1, None, 9.0), (2, 2.0, -1.0), (2, 4.0, 3.0))
    out = df.groupBy("t").agg(fx.weighted_mean("x", "w").alias("a"),
                              fx.weighted_mean("x", "w", "propagate").alias("b"))
    assert rows(out.na.fill(-1.0), "t", "a", "b") == [(1, 1.0, -1.0), (2, 5.0, 5.0)]


def test_zero_catch_years_keep_a_temperature(frame):
    df = frame("year int, t double, c double", (1, 2.0, 0.0), (1, 4.0, math.e), (2, 1.0, 0.0))
    out = {r.year: r for r in spatial.temperature_of_occupancy(df, "t", "c", ["year"]).collect()}
    assert out[1].occupied_temp == 4.0 and out[1].raw_temp == 3.0
    assert out[2].occupied_temp is None
    literal = spatial.temperature_of_occupancy(df, "t", "c", ["year"], "propagate")
    assert {r.year: r.occupied_temp for r in literal.collect()}[1] is None


def test_widths_round_half_to_even_and_labels_keep_half_missing(frame):
    df = frame("sex int, cw double", (1, 2.5), (1, 3.5), (None, 7.0), (2, None), (None, None))
    out = [tuple(r) for r in df.select(
        fx.width_bin_1mm().alias("b"), fx.class_label("sex", fx.width_bin_1mm()).alias("l")).collect()]
    assert out == [(2.0, "1_2"), (4.0, "1_4"), (7.0, "NA_7"), (None, "2_NA"), (None, None)]


def test_class_gaps_and_missing_inputs(frame):
    df = frame("sex int, cw double, clutch int", (1, 31.0, 0), (1, 60.0, 0), (1, 60.5, 0), (1, 61.0, 0),
               (1, 90.5, 0), (1, 120.0, 0), (1, 121.0, 0), (2, None, 1), (2, 5.0, 0), (2, 5.0, None), (None, 50.0, 1))
    labels = [r[0] for r in df.select(fx.size_sex_class()).collect()]
    assert labels == [None, "male31to60", None, None, None, "male91to120", None,
                      "mature_female", "immature_female", None, None]


def test_d95_leaves_out_the_station_that_crosses(frame):
    df = frame("year int, station int, z double", (1, 1, 90.0), (1, 2, 5.0), (1, 3, 5.0), (2, 1, 99.0), (2, 2, 1.0),
               (3, 1, 1.0), (3, 2, None), (4, 1, 0.0), (4, 2, 0.0))
    out = rows(spatial.d95_members(df, "z", ["year"]).na.fill(-1.0).withColumn(
        "d95", F.coalesce(F.col("d95").cast("int"), F.lit(-1))), "year", "station", "d95")
    assert out == [(1, 1, 1), (1, 2, 1), (1, 3, 0), (2, 1, 0), (2, 2, 0),
                   (3, 1, -1), (3, 2, -1), (4, 1, -1), (4, 2, -1)]
    area = spatial.d95_area(spatial.d95_members(df, "z", ["year"]), ["year"])
    assert rows(area, "year", "d95_area") == [(1, 802), (2, 0), (3, 0), (4, 0)]


def test_count_mode_is_fooled_by_double_hauls(frame):
    df = frame("station string, year int, v double", ("A", 1, 1.0), ("A", 1, 1.0), ("B", 1, 1.0), ("B", 2, 1.0),
               ("C", 1, 1.0), ("C", 2, 1.0), ("C", 2, 1.0), ("D", 1, 1.0), ("D", 2, None))
    count = {r[0] for r in panel.complete_series(df, "station", "year", "v").collect()}
    every = {r[0] for r in panel.complete_series(df, "station", "year", "v", "every_period").collect()}
    assert count == {"A", "B"}
    assert every == {"B", "C", "D"}
    assert {r[0] for r in panel.crowded_series(df, "station", "year").collect()} == {"C"}
    assert panel.find_duplicates(df, ["station", "year"]).count() == 4
    assert panel.balanced_panel(df, "station", "year", "v", n_periods=3).count() == 3


def test_collapse_duplicates_averages_and_stays_strict(frame):
    df = frame("s string, y int, a double, b double", ("A", 1, 1.0, 2.0), ("A", 1, 3.0, None), ("B", 1, 5.0, 6.0))
    assert rows(prep.collapse_duplicates(df, ["s", "y"]).na.fill(-1.0), "s", "a", "b") == [
        ("A", 2.0, -1.0), ("B", 5.0, 6.0)]


def test_backfill_replaces_the_target_period(frame):
    df = frame("year int, s string", (2017, "a"), (2018, "x"), (2019, "b"), (2019, "c"))
    assert rows(prep.backfill_period(df, 2019, 2018), "year", "s") == [
        (2017, "a"), (2018, "b"), (2018, "c"), (2019, "b"), (2019, "c")]


def test_densify_fills_cells(frame):
    df = frame("k int, c string, v double", (1, "a", 1.0), (1, "b", None), (2, None, None), (3, "b", 4.0))
    assert rows(prep.densify(df, ["k"], "c", "v"), "k", "c", "v") == [
        (1, "a", 1.0), (1, "b", 0.0), (2, "a", 0.0), (2, "b", 0.0), (3, "a", 0.0), (3, "b", 4.0)]
    assert prep.densify(df, ["k"], "c", "v", categories=["a", "b", "z"]).count() == 9


def test_cold_pool_without_a_cold_year_and_exclusion(frame):
    temps = frame("year int, station string, t double", (1, "a", 1.0), (1, "b", 1.5), (2, "a", 3.0))
    out = frame("station string", ("b",))
    assert rows(spatial.cold_pool_area(temps, "t", out), "year", "cpa") == [(1, 401)]
    hauls = frame("year int, station string, lat double", (1, "a", 58.0), (1, "b", 60.0))
    assert rows(spatial.cold_pool_center(temps, hauls, "t"), "year", "cp_cod") == [(1, 59.0)]


def test_factor_regression_reports_both_errors(frame):
    df = frame("g int, f string, y double", *[(1, f, v) for f, v in
               (("a", 1.0), ("a", 3.0), ("b", 4.0), ("b", 6.0), ("b", 8.0))])
    out = {r.f: r for r in series.factor_regression(df, "y", "f", ["g"], "a").collect()}
    s2 = (2 + 8) / 3
    assert out["a"].coef == 2.0 and out["b"].coef == pytest.approx(4.0) and out["b"].estimate == 6.0
    assert out["a"].se_coef == pytest.approx(math.sqrt(s2 / 2)) == out["a"].se_mean
    assert out["b"].se_mean == pytest.approx(math.sqrt(s2 / 3))
    assert out["b"].se_coef == pytest.approx(math.sqrt(s2 * (1 / 2 + 1 / 3)))


def test_undefined_collocation_is_one(frame):
    one = frame("g int, xcg double, ycg double, inertia double", (1, 1.0, 1.0, 0.0), (2, 0.0, 0.0, 2.0), (3, None, None, None))
    two = frame("g int, xcg double, ycg double, inertia double", (1, 1.0, 1.0, 0.0), (2, 2.0, 0.0, 2.0), (3, 1.0, 1.0, 1.0))
    assert rows(spatial.collocation_index(one, two, ["g"]), "g", "gic") == [(1, 1.0), (2, 0.5), (3, 1.0)]


def test_spreading_and_equivalent_area_are_different_formulas(frame):
    df = frame("g int, z double, w double", (1, 1.0, 1.0), (1, 3.0, 2.0), (1, 0.0, 5.0))
    q = 7.0
    assert spatial.equivalent_area(df, "z", "w", ["g"]).first()[1] == pytest.approx(q * q / 19)
    assert spatial.spreading_area(df, "z", "w", ["g"]).first()[1] == pytest.approx(((0 + 1) * 1 + (1 + 7) * 2) / q)
    curve = rows(spatial.spreading_curve(df, "z", "w", ["g"]), "area", "left")
    assert curve == [(0.0, 1.0), (2.0, pytest.approx(1 / 7)), (3.0, 0.0), (8.0, 0.0)]


def test_all_zero_group(frame):
    df = frame("g int, x double, y double, z double, w double, station int", (1, 1.0, 1.0, 0.0, 1.0, 1), (1, 2.0, 2.0, 0.0, 1.0, 2))
    centre = spatial.anisotropy(df, "x", "y", "z", "w", ["g"]).first()
    assert centre.xcg is None and centre.inertia is None and centre.iso is None
    assert spatial.equivalent_area(df, "z", "w", ["g"]).first()[1] is None
    assert spatial.positive_area(df, "z", "w", ["g"]).first()[1] == 0.0
    assert spatial.shannon_diversity(df, "z", ["g"]).first()[1] == 0.0
    out = patches.spatial_patches(df, "x", "y", "z", "w", ["g"], 1.0)
    assert {r.patch for r in out.collect()} == {0}


def test_null_patches_and_the_single_one(frame):
    df = frame("g int, x double, y double, z double, w double, station int",
               (1, 0.0, 0.0, 5.0, 1.0, 1), (1, 9.0, 9.0, 0.0, 1.0, 2))
    merged = patches.spatial_patches(df, "x", "y", "z", "w", ["g"], 1.0)
    kept = patches.spatial_patches(df, "x", "y", "z", "w", ["g"], 1.0, merge_single_null_patch=False)
    assert rows(merged, "station", "patch") == [(1, 1), (2, 0)]
    assert rows(kept, "station", "patch") == [(1, 1), (2, 2)]


def test_patch_counts_against_highest_number(frame):
    df = frame("g int, x double, y double, z double, w double, patch int",
               (1, 0.0, 0.0, 60.0, 1.0, 1), (1, 9.0, 0.0, 5.0, 1.0, 2), (1, 18.0, 0.0, 35.0, 1.0, 3), (1, 30.0, 0.0, 0.0, 1.0, 0))
    out = patches.patch_summary(df, ["g"]).orderBy("patch").collect()
    assert {(r.n_patches_over, r.max_patch_over) for r in out} == {(2, 3)}
    assert [r.pabun for r in out] == [0.0, 60.0, 5.0, 35.0]
    assert out[0].xg is None and out[0].parea == 0.25


def test_position_deviation_signed_and_absolute(frame):
    df = frame("station int, year int, lon double, lat double", (1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, -4.0, 0.0))
    r = panel.position_deviation(df).first()
    assert (r.lon_max, r.lon_abs) == (2.0, 3.0)
    two = frame("station int, year int, lon double, lat double", (1, 1, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 3.0, 0.0))
    assert panel.station_position(two).first().lon == 1.5
    assert panel.station_position(two, two_level=False).first().lon == 1.0


def test_gaps_are_reported_and_raised(frame):
    df = frame("s string, y int, v double", ("A", 1, 1.0), ("A", 2, 1.0), ("B", 1, 1.0), ("B", 2, None))
    assert rows(panel.gaps(df, "s", "y", "v"), "s", "y") == [("B", 2)]
    with pytest.raises(ValueError):
        panel.assert_no_gaps(df, "s", "y", "v")


def test_region_rules(frame):
    df = frame("cruise int, station string", (201001, "A"), (201002, "B"), (201001, "NBS-1"), (None, "C"))
    assert [r[0] for r in df.select(fx.region_from_cruise()).collect()] == ["EBS", "NBS", "NBS", None]


def test_projection_identity_and_inverse(frame):
    df = frame("lon double, lat double", (-170.0, 58.0), (-165.5, 60.25))
    x, y = fx.project_nm("lon", "lat", None, 0, 0)
    assert [tuple(r) for r in df.select(x, y).collect()] == [(-170.0, 58.0), (-165.5, 60.25)]
    for mode in ("mean", "cosine", 0.4):
        x, y = fx.project_nm("lon", "lat", mode, -172.0, 57.0)
        lon, lat = fx.unproject_nm("x", "y", mode, -172.0, 57.0)
        back = df.select(x.alias("x"), y.alias("y")).select(lon, lat).collect()
        for got, want in zip(back, df.collect()):
            assert tuple(got) == pytest.approx(tuple(want))
    first = df.select(fx.project_nm("lon", "lat", "cosine", -172.0, 57.0)[0]).first()[0]
    assert first == pytest.approx(2.0 * 60 * math.cos(math.radians(58.0)))


def test_empty_inputs(frame, spark):
    empty = spark.createDataFrame([], CPUE)
    assert estimate.abundance_naive(empty).count() == 0
    points = spark.createDataFrame([], "year int, station int, lon double, lat double, cpue double, w double")
    assert spatial.d95_members(points, "cpue", ["year"]).count() == 0
    assert spatial.inertia(points, "lon", "lat", "cpue", "w", ["year"]).count() == 0
    assert patches.spatial_patches(points, "lon", "lat", "cpue", "w", ["year"], 1.0).count() == 0
