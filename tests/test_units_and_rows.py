"""Results follow the unit of their input, and no row is lost on the way."""

import math

import pytest

from trawlframe.operators.pairs import best_predictors, pairwise_corr
from trawlframe.operators.patches import patch_summary, spatial_patches
from trawlframe.operators.spatial import anisotropy, inertia

SCALES = [1e-9, 1.0, 1e9]


@pytest.mark.parametrize("scale", SCALES)
def test_correlation_does_not_depend_on_the_unit(frame, scale):
    rows = [(s, t, scale * v) for s, values in
            {"a": [1, 2, 4, 3], "b": [2, 4, 8, 6], "c": [5, 1, 2, 2], "flat": [0.1] * 4}.items()
            for t, v in enumerate(values)]
    panel = frame("s string, t int, v double", *rows)
    got = {(r.series, r.other): r.r for r in pairwise_corr(panel, "t", "s", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got["a", "b"] == pytest.approx(1) and got["a", "c"] == pytest.approx(-4 / math.sqrt(45))
    assert best_predictors(panel, "t", "s", "v", k=3).count() > 0


@pytest.mark.parametrize("scale", SCALES)
def test_moments_go_with_the_square_of_the_unit(frame, scale):
    rows = [("p", -178.0 * scale, 55.0 * scale, 1.0), ("p", -178.0 * scale + 2e-7 * scale, 55.0 * scale, 1.0),
            ("one", 3.0 * scale, 4.0 * scale, 2.0), ("one", 3.0 * scale, 4.0 * scale, 5.0),
            ("q", 0.0, 0.0, 1.0), ("q", 3.0 * scale, 4.0 * scale, 1.0)]
    df = frame("g string, x double, y double, z double", *rows)
    got = {r.g: r for r in anisotropy(df, "x", "y", "z", None, ["g"]).collect()}
    assert got["p"].inertia == pytest.approx(1e-14 * scale**2, rel=1e-3)
    assert got["p"].iso == pytest.approx(0, abs=1e-6)
    assert got["one"].inertia == 0 and got["one"].iso is None
    assert got["q"].inertia == pytest.approx(6.25 * scale**2)


def test_moments_without_a_window(frame, capsys):
    df = frame("g string, x double, y double", *[("a", i * 1.7, i % 7 * 0.3) for i in range(500)])
    got = inertia(df, "x", "y", None, None, ["g"])
    got.explain()
    assert "Window" not in capsys.readouterr().out
    xs, ys = [i * 1.7 for i in range(500)], [i % 7 * 0.3 for i in range(500)]
    mx, my = sum(xs) / 500, sum(ys) / 500
    assert got.first().inertia == pytest.approx(sum((x - mx) ** 2 + (y - my) ** 2 for x, y in zip(xs, ys)) / 500)
    assert math.isclose(inertia(df, "x", "y", None, None, []).first().inertia, got.first().inertia)


def test_equal_points_without_density_all_come_back(frame):
    rows = [("g", 1, 0.0, 0.0, 10.0, 1.0), ("g", 2, 500.0, 0.0, 0.0, 1.0), ("g", 2, 500.0, 0.0, 0.0, 1.0),
            ("g", 3, 10.0, 0.0, 0.0, 1.0), ("g", 3, 10.0, 0.0, 0.0, 1.0)]
    df = frame("g string, station int, x double, y double, z double, w double", *rows)
    got = spatial_patches(df, "x", "y", "z", "w", ["g"])
    assert got.count() == 5
    assert sorted((r.station, r.patch) for r in got.collect()) == [(1, 1), (2, 0), (2, 0), (3, 1), (3, 1)]
    shares = {r.patch: r.parea for r in patch_summary(got, ["g"]).collect()}
    assert shares == {0: pytest.approx(0.4), 1: pytest.approx(0.6)}


def test_components_of_many_series_with_gaps(spark):
    """More series than a matrix over all of them could hold, with four patterns of gaps."""
    import numpy as np
    from pyspark.sql import functions as F

    from trawlframe.operators.pca import gap_pca

    wide = spark.range(20000).select(
        "id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("t")).where("id % 4 = 0 or t <> id % 4")
    panel = wide.withColumn("v", F.sin(F.col("id") * 0.7 + F.col("t")) + 0.3 * F.col("t") * (F.col("id") % 5))
    out = gap_pca(panel, "t", "id", "v")
    loadings = {r.id: r.loading for r in out["loadings"].collect()}
    assert len(loadings) == 20000
    assert math.isclose(sum(v * v for v in loadings.values()), 1, rel_tol=1e-9)
    shares = [r.share for r in out["shares"].orderBy("component").collect()]
    assert len(shares) == 5 and shares == sorted(shares, reverse=True)
    few = panel.where("id < 60")
    values = np.full((6, 60), np.nan)
    for r in few.collect():
        values[r.t, r.id] = r.v
    values -= np.nanmean(values, axis=1, keepdims=True)
    cov = np.array([[np.cov(values[k, i], values[k, j])[0, 1] if (k := ~np.isnan(values[:, i] * values[:, j])).sum() > 1
                     else 0.0 for j in range(60)] for i in range(60)])
    sizes = np.sort(np.abs(np.linalg.eigvalsh(cov)))[::-1]
    got = [r.share for r in gap_pca(few, "t", "id", "v")["shares"].orderBy("component").collect()]
    assert got == pytest.approx(list(sizes[:5] / sizes.sum()))


@pytest.mark.parametrize("most", [8192, 16])
def test_components_of_series_that_each_have_their_own_gaps(spark, monkeypatch, most):
    import numpy as np

    from trawlframe.operators import pca

    monkeypatch.setattr(pca, "MAX_PATTERN_ROWS", most)  # 16: the matrix stays in blocks
    monkeypatch.setattr(pca, "COVARIANCE_BLOCK", 150 if most == 8192 else 25, raising=False)
    n, periods = (300, 40) if most == 8192 else (60, 10)
    rng = np.random.default_rng(5)
    values = rng.standard_normal((periods, n)) + 2 * np.outer(np.arange(periods) / 5, rng.standard_normal(n))
    values += 3 * np.outer(np.sin(np.arange(periods)), rng.standard_normal(n))
    values[rng.random(values.shape) < 0.3] = np.nan
    rows = [(k, i, float(values[k, i])) for k in range(periods) for i in range(n) if not np.isnan(values[k, i])]
    out = pca.gap_pca(spark.createDataFrame(rows, "t int, id int, v double"), "t", "id", "v")
    values -= np.nanmean(values, axis=1, keepdims=True)
    cov = np.array([[np.cov(values[k, i], values[k, j])[0, 1] if (k := ~np.isnan(values[:, i] * values[:, j])).sum() > 1
                     else 0.0 for j in range(n)] for i in range(n)])
    eigen, vectors = np.linalg.eigh(cov)
    order = np.argsort(np.abs(eigen))[::-1]
    sizes = np.abs(eigen[order])
    shares = out["shares"].orderBy("component").collect()
    assert [r.eigenvalue for r in shares] == pytest.approx(list(sizes[:5]))
    assert [r.share for r in shares] == pytest.approx(list(sizes[:5] / sizes.sum()), rel=1e-5)
    loadings = [r.loading for r in out["loadings"].orderBy("id").collect()]
    first = vectors[:, order[0]]
    assert loadings == pytest.approx(list(first * np.sign(first @ loadings)), abs=1e-7)


def test_default_origin_and_corner_stations(frame):
    from trawlframe.functions.scalars import project_nm, projection_origin
    from trawlframe.plans.temperature import temperature_indices

    df = frame("lon double, lat double", (-170.0, 55.0), (-168.0, 57.0), (None, 54.0))
    assert projection_origin(df, "lon", "lat") == (-170.0, 54.0)
    x, y = project_nm("lon", "lat", "mean", *projection_origin(df, "lon", "lat"))
    assert df.select(x.alias("x"), y.alias("y")).first().y == pytest.approx(60)
    assert projection_origin(df.limit(0), "lon", "lat") == (0.0, 0.0)

    pooled = frame("year int, station string, mean double", (2000, "QP2625", 1.0), (2000, "A-01", 1.0), (2000, "A-02", 3.0))
    hauls = frame("year int, station string, lat double, haul_type int, performance double",
                  (2000, "QP2625", 60.0, 3, 0.0), (2000, "A-01", 58.0, 3, 0.0))
    assert temperature_indices(pooled, hauls).first().cpa == 401


@pytest.mark.parametrize("n", [7, 70])
def test_components_with_vectors_in_tables_equal_numpy(spark, monkeypatch, n):
    """Several tiles of blocks, a start-over of the space, and fewer series than columns of it."""
    import numpy as np

    from trawlframe.operators import pca

    monkeypatch.setattr(pca, "MAX_PATTERN_ROWS", 4)
    monkeypatch.setattr(pca, "COVARIANCE_BLOCK", 8)
    periods, rng = 12, np.random.default_rng(11)
    values = rng.standard_normal((periods, n)) + 4 * np.outer(np.arange(periods), rng.standard_normal(n))
    values[rng.random(values.shape) < 0.25] = np.nan
    rows = [(k, i, float(values[k, i])) for k in range(periods) for i in range(n) if not np.isnan(values[k, i])]
    out = pca.gap_pca(spark.createDataFrame(rows, "t int, id int, v double"), "t", "id", "v", 2, all_sizes=False)
    values -= np.nanmean(values, axis=1, keepdims=True)
    cov = np.array([[np.cov(values[k, i], values[k, j])[0, 1] if (k := ~np.isnan(values[:, i] * values[:, j])).sum() > 1
                     else 0.0 for j in range(n)] for i in range(n)])
    eigen, vectors = np.linalg.eigh(cov)
    order = np.argsort(np.abs(eigen))[::-1][:2]
    shares = out["shares"].orderBy("component").collect()
    assert [r.eigenvalue for r in shares] == pytest.approx(list(np.abs(eigen[order])), rel=1e-9)
    assert [r.trace_share for r in shares] == pytest.approx(list(np.abs(eigen[order]) / np.trace(cov)), rel=1e-9)
    assert [r.share for r in shares] == [None, None]
    loadings = [r.loading for r in out["loadings"].orderBy("id").collect()]
    first = vectors[:, order[0]]
    assert loadings == pytest.approx(list(first * np.sign(first @ loadings)), abs=1e-9)
