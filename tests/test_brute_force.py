"""Operators without an SQL equivalent, and exact algorithms, against direct computation."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trawlframe.operators import (
    bootstrap, grid, impute, models, ordered, pairs, patches, pca, series, spatial,
)


def points(seed, n, groups=2, zero=0.4, digits=2):
    rnd = random.Random(seed)
    return [(g, i, round(rnd.uniform(0, 10), digits), round(rnd.uniform(0, 6), digits),
             0.0 if rnd.random() < zero else round(rnd.expovariate(1), 3), 1.0 + (i % 3) * 0.5)
            for g in range(groups) for i in range(n)]


COLS = "g int, station int, x double, y double, z double, w double"


def greedy_patches(rows, limit):
    """The plain sequential rule."""
    rows = sorted(rows, key=lambda r: (-r[4], r[1]))
    sums, out = [], {}
    for _, s, x, y, z, w in rows:
        q = z * w
        best = None
        for k, (sq, sx, sy) in enumerate(sums):
            if sq > 0:
                d = math.hypot(sx / sq - x, sy / sq - y)
                if d < limit and (best is None or d < best[0]):
                    best = (d, k)
        if best is None and q <= 0:
            out[s] = 0
            continue
        if best is None:
            sums.append([0.0, 0.0, 0.0])
            best = (0.0, len(sums) - 1)
        k = best[1]
        sums[k] = [sums[k][0] + q, sums[k][1] + q * x, sums[k][2] + q * y]
        out[s] = k + 1
    return out


@pytest.mark.parametrize("limit", [0.7, 1.5, 4.0])
def test_patches_follow_the_sequential_rule(spark, limit):
    data = points(3, 150)
    got = patches.spatial_patches(spark.createDataFrame(data, COLS), "x", "y", "z", "w", ["g"], limit)
    got = {(r.g, r.station): r.patch for r in got.collect()}
    for g in (0, 1):
        want = greedy_patches([r for r in data if r[0] == g], limit)
        assert {s: got[(g, s)] for s in want} == want


def test_running_totals_over_many_slices(spark):
    rnd = random.Random(5)
    data = [(1 if i % 3 else 2, rnd.choice([0.5, 1.0, 2.0, 7.25]), i) for i in range(4000)]
    df = spark.createDataFrame(data, "g int, v double, id int").repartition(7)
    out = ordered.running_totals(df, ["g"], [F.col("v").desc(), F.col("id")], {"run": F.col("v"), "n": F.lit(1)})
    got = {r.id: (r.run, r.n, r.run_total) for r in out.collect()}
    for g in (1, 2):
        rows = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        run = np.cumsum([r[1] for r in rows])
        for k, r in enumerate(rows):
            assert got[r[2]] == pytest.approx((run[k], k + 1, run[-1]))


def test_running_totals_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 2), (1, 4.0, 3)], "g int, v double, id int")
    out = ordered.running_totals(df, ["g"], [F.col("id")], {"run": F.col("v")})
    assert sorted(r.run for r in out.collect()) == [1.0, 3.0, 4.0]


def test_quantiles_equal_numpy(spark):
    rnd = np.random.default_rng(1)
    values = np.round(rnd.normal(size=999), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ordered.quantiles(df, "v", [0.0, 0.025, 0.5, 0.9, 1.0], []).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0, 0.025, 0.5, 0.9, 1])))


def test_weighted_quantile_between_steps_and_below_the_first(spark):
    df = spark.createDataFrame([(10.0, 1.0), (20.0, 1.0), (30.0, 2.0)], "x double, w double")
    got = ordered.weighted_quantiles(df, "x", "w", [0.1, 0.25, 0.375, 0.75, 1.0], []).first()
    assert list(got) == pytest.approx([10.0, 10.0, 15.0, 25.0, 30.0])


def brute_nearest(data, node):
    d = [(math.hypot(r[2] - node[0], r[3] - node[1]), r[2], r[3]) for r in data]
    least = min(d)[0]
    return {(x, y) for dist, x, y in d if dist == pytest.approx(least, abs=1e-12)}, least


@pytest.mark.parametrize("n", [7, 23])
def test_unlimited_nearest_point(spark, n):
    data = points(8, 120, groups=2, digits=1)
    df = spark.createDataFrame(data, COLS)
    near = grid.nearest_point_grid(df, 0.4, n, ["g"], max_dist=None).collect()
    nodes = {(r.g, r.ix, r.iy): (r.x, r.y) for r in grid.regular_grid(df, 0.4, n, ["g"]).collect()}
    found = {}
    for r in near:
        found.setdefault((r.g, r.ix, r.iy), set()).add((r.x, r.y))
    assert set(found) == set(nodes)
    for key, node in nodes.items():
        want, _ = brute_nearest([d for d in data if d[0] == key[0]], node)
        assert found[key] <= want and found[key]


def test_influence_areas_add_up_to_the_nodes_reached(spark):
    data = points(9, 60, groups=1)
    df = spark.createDataFrame(data, COLS)
    near = grid.nearest_point_grid(df, 0.5, 30, ["g"])
    cells = near.select("ix", "iy", "cell_area").distinct()
    total = cells.agg(F.sum("cell_area")).first()[0]
    ties = near.count() - cells.count()
    areas = grid.influence_area(df, 0.5, 30, ["g"]).agg(F.sum("influence_area")).first()[0]
    assert areas == pytest.approx(total + ties * cells.first().cell_area)


def test_centre_moves_and_inertia_stays_under_translation(spark):
    data = points(11, 80, groups=1)
    moved = [(g, s, x - 500.25, y + 77.5, z, w) for g, s, x, y, z, w in data]
    a, b = [spatial.anisotropy(spark.createDataFrame(d, COLS), "x", "y", "z", "w", ["g"]).first()
            for d in (data, moved)]
    assert b.xcg == pytest.approx(a.xcg - 500.25) and b.ycg == pytest.approx(a.ycg + 77.5)
    assert b.inertia == pytest.approx(a.inertia) == pytest.approx(a.imax + a.imin)
    q = np.array([r[4] * r[5] for r in data])
    x, y = np.array([r[2] for r in data]), np.array([r[3] for r in data])
    cov = np.cov(np.vstack([x, y]), aweights=q, bias=True)
    assert sorted([a.imin, a.imax]) == pytest.approx(sorted(np.linalg.eigvalsh(cov)))


def test_single_point_and_line_have_flat_axes(spark):
    one = spark.createDataFrame([(1, 1, -177.3, 56.7, 2.0, 1.0)], COLS)
    r = spatial.anisotropy(one, "x", "y", "z", "w", ["g"]).first()
    assert (r.inertia, r.imax, r.imin, r.iso) == (0.0, 0.0, 0.0, None)
    line = spark.createDataFrame([(1, 1, 0.0, 2.0, 1.0, 1.0), (1, 2, 4.0, 2.0, 1.0, 1.0)], COLS)
    r = spatial.inertia_axes(line, "x", "y", "z", "w", ["g"]).first()
    assert r.xaxe1 == pytest.approx([0.0, 4.0]) and r.yaxe1 == pytest.approx([2.0, 2.0])
    assert r.xaxe2 == pytest.approx([2.0, 2.0]) and r.yaxe2 == pytest.approx([2.0, 2.0])


def panel_frame(spark, seed=2, t=12, s=40, gaps=0.15):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(t, 3))
    values = base @ rnd.normal(size=(3, s)) + 0.3 * rnd.normal(size=(t, s))
    mask = rnd.random((t, s)) < gaps
    rows = [(1990 + i, j, None if mask[i, j] else float(values[i, j])) for i in range(t) for j in range(s)]
    return spark.createDataFrame(rows, "t int, s int, v double"), np.where(mask, np.nan, values)


@pytest.mark.parametrize("block", [7, 1000])
def test_block_correlations_equal_pandas(spark, block):
    df, values = panel_frame(spark)
    want = pd.DataFrame(values).corr()
    got = {(r.series, r.other): r.r for r in pairs.pairwise_corr(df, "t", "s", "v", block).collect()}
    assert len(got) == 40 * 39 // 2
    for (a, b), r in got.items():
        assert a < b and r == pytest.approx(want.iloc[a, b])
    cov = {(r.series, r.other): r.cov for r in pairs.pairwise_cov(df, "t", "s", "v", block).collect()}
    full = pd.DataFrame(values).cov()
    assert len(cov) == 40 * 41 // 2
    assert all(c == pytest.approx(full.iloc[a, b]) for (a, b), c in cov.items())


@pytest.mark.parametrize("block", [6, 1000])
def test_best_predictors_with_ties_equal_pandas_ranks(spark, block):
    df, values = panel_frame(spark, gaps=0.0)
    values = values.copy()
    values[:, 10:16] = values[:, [0]] * np.array([1, 2, 3, -1, -2, 5])  # seven equal strengths
    rows = [(i, j, float(values[i, j])) for i in range(12) for j in range(40)]
    df = spark.createDataFrame(rows, "t int, s int, v double")
    distance = (1 - pd.DataFrame(values).corr().abs()).round(9)
    for k in (3, 5, 20):
        got = {(r.series, r.predictor): r.rank for r in pairs.best_predictors(df, "t", "s", "v", k, block).collect()}
        ranks = distance.rank(axis=1, method="average")
        want = {(a, b): ranks.iloc[a, b] for a in range(40) for b in range(40)
                if a != b and ranks.iloc[a, b] <= k}
        assert got == want


def test_imputation_recovers_a_common_signal_and_its_noise_is_reproducible(spark):
    t, s = 20, 12
    signal = np.sin(np.arange(t))
    rows = [(i, j, None if (i + j) % 9 == 0 else float((j + 1) * signal[i] + j)) for i in range(t) for j in range(s)]
    df = spark.createDataFrame(rows, "t int, s int, v double")
    out = impute.impute_panel(df, "t", "s", "v", k=9).collect()
    assert len(out) == sum((i + j) % 9 == 0 for i in range(t) for j in range(s))
    for r in out:
        assert r.v == pytest.approx((r.s + 1) * signal[r.t] + r.s, abs=1e-6)
    noisy, _ = panel_frame(spark)
    first = impute.impute_panel(noisy, "t", "s", "v", k=5, m=3, seed=4).collect()
    again = impute.impute_panel(noisy.repartition(5), "t", "s", "v", k=5, m=3, seed=4).collect()
    key = lambda r: (r.t, r.s, r.imputation)
    assert [r.v for r in sorted(first, key=key)] == pytest.approx([r.v for r in sorted(again, key=key)])
    complete = impute.complete_panels(noisy, impute.impute_panel(noisy, "t", "s", "v", 5, m=3), "t", "s", "v")
    assert complete.count() == 3 * 12 * 40


def test_spatial_pca_equals_the_covariance_route(spark):
    df, values = panel_frame(spark, gaps=0.0, t=9, s=30)
    anomalies = values - values.mean(axis=1, keepdims=True)
    eigen, vectors = np.linalg.eigh(np.cov(anomalies, rowvar=False))
    v = vectors[:, -1]
    score = anomalies @ v
    score = (score - score.mean()) / score.std(ddof=1)
    if np.polyfit(np.arange(9), score, 1)[0] < 0:
        v, score = -v, -score
    out = pca.spatial_pca(df, "t", "s", "v")
    shares = {r.component: r.share for r in out["shares"].collect()}
    assert [shares[k] for k in range(1, 6)] == pytest.approx(list(eigen[::-1][:5] / eigen.sum()))
    assert [r.loading for r in out["loadings"].orderBy("s").collect()] == pytest.approx(list(v), abs=1e-9)
    assert [r.pc for r in out["scores"].orderBy("t").collect()] == pytest.approx(list(score), abs=1e-9)


def test_spatial_pca_keeps_groups_apart(spark):
    df, _ = panel_frame(spark, gaps=0.0, t=6, s=10)
    both = df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit("b")).withColumn("v", F.col("v") * 2))
    out = pca.spatial_pca(both, "t", "s", "v", ["g"])
    scores = {(r.g, r.t): r.pc for r in out["scores"].collect()}
    assert len(scores) == 12
    assert all(scores[("a", t)] == pytest.approx(scores[("b", t)]) for _, t in scores)
    assert out["shares"].filter("component = 1").select(F.round("share", 9)).distinct().count() == 1


def test_spatial_pca_of_mixed_groups_in_small_batches(spark):
    """Groups of one batch stay apart, batches of one group add up; NULL is a group."""
    df, _ = panel_frame(spark, gaps=0.0, t=6, s=40)
    copies = [df.withColumns({"g": F.lit(g).cast("int"), "v": F.col("v") + 1e4 * (g or 0)}) for g in (1, 2, None)]
    both = copies[0].unionByName(copies[1]).unionByName(copies[2])
    alone = pca.spatial_pca(df, "t", "s", "v")
    want = [r.pc for r in alone["scores"].orderBy("t").collect()]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        rows = pca.spatial_pca(both, "t", "s", "v", ["g"])["scores"].collect()
    finally:
        spark.conf.set(size, before)
    for g in (1, 2, None):
        assert [r.pc for r in sorted(rows, key=lambda r: r.t) if r.g == g] == pytest.approx(want, abs=1e-7)


def test_gap_pca_equals_pairwise_covariances(spark):
    df, values = panel_frame(spark, t=15, s=8)
    frame = pd.DataFrame(values)
    anomalies = frame.sub(frame.mean(axis=1), axis=0)
    eigen, vectors = np.linalg.eigh(anomalies.cov().to_numpy())
    order = np.argsort(np.abs(eigen))[::-1]
    v = vectors[:, order[0]]
    score = anomalies.fillna(0).to_numpy() @ v
    score = (score - score.mean()) / score.std(ddof=1)
    if np.polyfit(np.arange(15), score, 1)[0] < 0:
        v, score = -v, -score
    out = pca.gap_pca(df, "t", "s", "v")
    assert [r.loading for r in out["loadings"].orderBy("s").collect()] == pytest.approx(list(v), abs=1e-9)
    assert [r.pc for r in out["scores"].orderBy("t").collect()] == pytest.approx(list(score), abs=1e-9)


def test_standardized_pca_equals_the_correlation_route(spark):
    df, values = panel_frame(spark, gaps=0.0, t=14, s=6)
    eigen, vectors = np.linalg.eigh(np.corrcoef(values, rowvar=False))
    out = pca.standardized_pca(df, "t", "s", "v")
    shares = {r.component: r.share for r in out["shares"].collect()}
    assert [shares[k] for k in (1, 2, 3)] == pytest.approx(list(eigen[::-1][:3] / 6))
    for k in (1, 2, 3):
        v = vectors[:, -k]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        got = [r.loading for r in out["loadings"].filter(F.col("component") == k).orderBy("s").collect()]
        assert got == pytest.approx(list(v), abs=1e-8)


def test_variogram_counts_every_pair_at_shared_positions(spark):
    rnd = random.Random(6)
    data = [(1, float(rnd.randrange(5)), float(rnd.randrange(4)), rnd.random()) for _ in range(60)]
    df = spark.createDataFrame(data, "g int, lon double, lat double, r double")
    out = series.variogram_binned(df, "r", ["g"], 2.0, 4).collect()
    want = {}
    for i in range(60):
        for j in range(i):
            d = math.hypot(data[i][1] - data[j][1], data[i][2] - data[j][2])
            if d <= 2.0:
                b = max(1, math.ceil(round(d / 0.5, 9)))
                want.setdefault(b, []).append((d, (data[i][3] - data[j][3]) ** 2 / 2))
    assert {r.bin: r.n_pairs for r in out} == {b: len(v) for b, v in want.items()}
    for r in out:
        assert r.semivariance == pytest.approx(np.mean([h for _, h in want[r.bin]]))
        assert r.distance == pytest.approx(np.mean([d for d, _ in want[r.bin]]))


def test_bootstrap_centres_on_the_mean_and_has_its_spread(spark):
    rnd = np.random.default_rng(3)
    values = rnd.exponential(size=400)
    df = spark.createDataFrame([(2018, "X", "m", i, float(v), 5.0) for i, v in enumerate(values)],
                               "year int, district string, size_sex string, station int, cpue double, total_area double")
    for method in ("index", "poisson"):
        means = np.array([r.mean_cpue for r in bootstrap.resampled_means(df, 1500, 9, method=method).collect()])
        assert len(means) == 1500 and len(set(means)) > 1490
        assert means.mean() == pytest.approx(values.mean(), abs=0.01)
        assert means.std() == pytest.approx(values.std() / 20, rel=0.1)


def test_bootstrap_does_not_depend_on_partitions_or_the_join(spark, monkeypatch):
    df = spark.createDataFrame([(2018, "X", "m", i, float(i % 7), 5.0) for i in range(50)],
                               "year int, district string, size_sex string, station int, cpue double, total_area double")
    one = bootstrap.resampled_means(df.coalesce(1), 20, 1).orderBy("rep").collect()
    monkeypatch.setattr(bootstrap, "BROADCAST_VALUES", 0)
    many = bootstrap.resampled_means(df.repartition(11), 20, 1).orderBy("rep").collect()
    assert [r.mean_cpue for r in one] == pytest.approx([r.mean_cpue for r in many])


def test_delta_model_recovers_its_coefficients(spark):
    rnd = np.random.default_rng(12)
    n = 3000
    temp, depth, day = rnd.normal(3, 2, n), rnd.normal(4, 0.5, n), rnd.normal(180, 20, n)
    lat, lon, year = rnd.uniform(55, 62, n), rnd.uniform(-178, -160, n), rnd.integers(2010, 2014, n)
    z = (temp - temp.mean()) / temp.std(ddof=1)
    present = rnd.random(n) < 1 / (1 + np.exp(-(0.5 + 1.2 * z)))
    mean = 1 / (0.5 + 0.05 * (year - 2010))
    dens = np.where(present, rnd.gamma(5.0, mean / 5.0), 0.0)
    df = spark.createDataFrame(pd.DataFrame({
        "year": year.astype("int32"), "lat": lat, "lon": lon, "bottom_temp": temp,
        "logdepth": depth, "julian": day, "abund": dens}))
    first = models.fit_presence(df)
    coef = {r.term: r.estimate for r in first.coefficients(spark).collect()}
    assert coef["bottom_temp"] == pytest.approx(1.2, abs=0.25)
    assert abs(coef["julian"]) < 0.2
    second = models.fit_density(df)
    coef = {r.term: r.estimate for r in second.coefficients(spark).collect()}
    assert coef["year_2013"] == pytest.approx(0.15, abs=0.08)
    years = models.shared_years(df, df.filter("abund > 0"))
    out = models.predict_delta(models.prediction_grid(df, years, 20), first, second)
    assert out.count() == 80 and out.filter("clipped").count() == 0
    r = out.agg(F.min("predbin"), F.max("predbin"), F.min("pred")).first()
    assert 0 < r[0] <= r[1] < 1 and r[2] > 0
