"""Squares split by content, and sums over pairs of positions without a list of them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlframe.operators import series, tiles


def listed(rows, max_dist, bins):
    """(group, bin) -> pairs, mean distance, mean half square, over every pair of rows."""
    out = {}
    for g in {r[0] for r in rows}:
        own = np.array([r[1:] for r in rows if r[0] == g], float)
        i, j = np.triu_indices(len(own), 1)
        d = np.hypot(own[i, 0] - own[j, 0], own[i, 1] - own[j, 1])
        h = np.square(own[i, 2] - own[j, 2]) / 2
        use = d <= max_dist
        k = np.maximum(np.ceil(np.round(d[use] / (max_dist / bins), 9)), 1)
        for b in np.unique(k):
            at = k == b
            out[g, int(b)] = (int(at.sum()), d[use][at].mean(), h[use][at].mean())
    return out


def some_rows(n, seed, crowd=0.4, scale=0.05):
    """A share of all positions crowded in one corner, some rows at one position, two groups and null."""
    r = np.random.default_rng(seed)
    rows = []
    for g in ("a", None):
        x, y = r.uniform(-3, 3, (2, n))
        inner = r.random(n) < crowd
        x[inner], y[inner] = 1 + scale * r.random(inner.sum()), -2 + scale * r.random(inner.sum())
        z = np.sin(x) + r.normal(size=n) * 0.2 + 100
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(x, y, z)]
        rows += [(g, float(x[0]), float(y[0]), 3.5), (g, float(x[0]), float(y[0]), 4.5)]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "g string, lon double, lat double, r double")


def check(df, rows, max_dist, bins, most):
    got = series.variogram_binned(df, "r", ["g"], max_dist, bins, most=most).collect()
    expected = listed(rows, max_dist, bins)
    assert {(r.g, r.bin) for r in got} == set(expected)
    for r in got:
        n, d, h = expected[r.g, r.bin]
        assert r.n_pairs == n
        assert math.isclose(r.distance, d, rel_tol=1e-9) and math.isclose(r.semivariance, h, rel_tol=1e-9)


@pytest.mark.parametrize("max_dist, bins, most", [(1.0, 7, 256), (1.0, 7, 8), (20.0, 5, 16)])
def test_variogram_equals_every_pair(spark, max_dist, bins, most):
    rows = some_rows(300, 1)
    check(frame_of(spark, rows), rows, max_dist, bins, most)


def test_a_limit_as_wide_as_the_map_sums_far_squares_at_once(spark):
    rows = some_rows(600, 2, crowd=0.5)
    df = frame_of(spark, rows)
    check(df, rows, 12.0, 3, 8)
    spots = series._spots(df, "r", ["g"], "lon", "lat")
    paired = tiles.paired_tiles(spots, ["g"], 12.0, 4.0, 8)
    total = sum(n for n, _, _ in listed(rows, 12.0, 3).values())
    assert paired.sums.agg(F.sum("pairs")).first()[0] > 0.2 * total


def test_without_groups(spark):
    rows = [("a", *r[1:]) for r in some_rows(100, 3)]
    got = series.variogram_binned(frame_of(spark, rows).drop("g"), "r", [], 2.0, 4, most=16).collect()
    expected = listed(rows, 2.0, 4)
    assert {r.bin: r.n_pairs for r in got} == {b: v[0] for (_, b), v in expected.items()}


def test_pairs_are_those_listed_whatever_the_leaves(spark):
    rows = some_rows(200, 4)
    df = frame_of(spark, rows)
    names = ["g", "x_a", "y_a", "x_b", "y_b", "n_pairs"]
    got = {most: {tuple(r[c] for c in names): (r.distance, r.semivariance) for r in
                  series.location_pairs(df, "r", ["g"], 1.5, most=most).collect()} for most in (1000, 10)}
    assert got[10] == got[1000]
    assert sum(k[-1] for k in got[10]) == sum(n for n, _, _ in listed(rows, 1.5, 1).values())
    assert all(k[1:3] <= k[3:5] for k in got[10])


def test_no_leaf_above_the_stated_count_with_a_third_of_the_positions_in_one_square(spark):
    rows = spark.range(3000).selectExpr(
        "'a' AS g", "IF(id % 3 = 0, 5 + id * 1e-7, id * 0.01) AS x", "IF(id % 3 = 0, 5 + (id * 7919 % 3000) * 1e-7, id % 53) AS y")
    placed, deepest = tiles.split_positions(rows, ["g"], 10.0, 64)
    key = ["g", *tiles.PLACE]
    counts = placed.groupBy(*key).count()
    assert counts.agg(F.max("count")).first()[0] <= 64 and counts.agg(F.sum("count")).first()[0] == 3000
    assert deepest > 10 and placed.count() == 3000


def test_positions_closer_than_the_smallest_square(spark, monkeypatch):
    monkeypatch.setattr(tiles, "DEPTH", 4)
    rows = [("a", 1.0 + i * 1e-12, 2.0, float(i)) for i in range(40)] + [("a", 3.0 + i, 2.0, 0.0) for i in range(9)]
    check(frame_of(spark, rows), rows, 5.0, 2, 4)


def test_nothing_to_pair(spark):
    df = frame_of(spark, [("a", 1.0, 2.0, 3.0), ("b", None, 2.0, 1.0), ("b", 1.0, 2.0, None)])
    assert series.variogram_binned(df, "r", ["g"], 1.0).count() == 0
    assert series.location_pairs(df, "r", ["g"], 1.0).count() == 0
    assert series.variogram_binned(df.limit(0), "r", ["g"], 1.0).count() == 0


def test_taylor_sums_equal_listed_distances():
    r = np.random.default_rng(0)
    a, b = r.uniform(-1, 1, (2, 2, 50))
    far = 2 * math.sqrt(2) / tiles.NEAR_SHARE
    for angle in (0.0, 0.7, 2.0, 4.5):
        dx, dy = far * math.cos(angle), far * math.sin(angle)
        mu = [np.array([[(p[0] ** i * p[1] ** j).sum() for i, j in tiles.POWERS]]) for p in (a, b)]
        got = tiles._sum_of_distances(np.array([dx]), np.array([dy]), np.ones(1), np.ones(1), *mu)[0]
        expected = np.hypot(b[0][None] + dx - a[0][:, None], b[1][None] + dy - a[1][:, None]).sum()
        assert abs(got / expected - 1) < 1e-10
