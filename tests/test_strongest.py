"""The search for predictors against all pairs, and what it moves."""

import numpy as np
import pandas as pd
import pytest

from trawlframe.operators import impute, pairs, strongest


def made(seed, n, periods, share_missing, ties=True):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(periods, n)).cumsum(0) + 5
    if ties:
        values[:, 1::9] = 2 * values[:, [0]] + 1
        values[:, 2::31] = 4.0  # flat
    values[rng.random(values.shape) < share_missing] = np.nan
    return values


def frame_of(spark, values):
    rows = [(i, None if j == 3 else f"s{j}", None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "t int, s string, v double")


def all_ranks(values):
    with np.errstate(invalid="ignore", divide="ignore"):
        r = pd.DataFrame(values).corr(min_periods=2)
    flat = np.array([np.nanstd(c[~np.isnan(c)]) < 1e-9 if (~np.isnan(c)).any() else True for c in values.T])
    r.loc[flat, :] = np.nan
    r.loc[:, flat] = np.nan
    return r, (1 - r.abs()).round(9).rank(axis=1, method="average")


def expected(values, k):
    r, ranks = all_ranks(values)
    return {(f"s{a}", f"s{b}"): ranks.iloc[a, b] for a in range(len(r)) for b in range(len(r))
            if a != b and 3 not in (a, b) and ranks.iloc[a, b] <= k}


@pytest.mark.parametrize("few", [3, 1000])  # 1000: so few targets with the same known periods that all pairs are gone through
@pytest.mark.parametrize("seed, missing", [(1, 0.0), (2, 0.15), (3, 0.5)])
def test_predictors_are_those_of_all_pairs(spark, monkeypatch, few, seed, missing):
    for name, small in (("LEAF_SERIES", 4), ("CHUNK_BLOCKS", 3), ("NEAREST", 12), ("SOURCES_AT_ONCE", 24), ("FEW_TARGETS", few)):
        monkeypatch.setattr(strongest, name, small)
    values = made(seed, 150, 6, missing)
    got = {(r.series, r.predictor): r["rank"] for r in
           pairs.best_predictors(frame_of(spark, values), "t", "s", "v", 4, 20).collect()}
    want = expected(values, 4)
    assert got == want and (missing == 0.5 or len(got) > 100)


def test_leaves_that_cannot_lead_are_passed_over(monkeypatch):
    values = np.random.default_rng(0).normal(size=(20_000, 4))
    series = strongest.Series(values, np.ones(values.shape, bool))
    leaves = strongest.leaves_of(series, 32)
    order = np.concatenate(leaves)
    assert sorted(order) == list(range(20_000))
    series = series.take(order)
    sizes = np.array([len(x) for x in leaves])
    sources = strongest.Sources(series, sizes, series.known[0])
    met = []
    plain = strongest._offer
    monkeypatch.setattr(strongest, "_offer", lambda held, number, at, r, *own: (met.append(r.size), plain(held, number, at, r, *own)))
    held = strongest.Leading(32, 10, 9)
    for again in (False, True):
        strongest._meet_leaf(series.take(slice(0, 32)), 0, np.zeros(20_000, int), np.ones((1, 4)), sources, held, again)
    r = np.corrcoef(values[order[:32]], values[order])[:32, 32:]
    want = np.sort(np.round(1 - np.abs(r), 9), axis=1)[:, :10]
    assert np.array_equal(held.d.reshape(32, 10), want)
    assert sum(met) < 32 * 20_000 / 4


def test_estimates_are_those_of_the_fits_and_no_predictor_leaves_a_task(spark, monkeypatch):
    monkeypatch.setattr(strongest, "CHUNK_BLOCKS", 2)
    values = made(7, 90, 8, 0.2, ties=False)
    panel = frame_of(spark, values)
    out = impute.impute_panel(panel, "t", "s", "v", 5, 0, 1, 10)
    got = {(r.t, r.s): (r.v, r.n_predictors) for r in out.collect()}
    chosen = pairs.best_predictors(panel, "t", "s", "v", 5, 10)
    fits = {(r.series, r.predictor): r for r in impute.predictor_fits(panel, chosen, "t", "s", "v").collect()}
    assert len(got) == np.isnan(values).sum() + (~np.isnan(values[:, 3])).sum()
    for (t, s), (v, n) in got.items():
        if s is None:
            assert (v, n) == (None, 0)
            continue
        use = [(f.r2, f.intercept + f.slope * x) for (a, b), f in fits.items()
               if a == s and not np.isnan(x := values[t, int(b[1:])])]
        assert n == len(use)
        if use:
            assert v == pytest.approx(sum(w * g for w, g in use) / sum(w for w, _ in use))
    plan = out._jdf.queryExecution().toString()
    assert "CoGroups" not in plan and "predictor" not in plan.replace("n_predictors", "")


def test_a_panel_without_a_value(spark):
    panel = spark.createDataFrame([(1, "a", None), (2, "b", None)], "t int, s string, v double")
    assert pairs.best_predictors(panel, "t", "s", "v", 3).count() == 0
    rows = impute.impute_panel(panel, "t", "s", "v", 3).collect()
    assert sorted((r.t, r.s, r.v, r.n_predictors) for r in rows) == [
        (t, s, None, 0) for t in (1, 2) for s in "ab"]
