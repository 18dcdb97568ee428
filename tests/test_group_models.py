"""Models of all groups at once against the fits one by one and their score equations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trawlframe.operators import models


@pytest.fixture(scope="module")
def survey(spark):
    """Three taxa over different years, one never caught, some rows with missing values."""
    rnd, frames = np.random.default_rng(21), []
    for taxon, (n, first) in {"a": (1500, 2010), "b": (900, 2012), None: (600, 2010), "never": (50, 2011)}.items():
        temp, year = rnd.normal(3, 2, n), rnd.integers(first, first + 3, n)
        here = (rnd.random(n) < 1 / (1 + np.exp(-(0.4 + 0.3 * temp)))) & (taxon != "never")
        frames.append(pd.DataFrame({
            "taxon": taxon, "year": year.astype("int32"), "lat": rnd.uniform(55, 62, n), "lon": rnd.uniform(-178, -160, n),
            "bottom_temp": temp, "logdepth": rnd.normal(4, 0.5, n), "julian": rnd.normal(180, 20, n),
            "abund": np.where(here, rnd.gamma(5.0, (1 / (0.5 + 0.05 * (year - 2010))) / 5.0), 0.0)}))
    out = spark.createDataFrame(pd.concat(frames).astype({"taxon": object}))
    gone = F.rand(3) < 0.02
    return models.cut_lineage(out.withColumn("julian", F.when(~gone, F.col("julian"))))


@pytest.fixture(scope="module")
def fits(survey):
    return models.cut_lineage(models.fit_delta(survey, ["taxon"], max_iter=12, tol=1e-9))


def test_coefficients_equal_the_fits_one_by_one(spark, survey, fits):
    got = {(r.taxon, r.part, r.term): r.estimate for r in models.delta_coefficients(fits, ["taxon"]).collect()}
    assert {k[:2] for k in got} == {(t, p) for t in ("a", "b", None) for p in models.PARTS} | {("never", "presence")}
    for taxon in ("a", "b"):
        rows = survey.filter(F.col("taxon") == taxon)
        for part, fit in (("presence", models.fit_presence), ("density", models.fit_density)):
            want = {r.term: r.estimate for r in fit(rows, max_iter=40).coefficients(spark).collect()}
            assert {k[2]: v for k, v in got.items() if k[:2] == (taxon, part)} == pytest.approx(want, abs=2e-4)


def test_score_equations_hold(survey, fits):
    """Penalised scores vanish: x'(y - mean) weighted by the link = ridge x weight x coefficient."""
    for fit in fits.filter("converged and (taxon is null or taxon <> 'never')").collect():
        rows = survey.dropna(subset=[*models.COVARIATES]).filter(F.col("taxon").eqNullSafe(fit.taxon)).toPandas()
        if fit.part == "density":
            rows = rows[rows["abund"] > 0]
        hats = {}
        for c in ("lat", "lon"):
            low, high = fit[f"lo_{c}"], fit[f"hi_{c}"]
            knots = np.linspace(low, high, models.KNOTS)
            hats[c] = np.maximum(0, 1 - np.abs(rows[c].to_numpy()[:, None] - knots) / (knots[1] - knots[0]))
        x = [np.ones(len(rows))] + [hats["lat"][:, i] * hats["lon"][:, j] for i in range(5) for j in range(5)]
        x += [(rows["year"] == y).to_numpy(float) for y in fit.years[1:]]
        for c in models.COVARIATES:
            z = ((rows[c] - rows[c].mean()) / rows[c].std()).to_numpy()
            x += [z, z * z]
        x, beta = np.column_stack(x), np.array(fit.beta)
        eta = x @ beta
        if fit.part == "presence":
            mean = 1 / (1 + np.exp(-eta))
            residual, weight = (rows["abund"] > 0) - mean, (mean * (1 - mean)).sum()
        else:
            assert (eta > 0).all()
            residual, weight = 1 / eta - rows["abund"], (1 / eta ** 2).sum()
        penalty = 1e-3 * weight * beta
        penalty[0] = 0
        assert x.T @ residual.to_numpy() == pytest.approx(penalty, abs=1e-5)


def test_groups_do_not_depend_on_partitions(survey, fits, monkeypatch):
    monkeypatch.setattr(models, "HELD_GROUPS", 1)
    again = models.fit_delta(survey.repartition(5), ["taxon"], max_iter=12, tol=1e-9)
    order = lambda d: sorted(d.collect(), key=lambda r: (str(r.taxon), r.part))
    for one, two in zip(order(fits), order(again), strict=True):
        assert (one.taxon, one.part) == (two.taxon, two.part) and one.beta == pytest.approx(two.beta, abs=1e-6)


def test_empty_table_and_unknown_link(survey):
    assert models.fit_delta(survey.limit(0), ["taxon"]).count() == 0
    with pytest.raises(ValueError, match="link"):
        models.fit_delta(survey, ["taxon"], link="identity")
