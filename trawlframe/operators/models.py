"""Two-part (delta) models of presence and density, fitted by distributed GLMs.

The spatial smooth is a fixed tensor basis (5 x 5 hat functions over the range
of the positions) under a small ridge penalty; year is a factor; temperature,
log depth and day of year enter linearly and squared, standardised.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    GeneralizedLinearRegression, GeneralizedLinearRegressionModel,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.functions import presence
from trawlframe.operators.ordered import quantiles
from trawlframe.operators.spatial import latitude_center
from trawlframe.session import BROADCAST_BYTES, attach_groups, cut_lineage, same_keys_join

COVARIATES = ["bottom_temp", "logdepth", "julian"]
KNOTS = 5


@dataclass
class Design:
    """How rows become features; learnt from the fitting data."""

    years: list[int]
    box: dict[str, tuple[float, float]]
    scale: dict[str, tuple[float, float]]
    names: list[str] = field(default_factory=list)

    @classmethod
    def learn(cls, df: DataFrame) -> Design:
        """One small aggregate: ranges, means and deviations, and the years."""
        row = df.agg(
            *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))],
            *[f(c).alias(f"{n}_{c}") for c in COVARIATES for n, f in (("m", F.avg), ("s", F.stddev_samp))],
        ).first()
        years = sorted(r[0] for r in df.select("year").distinct().collect())
        return cls(
            years,
            {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in ("lat", "lon")},
            {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in COVARIATES},
        )

    def features(self) -> Column:
        columns, self.names = [], []

        def add(name: str, column: Column) -> None:
            self.names.append(name)
            columns.append(column.cast("double"))

        for i, lat in enumerate(self._hats("lat")):
            for j, lon in enumerate(self._hats("lon")):
                add(f"te_{i}{j}", lat * lon)
        for year in self.years[1:]:
            add(f"year_{year}", F.when(F.col("year") == year, 1.0).otherwise(0.0))
        for name in COVARIATES:
            mean, sd = self.scale[name]
            z = (F.col(name) - mean) / sd
            add(name, z)
            add(f"{name}_squared", z * z)
        return array_to_vector(F.array(*columns))

    def _hats(self, name: str) -> list[Column]:
        low, high = self.box[name]
        step = (high - low) / (KNOTS - 1) or 1.0
        return [
            F.greatest(F.lit(0.0), 1.0 - F.abs(F.col(name) - (low + k * step)) / step)
            for k in range(KNOTS)
        ]


@dataclass
class Fit:
    """A fitted part of the model."""

    design: Design
    model: GeneralizedLinearRegressionModel

    def coefficients(self, spark) -> DataFrame:
        values = [("intercept", float(self.model.intercept))] + [
            (n, float(v)) for n, v in zip(self.design.names, self.model.coefficients)]
        return spark.createDataFrame(values, "term string, estimate double")

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        scored = self.model.transform(df.withColumn("features", self.design.features()))
        return scored.drop("features").withColumnRenamed("prediction", out)


def _fit(df: DataFrame, label: Column, ridge: float, max_iter: int, **family) -> Fit:
    rows = df.select(
        label.cast("double").alias("label"), "lat", "lon", "year", *COVARIATES
    ).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Every iteration reads the rows again; the joins behind them run once.
        design = Design.learn(rows)
        training = rows.select("label", design.features().alias("features"))
        glm = GeneralizedLinearRegression(maxIter=max_iter, regParam=ridge, tol=1e-6, **family)
        return Fit(design, glm.fit(training))
    finally:
        rows.unpersist()


def fit_presence(df: DataFrame, abundance: str = "abund", ridge: float = 1e-3,
                 max_iter: int = 25) -> Fit:
    """Binomial model of presence."""
    return _fit(df, presence(abundance), ridge, max_iter, family="binomial", link="logit")


def fit_density(df: DataFrame, abundance: str = "abund", ridge: float = 1e-3,
                max_iter: int = 25, link: str = "inverse") -> Fit:
    """Gamma model of the positive abundances."""
    return _fit(df.filter(F.col(abundance) > 0), F.col(abundance), ridge, max_iter,
                family="gamma", link=link)


def shared_years(a: DataFrame, b: DataFrame, year: str = "year") -> DataFrame:
    """Years that occur in both tables."""
    return a.select(year).distinct().join(b.select(year).distinct(), year, "left_semi")


def prediction_grid(df: DataFrame, years: DataFrame, n_lat: int = 100) -> DataFrame:
    """Latitudes from the 2.5 to the 97.5 % quantile for each year, the rest at its mean."""
    ends = quantiles(df, "lat", [0.025, 0.975], []).first()
    means = df.agg(F.avg("lon"), *[F.avg(c) for c in COVARIATES]).first()
    low, high = ends["q_2_5"], ends["q_97_5"]
    step = (high - low) / (n_lat - 1)
    return years.select(
        "year", F.explode(F.sequence(F.lit(0), F.lit(n_lat - 1))).alias("_i")
    ).select("year", (low + F.col("_i") * step).alias("lat"), *[
        F.lit(m).alias(c) for c, m in zip(["lon", *COVARIATES], means)])


def predict_delta(grid: DataFrame, presence_fit: Fit, density_fit: Fit) -> DataFrame:
    """Presence, density where present, and their product.

    The inverse link can give a negative mean off the data; such a density is
    set to 0 and marked ``clipped``.
    """
    out = density_fit.predict(presence_fit.predict(grid, "predbin"), "predpos")
    return out.withColumn("clipped", ~(F.col("predpos") > 0)).withColumn(
        "predpos", F.when(F.col("clipped"), 0.0).otherwise(F.col("predpos"))
    ).withColumn("pred", F.col("predbin") * F.col("predpos"))


def model_center_of_gravity(df: DataFrame, taxa: list[str], taxon: str = "taxon",
                            abundance: str = "abund", n_lat: int = 100,
                            stations: DataFrame | None = None, **options) -> DataFrame:
    """Density-weighted mean latitude of the fitted distribution, by taxon and year.

    ``stations`` restricts the fit to the listed stations. The loop over taxa
    is on the driver; every fit is distributed.
    """
    if stations is not None:
        df = df.join(stations, "station", "left_semi")
    results = []
    for name in taxa:
        rows = df.filter(F.col(taxon) == name)
        first = fit_presence(rows, abundance, **options)
        second = fit_density(rows, abundance, **options)
        years = shared_years(rows, rows.filter(F.col(abundance) > 0))
        predicted = predict_delta(prediction_grid(rows, years, n_lat), first, second)
        results.append(
            latitude_center(predicted, "lat", "pred", "predbin", ["year"])
            .withColumn(taxon, F.lit(name)))
    return reduce(DataFrame.unionByName, results)


# -- all groups at once ----------------------------------------------------------------

PARTS = ("presence", "density")
# Groups whose sums a task holds before it passes them on.
HELD_GROUPS = 256
EPSILON = 1e-16
# A row of a group's coefficients.
COEFFICIENT_BYTES = 1024


def _group_features() -> Column:
    """The features of ``Design`` from the columns of a design that stands beside the row."""
    def hats(name: str) -> list[Column]:
        low = F.col(f"lo_{name}")
        width = (F.col(f"hi_{name}") - low) / (KNOTS - 1)
        step = F.when(width > 0, width).otherwise(1.0)
        return [F.greatest(F.lit(0.0), 1.0 - F.abs(F.col(name) - (low + k * step)) / step) for k in range(KNOTS)]

    tensor = [lat * lon for lat in hats("lat") for lon in hats("lon")]
    z = [(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in COVARIATES]
    years = F.transform(F.slice("years", 2, F.greatest(F.size("years"), F.lit(1))),
                        lambda y: F.when(F.col("year") == y, 1.0).otherwise(0.0))
    return F.concat(F.array(F.lit(1.0), *tensor), years, F.array(*[x for v in z for x in (v, v * v)]))


def _designs(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group: ranges, means, deviations and its years in order."""
    deviation = lambda c: F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0))
    return rows.groupBy(*by).agg(
        *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))],
        *[f(c).alias(f"{n}_{c}") for c in COVARIATES for n, f in (("m", F.avg), ("s", deviation))],
        F.array_sort(F.collect_set("year")).alias("years"))


def _working(part: str, link: str, y: np.ndarray, eta: np.ndarray | None):
    """(weights, working response) of a step; without ``eta`` those of the first one."""
    if part == "presence":
        mu = (y + 0.5) / 2 if eta is None else np.clip(1 / (1 + np.exp(-np.clip(eta, -700, 700))), EPSILON, 1 - EPSILON)
        spread = mu * (1 - mu)
        return spread, np.log(mu / (1 - mu)) + (y - mu) / spread
    if eta is None:
        mu = y
    elif link == "inverse":
        # A negative mean is no mean; such a row has no weight.
        mu = np.where(eta > EPSILON, 1 / np.maximum(eta, EPSILON), EPSILON)
    else:
        mu = np.maximum(np.exp(np.clip(eta, -700, 700)), EPSILON)
    if link == "inverse":
        return mu * mu, 1 / mu - (y - mu) / (mu * mu)
    return np.ones_like(mu), np.log(mu) + (y - mu) / mu


def _normal_equations(rows: DataFrame, by: list[str], link: str) -> DataFrame:
    """by, part, i, j, v: weighted sums of x x', x z (j = -1) and weights (i = j = -1).

    Rows bring ``label``, ``features`` and ``beta`` (NULL before the first step). A task
    sums the matrices of its groups, so the shuffle holds one for each task and group.
    """
    keys = [*by, "part"]
    schema = T.StructType([*[rows.schema[c] for c in keys], T.StructField("i", T.IntegerType()),
                           T.StructField("j", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def out(held):
        for key, total in held.items():
            n = len(total) - 1
            i, j = np.indices(total.shape)
            yield pd.DataFrame({**dict(zip(keys, [[k] * total.size for k in key])),
                                "i": np.where(i < n, i, -1).ravel(), "j": np.where(j < n, j, -1).ravel(),
                                "v": total.ravel()})

    def work(batches):
        held: dict[tuple, np.ndarray] = {}
        for frame in batches:
            for key, own in frame.groupby(keys, dropna=False, sort=False):
                x = np.stack(own["features"].to_list())
                beta = own["beta"].iloc[0]
                w, z = _working(key[-1], link, own["label"].to_numpy(), None if beta is None else x @ np.asarray(beta))
                total = np.zeros((x.shape[1] + 1,) * 2)
                total[:-1, :-1], total[:-1, -1], total[-1, -1] = (x * w[:, None]).T @ x, x.T @ (w * z), w.sum()
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = held[key] + total if key in held else total
            if len(held) > HELD_GROUPS:
                yield from out(held)
                held = {}
        yield from out(held)

    return rows.mapInPandas(work, schema).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def _solved(sums: DataFrame, by: list[str], ridge: float) -> DataFrame:
    """by, part, new: the coefficients that solve each group's penalised equations."""
    keys = [*by, "part"]
    schema = T.StructType([*[sums.schema[c] for c in keys], T.StructField("new", T.ArrayType(T.DoubleType()))])

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["i"].max() + 1
        total = np.zeros((n + 1, n + 1))
        total[frame["i"], frame["j"]] = frame["v"]
        weight = total[n, n] or 1.0
        # The penalty of a mean loss; the intercept, which comes first, is free.
        matrix = total[:n, :n] / weight + np.diag([0.0] + [ridge] * (n - 1))
        try:
            new = np.linalg.solve(matrix, total[:n, n] / weight)
        except np.linalg.LinAlgError:
            new = np.linalg.lstsq(matrix, total[:n, n] / weight, rcond=None)[0]
        return pd.DataFrame({**{c: [frame[c].iloc[0]] for c in keys}, "new": [new]})

    return sums.groupBy(*keys).applyInPandas(work, schema)


def fit_delta(df: DataFrame, by: list[str], abundance: str = "abund", ridge: float = 1e-3,
              max_iter: int = 25, link: str = "inverse", tol: float = 1e-6) -> DataFrame:
    """Presence and density models of every group, fitted side by side.

    Iteratively reweighted least squares: each step sums the normal equations of all
    groups and both parts in one pass over the rows, and the small systems are solved one
    task for each group. Groups that stand still (no coefficient moves by ``tol``) leave the
    passes. The driver loops over steps, never over groups. Rows with a NULL in what a
    model reads take no part; a group without positive abundances has no density row.
    ``link`` of the density is 'inverse' or 'log'.

    Returns a row for each group and ``part``: the design, ``beta`` (intercept first) and
    ``steps``; ``converged`` tells whether the last step moved less than ``tol``.
    """
    if link not in ("inverse", "log"):
        raise ValueError(f"link {link!r} is neither 'inverse' nor 'log'")
    keys = [*by, "part"]
    known = df.select(*by, "lat", "lon", "year", *COVARIATES, F.col(abundance).cast("double").alias("_a"))
    known = known.dropna(subset=["lat", "lon", "year", *COVARIATES, "_a"])
    rows = known.select("*", F.explode(F.when(F.col("_a") > 0, F.array(*map(F.lit, PARTS))).otherwise(
        F.array(F.lit(PARTS[0])))).alias("part"))
    rows = rows.withColumn("label", F.when(F.col("part") == "density", F.col("_a")).otherwise(
        (F.col("_a") > 0).cast("double")))
    # Every step reads the rows again; the joins behind them run once.
    rows = cut_lineage(rows.select(*keys, "label", "lat", "lon", "year", *COVARIATES))
    designs = cut_lineage(_designs(rows, keys))
    rows = cut_lineage(attach_groups(rows, designs, keys).select(*keys, "label", _group_features().alias("features")))
    empty = F.lit(None).cast("array<double>")
    left, done = designs.select(*keys, empty.alias("beta")), []
    count = designs.count()
    for step in range(max_iter + 1):
        if not count:
            break
        own = F.broadcast(left) if count * COEFFICIENT_BYTES <= BROADCAST_BYTES else left
        solved = _solved(_normal_equations(same_keys_join(rows, own, keys, "inner"), by, link), by, ridge)
        moved = F.when(F.col("beta").isNull(), F.lit(float("inf"))).otherwise(
            F.array_max(F.zip_with("new", "beta", lambda a, b: F.abs(a - b))))
        solved = cut_lineage(same_keys_join(solved, left, keys).select(
            *keys, F.col("new").alias("beta"), F.lit(step).alias("steps"), (moved < tol).alias("converged")))
        last = step == max_iter
        done.append(solved if last else solved.filter("converged"))
        left = solved.filter(~F.col("converged")).select(*keys, "beta")
        count = 0 if last else left.count()
    if not done:
        done = [left.select("*", F.lit(0).alias("steps"), F.lit(False).alias("converged"))]
    return same_keys_join(designs, reduce(DataFrame.unionByName, done), keys, "inner")


def delta_coefficients(fits: DataFrame, by: list[str]) -> DataFrame:
    """by, part, term, estimate of the models of ``fit_delta``."""
    terms = F.concat(
        F.array(F.lit("intercept"), *[F.lit(f"te_{i}{j}") for i in range(KNOTS) for j in range(KNOTS)]),
        F.transform(F.slice("years", 2, F.greatest(F.size("years"), F.lit(1))),
                    lambda y: F.concat(F.lit("year_"), y.cast("string"))),
        F.array(*[F.lit(t) for c in COVARIATES for t in (c, f"{c}_squared")]))
    return fits.select(*by, "part", F.inline(F.arrays_zip(terms.alias("term"), F.col("beta").alias("estimate"))))
