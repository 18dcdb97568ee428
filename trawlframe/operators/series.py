"""Relations between series: correlation of pairs, lags, regression, variograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.functions import column, safe_div, strict_avg, strict_sd
from trawlframe.operators import tiles
from trawlframe.operators.panel import minimum_difference
from trawlframe.session import attach_groups, same_keys_join


def correlate(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of two columns with r squared and t statistic."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r, n = F.col("r"), F.col("n")
    return both.groupBy(*by).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n")).withColumns({
        "r_squared": r * r,
        "t": r * F.sqrt(safe_div(n - 2, F.when(r * r < 1, 1.0 - r * r))),
    })


def cross_correlation(df: DataFrame, t: str, x: str, y: str, by: list[str] | None = None,
                      max_lag: int | None = None) -> DataFrame:
    """Correlation of x at t + lag with y at t, for each lag both ways.

    Means and variances are those of the whole series, the divisor is its
    length. One row for each (by, t) is expected. The default lag is
    floor(10 log10(n / 2)), from the longest series.
    """
    by = list(by or [])
    stats = df.groupBy(*by).agg(
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count(F.lit(1)).alias("_n"),
        F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"),
    )
    if max_lag is None:
        n = stats.agg(F.max("_n")).first()[0]
        max_lag = math.floor(10 * math.log10(n / 2))
    left = df.select(*by, F.col(t).alias("_t"), F.col(x).alias("_x"))
    right = df.select(
        *by, F.col(y).alias("_y"),
        F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"), F.col(t).alias("_at"),
    ).withColumn("_t", F.col("_at") + F.col("lag"))
    pairs = attach_groups(same_keys_join(right, left, [*by, "_t"], "inner"), stats, by)
    return pairs.groupBy(*by, "lag").agg(
        (F.sum((F.col("_x") - F.col("_mx")) * (F.col("_y") - F.col("_my")))).alias("_s"),
        F.first("_n").alias("_n"), F.first("_sx").alias("_sx"), F.first("_sy").alias("_sy"),
    ).select(*by, "lag", safe_div(
        F.col("_s"), F.col("_n") * F.col("_sx") * F.col("_sy")).alias("ccf"))


def difference(df: DataFrame, a: str, b: str, out: str = "difference") -> DataFrame:
    return df.withColumn(out, F.col(a) - F.col(b))


def slope(df: DataFrame, t: str, value: str, by: list[str]) -> DataFrame:
    """Least-squares slope of a series on time."""
    return df.groupBy(*by).agg(F.regr_slope(value, t).alias("slope"))


def factor_regression(df: DataFrame, y, factor: str, by: list[str], base_level) -> DataFrame:
    """Level means of a one-factor regression, with both standard errors.

    ``coef`` is the mean for the base level and the difference to it for the
    others; ``se_coef`` is the error of the coefficient, ``se_mean`` that of
    the level mean. The spread within levels is pooled from the levels'
    variances, so the rows are read once.
    """
    levels = df.withColumn("_y", column(y)).filter(
        F.col("_y").isNotNull() & F.col(factor).isNotNull()
    ).groupBy(*by, factor).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("estimate"),
        (F.var_pop("_y") * F.count(F.lit(1))).alias("_ss"),
    )
    base = F.col(factor) == F.lit(base_level)
    pooled = levels.groupBy(*by).agg(
        safe_div(F.sum("_ss"), F.sum("n") - F.count(F.lit(1))).alias("_s2"),
        F.max(F.when(base, F.col("n"))).alias("_base_n"),
        F.max(F.when(base, F.col("estimate"))).alias("_base"),
    )
    per_level = F.col("_s2") / F.col("n")
    return attach_groups(levels, pooled, by).select(
        *by, factor, "n", "estimate",
        F.when(base, F.col("estimate")).otherwise(F.col("estimate") - F.col("_base")).alias("coef"),
        F.when(base, F.sqrt(per_level)).otherwise(
            F.sqrt(per_level + F.col("_s2") / F.col("_base_n"))).alias("se_coef"),
        F.sqrt(per_level).alias("se_mean"),
    )


def factor_residuals(df: DataFrame, y, factor: str, by: list[str]) -> DataFrame:
    """The rows with their residual from the level mean."""
    rows = df.withColumn("_y", column(y))
    means = rows.groupBy(*by, factor).agg(F.avg("_y").alias("_mean"))
    return attach_groups(rows, means, [*by, factor]).withColumn(
        "residual", F.col("_y") - F.col("_mean")).drop("_y", "_mean")


# -- pairs of positions -----------------------------------------------------------

def _spots(df: DataFrame, value: str, by: list[str], x: str, y: str) -> DataFrame:
    """Count, mean and sum of squares about it of the rows at each position of a group."""
    clean = df.filter(F.col(value).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    return clean.groupBy(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("m"),
        (F.var_pop(value) * F.count(F.lit(1))).alias("ss"),
    )


def location_pairs(df: DataFrame, value: str, by: list[str], max_dist: float,
                   x: str = "lon", y: str = "lat", most: int = tiles.TILE_POSITIONS) -> DataFrame:
    """Pairs of positions up to ``max_dist`` apart within a group.

    One row for each pair of distinct positions (and one for each position
    with itself, if it has several rows): the distance, the number of row
    pairs and their mean half squared difference. Rows at one position are
    summed first, which gives the same as listing the row pairs. Positions lie in squares as
    wide as the limit, quartered until none has more than ``most`` of them,
    and only leaves that reach each other meet.
    """
    rows = tiles.paired_tiles(_spots(df, value, by, x, y), by, max_dist, most=most).rows
    met = rows.select(*by, "own", F.explode("left").alias("p"), "right").select(
        *by, "own", "p", F.explode("right").alias("q"))
    later = (F.col("p.x") < F.col("q.x")) | ((F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y")))
    met = met.filter(~F.col("own") | later | (F.col("p") == F.col("q"))).select(
        *by, F.when(later, F.col("p")).otherwise(F.col("q")).alias("a"),
        F.when(later, F.col("q")).otherwise(F.col("p")).alias("b"))
    same = (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    distance = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2))
    gap = F.col("b.m") - F.col("a.m")
    # Sum over row pairs of (a - b)^2 / 2 from the two positions' moments.
    halves = (F.col("b.n") * F.col("a.ss") + F.col("a.n") * F.col("b.ss")
              + F.col("b.n") * F.col("a.n") * gap * gap) / 2.0
    n_pairs = F.when(same, F.col("a.n") * (F.col("a.n") - 1) / 2.0).otherwise(F.col("a.n") * F.col("b.n"))
    return met.select(
        *by, F.col("a.x").alias("x_a"), F.col("a.y").alias("y_a"), F.col("b.x").alias("x_b"),
        F.col("b.y").alias("y_b"), distance.alias("distance"), n_pairs.cast("bigint").alias("n_pairs"),
        F.when(same, F.col("a.n") * F.col("a.ss") / 2.0).otherwise(halves).alias("_sum"),
    ).filter((F.col("distance") <= max_dist) & (F.col("n_pairs") > 0)).withColumn(
        "semivariance", F.col("_sum") / F.col("n_pairs")).drop("_sum")


def variogram_cloud(residuals: DataFrame, value: str, by: list[str], max_dist: float,
                    x: str = "lon", y: str = "lat") -> DataFrame:
    """Half squared difference against distance, one point for each pair of positions."""
    return location_pairs(residuals, value, by, max_dist, x, y).select(
        *by, "distance", "n_pairs", "semivariance")


def variogram_binned(residuals: DataFrame, value: str, by: list[str], max_dist: float,
                     bins: int = 10, x: str = "lon", y: str = "lat",
                     most: int = tiles.TILE_POSITIONS) -> DataFrame:
    """Mean half squared difference and distance in equal distance classes.

    No pairs are listed. Squares of positions are opened in pairs, the crowded ones
    level by level; a pair of squares whose distances all lie in one class adds its sum from
    the squares' counts, means, sums of squares and moments of place (the distances
    to 1e-10), others are opened, and at the leaves the pairs are summed within
    the tasks, so that only sums by group and class are shuffled.
    """
    width = max_dist / bins
    paired = tiles.paired_tiles(_spots(residuals, value, by, x, y), by, max_dist, width, most)
    sums = tiles.binned_sums(paired, max_dist, width)
    return sums.select(
        *by, "bin", F.round("pairs").cast("bigint").alias("n_pairs"),
        (F.col("distances") / F.col("pairs")).alias("distance"),
        (F.col("halves") / F.col("pairs")).alias("semivariance"),
    )


# -- model choice, imputations, histogram ----------------------------------------------

def aicc(loglik, k, n) -> Column:
    """Small-sample Akaike criterion."""
    loglik, k, n = column(loglik), column(k), column(n)
    return -2.0 * loglik + safe_div(2.0 * k * n, n - k - 1)


def delta_aicc(fits: DataFrame, loglik: str, k: str, n: str, by: list[str] | None = None) -> DataFrame:
    """Table of fits with the criterion and its distance to the best."""
    scored = fits.withColumn("aicc", aicc(loglik, k, n))
    return minimum_difference(scored, "aicc", list(by or []), "delta_aicc")


def pool_imputations(completed: DataFrame, t: str, series: str, value: str) -> DataFrame:
    """Mean, standard deviation and standard error over the completed data sets."""
    return completed.groupBy(t, series).agg(
        strict_avg(value).alias("mean"), strict_sd(value).alias("sd"),
        (strict_sd(value) / F.sqrt(F.count(F.lit(1)))).alias("std_error"),
    )


def fill_from(df: DataFrame, imputed: DataFrame, on: list[str], value: str,
              imputed_value: str = "mean") -> DataFrame:
    """Observed values kept, missing ones taken from ``imputed`` by key."""
    other = imputed.select(*on, F.col(imputed_value).alias("_imputed"))
    return df.join(other, on, "left").withColumn(
        value, F.coalesce(F.col(value), F.col("_imputed"))).drop("_imputed")


def histogram(df: DataFrame, value, bins: int, by: list[str]) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value.

    The largest value belongs to the last bin. Empty bins have no row.
    """
    rows = df.select(*by, column(value).alias("_v")).filter(F.col("_v").isNotNull())
    ends = rows.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.coalesce(F.floor(safe_div(F.col("_v") - F.col("_low"), width)), F.lit(0)) + 1
    placed = attach_groups(rows, ends, by).withColumn("bin", F.least(at, F.lit(bins)).cast("int"))
    return placed.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.first(F.col("_low") + (F.col("bin") - 1) * width).alias("lower"),
        F.first(F.col("_low") + F.col("bin") * width).alias("upper"),
    )
