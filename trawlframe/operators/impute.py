"""Missing panel cells from the best-correlated series of the same period."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.functions import safe_div
from trawlframe.operators.bootstrap import PRIME, hash_numbers
from trawlframe.operators.pairs import BLOCK_SERIES, pack_periods
from trawlframe.operators.panel import gaps
from trawlframe.operators.strongest import DIGITS, strongest_fits
from trawlframe.session import cut_lineage


def predictor_fits(panel: DataFrame, predictors: DataFrame, t: str, series: str,
                   value: str) -> DataFrame:
    """Regression of each series on each of its predictors over shared periods."""
    known = panel.filter(F.col(value).isNotNull()).groupBy(series, t).agg(F.avg(value).alias("v"))
    target = known.select(F.col(series).alias("series"), F.col(t).alias("t"), F.col("v").alias("_y"))
    source = known.select(F.col(series).alias("predictor"), F.col(t).alias("t"), F.col("v").alias("_x"))
    # k predictors for each series and one row for each period: linear in the panel.
    pairs = predictors.join(source, "predictor").join(target, ["series", "t"])
    return pairs.groupBy("series", "predictor").agg(
        F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"), F.count(F.lit(1)).alias("n"),
        F.var_samp("_y").alias("_var_y"),
    ).withColumn("residual_var", F.greatest(1.0 - F.col("r2"), F.lit(0.0)) * F.col("_var_y")).drop("_var_y")


def impute_panel(panel: DataFrame, t: str, series: str, value: str, k: int = 20, m: int = 0,
                 seed: int = 1, block_series: int = BLOCK_SERIES) -> DataFrame:
    """The missing (t, series) cells with an estimate.

    Each predictor with a value in the period gives an estimate by its own
    regression; they are averaged with r squared as the weight. ``m = 0``
    gives the estimate alone; ``m > 0`` gives that many copies with normal
    noise of the pooled residual spread, drawn by hash. A cell none of whose
    predictors is known stays NULL.
    """
    # Three branches read the panel; whatever made it runs once.
    panel = cut_lineage(panel.select(t, series, value))
    packed, periods = pack_periods(panel, t, series, value)
    missing = gaps(panel, series, t, value).select(
        F.col(t).alias("t"), F.col(series).alias("series"))
    # Fitted where the predictors are found: neither they nor their fits leave a task.
    times = F.lit(periods).cast(T.ArrayType(panel.schema[t].dataType))
    found = strongest_fits(packed, len(periods), k, block_series, DIGITS).select(
        times[F.col("at")].alias("t"), "series", safe_div("guess", "r2").alias("estimate"),
        F.sqrt(safe_div("left", "r2")).alias("_sd"), "n_predictors")
    cells = missing.join(found, ["t", "series"], "left").withColumn(
        "n_predictors", F.coalesce("n_predictors", F.lit(0)))
    if m == 0:
        out = cells.drop("_sd")
    else:
        # The copies are made, and counted, from the estimates.
        out = cut_lineage(cells).withColumn("imputation", F.explode(F.sequence(F.lit(1), F.lit(m)))).withColumn(
            "estimate", F.col("estimate") + F.coalesce("_sd", F.lit(0.0)) * _normal(seed)
        ).drop("_sd")
    return out.withColumnsRenamed({"t": t, "series": series, "estimate": value})


def _normal(seed: int):
    """A standard normal number from the two hashes of the cell."""
    a, b = hash_numbers(seed, F.col("series"), F.col("t"), F.col("imputation"))
    u1, u2 = (a + 1).cast("double") / (PRIME + 1.0), b.cast("double") / float(PRIME)
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * u2)


def complete_panels(panel: DataFrame, imputed: DataFrame, t: str, series: str,
                    value: str) -> DataFrame:
    """All completed data sets, long: observed values in every imputation."""
    numbers = imputed.select("imputation").distinct().agg(
        F.sort_array(F.collect_set("imputation"))).scalar()
    observed = panel.filter(F.col(value).isNotNull()).select(t, series, value)
    return observed.select(
        F.explode(numbers).alias("imputation"), t, series, value
    ).unionByName(imputed.select("imputation", t, series, value))
