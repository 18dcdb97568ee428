"""Correlation and covariance of every pair of series, in blocks.

The pairs of s series are s squared, whatever the engine. What can be avoided
is shuffling a row for each pair and period. Each series becomes one row (its
values by period), the rows are hashed into blocks of bounded size, and a task
takes two blocks and gets all their pairs by matrix products. The best
predictors are searched for without shuffling blocks (``strongest``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.operators.strongest import DIGITS, rounding, strongest
from trawlframe.session import cut_lineage

# Series in a block: a task holds a few block x block matrices of doubles.
BLOCK_SERIES = 1500


def pack_series(panel: DataFrame, t: str, series: str, value: str) -> tuple[DataFrame, int]:
    """(one row for each series with its period numbers and values, number of periods)."""
    packed, periods = pack_periods(panel, t, series, value)
    return packed, len(periods)


def pack_periods(panel: DataFrame, t: str, series: str, value: str) -> tuple[DataFrame, list]:
    """(one row for each series with its period numbers and values, the periods).

    Periods are years or days, so their list is short; two values for one
    cell are averaged.
    """
    cells = cut_lineage(panel.filter(F.col(value).isNotNull() & F.col(t).isNotNull()).groupBy(series, t).agg(
        F.avg(value).alias("_v")))
    periods = [r[0] for r in cells.select(t).distinct().orderBy(t).collect()]
    index = F.array_position(F.lit(periods).cast(T.ArrayType(panel.schema[t].dataType)), F.col(t))
    packed = cells.groupBy(F.col(series).alias("series")).agg(
        F.collect_list((index - 1).cast("int")).alias("at"), F.collect_list("_v").alias("v"))
    return packed, periods


def _matrix(frame: pd.DataFrame, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values centred on each series' mean (0 where missing), the mask of values, largest size."""
    x = np.zeros((len(frame), periods))
    mask = np.zeros_like(x)
    size = np.zeros(len(frame))
    for i, (at, v) in enumerate(zip(frame["at"], frame["v"])):
        values = np.asarray(v, dtype=float)
        x[i, at] = values - values.mean()
        mask[i, at] = 1.0
        size[i] = np.abs(values).max(initial=0.0)
    return x, mask, size


def _moments(a: pd.DataFrame, b: pd.DataFrame, periods: int):
    """Covariance sum, correlation and number of shared periods of all pairs."""
    xa, ma, size_a = _matrix(a, periods)
    xb, mb, size_b = _matrix(b, periods)
    n = ma @ mb.T
    with np.errstate(divide="ignore", invalid="ignore"):
        sa, sb = xa @ mb.T, ma @ xb.T
        cov = xa @ xb.T - sa * sb / n
        va = (xa * xa) @ mb.T - sa * sa / n
        vb = ma @ (xb * xb).T - sb * sb / n
        # Constant but for rounding: of the sums here, or of the values before centring.
        flat = ((va <= rounding(xa, size_a)[:, None]) | (vb <= rounding(xb, size_b)[None, :]))
        r = np.where(flat | (n < 2), np.nan, cov / np.sqrt(va * vb))
    return cov, np.clip(r, -1.0, 1.0), n


def _meet(packed: DataFrame, block_series: int, ordered: bool):
    """Both sides of every block pair; ``ordered`` keeps only first <= second."""
    n = packed.count()
    firsts = seconds = max(1, math.ceil(n / block_series))

    def own(count):
        return packed.withColumn("_own", F.pmod(F.hash("series"), F.lit(count)))

    upper = F.sequence(F.col("_own") if ordered else F.lit(0), F.lit(seconds - 1))
    lower = F.sequence(F.lit(0), F.col("_own") if ordered else F.lit(firsts - 1))
    left = own(firsts).select("*", F.col("_own").alias("_i"), F.explode(upper).alias("_j"))
    # New names for the same columns, so that the two sides can be told apart.
    right = own(seconds).select("*", F.explode(lower).alias("_i"), F.col("_own").alias("_j"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j"))


def _all_pairs(panel, t, series, value, block_series, measure) -> DataFrame:
    packed, periods = pack_series(panel, t, series, value)
    kind = packed.schema["series"].dataType
    schema = T.StructType([
        T.StructField("series", kind), T.StructField("other", kind),
        T.StructField(measure, T.DoubleType()), T.StructField("n", T.LongType()),
    ])

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        cov, r, n = _moments(a, b, periods)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = r if measure == "r" else np.where(n > 1, cov / (n - 1), np.nan)
        ia, ib = np.indices(out.shape)
        first, second = a["series"].to_numpy()[ia.ravel()], b["series"].to_numpy()[ib.ravel()]
        keep = (n.ravel() > 1) & ~np.isnan(out.ravel())
        if a["_i"].iloc[0] == b["_j"].iloc[0]:
            keep &= first <= second if measure == "cov" else first < second
        first, second = first[keep], second[keep]
        swap = first > second
        return pd.DataFrame({
            "series": np.where(swap, second, first), "other": np.where(swap, first, second),
            measure: out.ravel()[keep], "n": n.ravel()[keep].astype(np.int64),
        })

    return _meet(packed, block_series, ordered=True).applyInPandas(work, schema)


def pairwise_corr(panel: DataFrame, t: str, series: str, value: str,
                  block_series: int = BLOCK_SERIES) -> DataFrame:
    """Correlation of every pair of series over the periods both have (series < other)."""
    return _all_pairs(panel, t, series, value, block_series, "r")


def pairwise_cov(panel: DataFrame, t: str, series: str, value: str,
                 block_series: int = BLOCK_SERIES) -> DataFrame:
    """Covariance of every pair over the periods both have, variances included."""
    return _all_pairs(panel, t, series, value, block_series, "cov")


def best_predictors(panel: DataFrame, t: str, series: str, value: str, k: int = 20,
                    block_series: int = BLOCK_SERIES, digits: int = DIGITS) -> DataFrame:
    """For each series the others of strongest absolute correlation.

    The series itself takes part in the ranking and is dropped afterwards;
    equal strengths (to ``digits`` places) share their average rank, and a
    rank up to ``k`` is kept. A kept value is among the first 2k - 1 of its
    series, and a tie reaching beyond 2k has an average rank above k, so any 2k
    leading candidates are enough for the exact answer.
    """
    packed, periods = pack_series(panel, t, series, value)
    return strongest(packed, periods, k, block_series, digits)
