"""Exact running sums, ranks and quantiles within groups of any size.

A window over a group sends the whole group to one task. Here the rows are
range-partitioned on (group, order), so a group that holds a third of the
table is spread over many partitions; each partition is summed on its own and
the sums of the partitions before it are added. The range boundaries are
sampled, so the partitioned rows are materialised once and both branches read
that copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlframe.functions import column, safe_div
from trawlframe.session import cut_lineage, same_keys_join


def running_totals(df: DataFrame, by: list[str], order: list[Column],
                   sums: dict[str, Column]) -> DataFrame:
    """Add running sums, in ``order`` within ``by``, up to and including each row.

    Each name also gets ``<name>_total``, the sum of the whole group. ``order``
    must be total within a group (end it with an id). A count of rows is the
    sum of ``lit(1)``. NULL adds nothing.
    """
    values = {f"_v_{name}": F.coalesce(column(v), F.lit(0)) for name, v in sums.items()}
    rows = cut_lineage(
        df.withColumns(values)
        .repartitionByRange(*[F.col(c) for c in by], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    # One row for each group and slice: at most groups + slices rows in all.
    group = Window.partitionBy(*by)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "_slice")
        .agg(*[F.sum(v).alias(v) for v in values])
        .select(*by, "_slice", *[
            F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums
        ], *[F.sum(f"_v_{n}").over(group).alias(f"{n}_total") for n in sums])
    )
    within = (
        Window.partitionBy(*by, "_slice").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumns({n: F.sum(f"_v_{n}").over(within) for n in sums})
    joined = same_keys_join(local, offsets, [*by, "_slice"], how="inner")
    return joined.withColumns({n: F.col(n) + F.col(f"_off_{n}") for n in sums}).drop(
        "_slice", *values, *[f"_off_{n}" for n in sums]
    )


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str]) -> DataFrame:
    """Quantiles by linear interpolation between order statistics.

    One row for each group, columns ``q_<percent>``. Equal values are counted
    together before the ordering, and only the two neighbours of each
    position leave the last aggregation.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counts, by, [F.col(value)], {"_upto": F.col("_n")})
    aggregates = []
    for p in probs:
        position = (F.col("_upto_total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        aggregates += [
            F.min(F.when(F.col("_upto") > low, F.col(value))).alias(f"_lo_{_pct(p)}"),
            F.min(F.when(F.col("_upto") > high, F.col(value))).alias(f"_hi_{_pct(p)}"),
            F.max(position - low).alias(f"_frac_{_pct(p)}"),
        ]
    found = ranked.groupBy(*by).agg(*aggregates)
    return found.select(*by, *[
        (F.col(f"_lo_{_pct(p)}")
         + F.col(f"_frac_{_pct(p)}") * (F.col(f"_hi_{_pct(p)}") - F.col(f"_lo_{_pct(p)}"))
         ).alias(f"q_{_pct(p)}")
        for p in probs
    ])


def weighted_quantiles(df: DataFrame, value: str, weight: str, probs: list[float],
                       by: list[str]) -> DataFrame:
    """Quantiles of the weighted distribution, interpolated between its steps.

    The cumulative share of weight is taken at each distinct value; a quantile
    lies on the straight line between the two values whose shares enclose it,
    and is the smallest value below the first share.
    """
    points = (
        df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull())
        .groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    )
    ranked = running_totals(points, by, [F.col(value)], {"_cum": F.col("_w")})
    ranked = ranked.withColumn("_share", safe_div("_cum", "_cum_total"))
    step = F.struct(F.col("_share").alias("share"), F.col(value).alias("x"))
    aggregates = []
    for p in probs:
        aggregates += [
            F.max(F.when(F.col("_share") <= p, step)).alias(f"_lo_{_pct(p)}"),
            F.min(F.when(F.col("_share") > p, step)).alias(f"_hi_{_pct(p)}"),
        ]
    found = ranked.groupBy(*by).agg(*aggregates)
    out = []
    for p in probs:
        low, high = F.col(f"_lo_{_pct(p)}"), F.col(f"_hi_{_pct(p)}")
        between = low["x"] + (p - low["share"]) / (high["share"] - low["share"]) * (
            high["x"] - low["x"]
        )
        out.append(
            F.when(low.isNull(), high["x"]).when(high.isNull(), low["x"])
            .otherwise(between).alias(f"q_{_pct(p)}")
        )
    return found.select(*by, *out)


def weighted_median(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    return weighted_quantiles(df, value, weight, [0.5], by)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of the whole table with their place.

    ``orderBy().limit()`` keeps k rows in each task and merges those, so the
    final numbering sees k rows.
    """
    first = df.orderBy(*order).limit(k)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def _pct(p: float) -> str:
    return f"{p * 100:g}".replace(".", "_")
