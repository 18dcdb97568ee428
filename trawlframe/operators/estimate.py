"""Stratified estimates of abundance and CPUE with their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.functions import (
    normal_ci, safe_div, split_class_label, strict_avg, strict_sum, strict_var,
)
from trawlframe.operators.ordered import weighted_quantiles
from trawlframe.operators.prep import densify
from trawlframe.session import attach_groups, cut_lineage

REGION = ["year", "region"]
MILLION = 1_000_000.0


def stratum_stats(cpue: DataFrame, stratum: str = "stratum_crab", by=REGION,
                  cls: str = "size_sex") -> DataFrame:
    """Mean area, CPUE moments and expanded abundance (millions) of each stratum.

    One aggregation serves every estimate below; a stratum with one station
    has no variance and so no standard error.
    """
    stats = cpue.groupBy(*by, stratum, cls).agg(
        strict_avg("total_area").alias("total_area"),
        strict_avg("cpue").alias("mean_cpue"),
        strict_var("cpue").alias("var_cpue"),
        F.count(F.lit(1)).alias("n_stations"),
        strict_sum("num_crab").alias("num_crab"),
        strict_sum("area_swept").alias("area_swept"),
    )
    return _expand(stats)


def _expand(stats: DataFrame) -> DataFrame:
    area = F.col("total_area")
    return stats.withColumns({
        "abundance_mil": area * F.col("mean_cpue") / MILLION,
        "var_abund_mil": area * area * F.col("var_cpue") / (MILLION * MILLION),
    }).withColumns({
        "stderr_mil": F.sqrt(F.col("var_abund_mil") / F.col("n_stations")),
        "stderr_cpue": F.sqrt(F.col("var_cpue") / F.col("n_stations")),
    })


def _error(se: str, rule: str) -> Column:
    area = F.col("total_area")
    if rule == "sum":
        return strict_sum(se)
    if rule == "quadrature":
        return F.sqrt(strict_sum(F.col(se) * F.col(se)))
    if rule == "w2_sum":
        total = strict_sum("total_area")
        return safe_div(strict_sum(area * area * F.col(se)), total * total)
    raise ValueError("se_rule is 'sum', 'w2_sum' or 'quadrature'")


def _with_limits(df: DataFrame, estimate: str, se: str) -> DataFrame:
    low, high = normal_ci(estimate, se)
    return df.withColumns({"lwr_95": low, "upp_95": high})


def abundance_naive(cpue: DataFrame, stratum: str = "stratum_crab", by=REGION,
                    cls: str = "size_sex", se_rule: str = "sum") -> DataFrame:
    """Regional abundance: the sum of the strata, standard errors summed too."""
    out = stratum_stats(cpue, stratum, by, cls).groupBy(*by, cls).agg(
        strict_sum("abundance_mil").alias("abundance_mil"),
        _error("stderr_mil", se_rule).alias("stderr_mil"),
    )
    return _with_limits(out, "abundance_mil", "stderr_mil")


def abundance_weighted(cpue: DataFrame, stratum: str = "stratum_crab", by=REGION,
                       cls: str = "size_sex", se_rule: str = "w2_sum") -> DataFrame:
    """Area-weighted mean of the stratum totals, with weighted errors."""
    return _weighted_abundance(stratum_stats(cpue, stratum, by, cls), by, cls, se_rule)


def _weighted_abundance(stats: DataFrame, by, cls: str, se_rule: str) -> DataFrame:
    area = F.col("total_area")
    out = stats.groupBy(*by, cls).agg(
        safe_div(strict_sum(area * F.col("abundance_mil")), strict_sum("total_area"))
        .alias("weighted_abundance"),
        _error("stderr_mil", se_rule).alias("stderr_mil"),
    )
    return _with_limits(out, "weighted_abundance", "stderr_mil")


def cpue_naive(cpue: DataFrame, stratum: str = "stratum_crab", by=REGION,
               cls: str = "size_sex", se_rule: str = "sum") -> DataFrame:
    """Regional CPUE as a ratio of sums; errors summed over strata."""
    out = stratum_stats(cpue, stratum, by, cls).groupBy(*by, cls).agg(
        safe_div(strict_sum("num_crab"), strict_sum("area_swept")).alias("cpue"),
        _error("stderr_cpue", se_rule).alias("stderr"),
    )
    return _with_limits(out, "cpue", "stderr")


def cpue_weighted(cpue: DataFrame, stratum: str = "stratum_crab", by=REGION,
                  cls: str = "size_sex", se_rule: str = "w2_sum") -> DataFrame:
    """Ratio of area-weighted sums; the weights' common divisor cancels."""
    area = F.col("total_area")
    out = stratum_stats(cpue, stratum, by, cls).groupBy(*by, cls).agg(
        safe_div(strict_sum(area * F.col("num_crab")), strict_sum(area * F.col("area_swept")))
        .alias("cpue"),
        _error("stderr_cpue", se_rule).alias("stderr"),
    )
    return _with_limits(out, "cpue", "stderr")


def abundance_1mm(stations: DataFrame, cells: DataFrame, stratum: str = "stratum_crab",
                  by=REGION, cls: str = "size_sex") -> DataFrame:
    """Weighted abundance of each 1 mm class, from the non-zero cells alone.

    ``stations`` and ``cells`` come from ``cpue_1mm_cells``. The stations
    without a catch of the class enter mean and variance by their number, so
    stations x classes is never written out: with m of n stations non-zero,
    the squares about the mean of all n are those about the mean of the m,
    plus m times the squared shift, plus (n - m) times the squared mean.
    """
    # Strata and regional sums are small and each is read several times below.
    strata = cut_lineage(stations.groupBy(*by, stratum).agg(
        F.count(F.lit(1)).alias("n_stations"),
        strict_avg("total_area").alias("total_area"),
    ))
    caught = cells.groupBy(*by, stratum, cls).agg(
        F.count(F.lit(1)).alias("_m"),
        F.avg("cpue").alias("_mean"),
        (F.var_pop("cpue") * F.count(F.lit(1))).alias("_squares"),
    )
    n, m, overall = F.col("n_stations"), F.col("_m"), F.col("mean_cpue")
    shift = F.col("_mean") - overall
    stats = _expand(
        caught.join(strata, [*by, stratum])
        .withColumn("mean_cpue", m * F.col("_mean") / n)
        .withColumn("var_cpue", safe_div(
            F.col("_squares") + m * shift * shift + (n - m) * overall * overall, n - 1
        ))
    )
    area = F.col("total_area")
    region = strata.groupBy(*by).agg(
        F.sum("total_area").alias("_area"),
        F.min("n_stations").alias("_fewest"),
    )
    sums = cut_lineage(stats.groupBy(*by, cls).agg(
        F.struct(
            F.sum(area * F.col("abundance_mil")).alias("a"),
            F.sum(area * area * F.col("stderr_mil")).alias("e"),
        ).alias("_sums")
    ))
    # Every class of the data appears in every region and year, at the level
    # of the result, where the table is small.
    empty = region.select(*by, F.lit(None).cast("string").alias(cls),
                          F.lit(None).cast(sums.schema["_sums"].dataType).alias("_sums"))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("e"))
    dense = densify(
        sums.unionByName(empty).withColumn("_sums", F.coalesce("_sums", zero)),
        list(by), cls, "_sums", fill=None,
    ).withColumn("_sums", F.coalesce("_sums", zero))
    out = dense.join(region, list(by)).select(
        *by, cls,
        safe_div(F.col("_sums.a"), F.col("_area")).alias("weighted_abundance"),
        F.when(F.col("_fewest") > 1, safe_div(F.col("_sums.e"), F.col("_area") * F.col("_area")))
        .alias("stderr_mil"),
    )
    return _with_limits(out, "weighted_abundance", "stderr_mil")


def size_composition(abundance: DataFrame, region: str = "NBS", min_size: float = 30,
                     value: str = "weighted_abundance", cls: str = "size_sex") -> DataFrame:
    """Share of each width within year and sex, with median and 90 % width."""
    sex, size = split_class_label(cls)
    kept = (
        abundance.withColumns({"sex": sex, "size": size})
        .filter((F.col("size") >= min_size) & (F.col(value) != 0) & (F.col("region") == region))
        .groupBy("year", "sex", "size").agg(F.sum(value).alias("abundance_mil"))
    )
    # One row for each class; three branches read it and the whole survey is behind it.
    kept = cut_lineage(kept)
    by = ["year", "sex"]
    shares = attach_groups(kept, kept.groupBy(*by).agg(F.sum("abundance_mil").alias("_t")), by)
    shares = shares.withColumn("w", safe_div("abundance_mil", "_t")).drop("_t")
    marks = weighted_quantiles(kept, "size", "abundance_mil", [0.5, 0.9], by)
    marks = marks.withColumnsRenamed({"q_50": "median_size", "q_90": "q90_size"})
    return attach_groups(shares, marks, by)
