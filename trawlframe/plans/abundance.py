"""Records to abundance and CPUE by every method, from one CPUE table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.functions import floor_at_zero, fourth_root, normal_ci, sex_from_group
from trawlframe.operators.bootstrap import abundance_bootstrap, cpue_bootstrap
from trawlframe.operators.cpue import cpue_long
from trawlframe.operators.estimate import (
    abundance_naive, abundance_weighted, cpue_naive, cpue_weighted,
)
from trawlframe.operators.series import factor_regression
from trawlframe.session import cut_lineage


def abundance_report(catch: DataFrame, haul: DataFrame, strata: DataFrame, reps: int = 1000,
                     seed: int = 1, method: str = "index", **options) -> dict[str, DataFrame]:
    """All estimates by name. The CPUE table has eight readers and is kept once."""
    cpue = cut_lineage(cpue_long(catch, haul, strata, **options))
    naive, ratio = abundance_naive(cpue), cpue_naive(cpue)
    return {
        "cpue_long": cpue,
        "abundance_naive": naive,
        "abundance_bootstrap": abundance_bootstrap(cpue, naive, reps, seed, method),
        "abundance_weighted_crab": abundance_weighted(cpue, "stratum_crab"),
        "abundance_weighted_fish": abundance_weighted(cpue, "stratum_fish"),
        "cpue_naive": ratio,
        "cpue_bootstrap": cpue_bootstrap(cpue, ratio, reps, seed, method),
        "cpue_weighted_crab": cpue_weighted(cpue, "stratum_crab"),
        "cpue_weighted_fish": cpue_weighted(cpue, "stratum_fish"),
    }


def stacked(report: dict[str, DataFrame], names: dict[str, str]) -> DataFrame:
    """Estimate and limits of several results below each other, for comparison.

    ``names`` maps a result to its column with the estimate.
    """
    parts = [
        report[name].select(
            F.lit(name).alias("method"), "year", "region", "size_sex",
            F.col(column).alias("estimate"), "lwr_95", "upp_95")
        for name, column in names.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def interannual_comparison(cpue: DataFrame, base_year: int, years: list[int] | None = None,
                           z: float = 1.96) -> DataFrame:
    """Fourth-root CPUE by year within region and class, with floored limits."""
    rows = cpue if years is None else cpue.filter(F.col("year").isin(years))
    out = factor_regression(rows, fourth_root("cpue"), "year", ["region", "size_sex"], base_year)
    low, high = normal_ci("estimate", "se_coef", z=z)
    return out.withColumns({
        "sex": sex_from_group(F.upper("size_sex")), "lower": floor_at_zero(low), "upper": high,
    })
