"""Aggregates that give NULL as soon as one input is NULL.

Spark aggregates skip NULL; a survey estimate with a missing station must not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "column", "strict", "strict_sum", "strict_avg", "strict_var", "strict_sd",
    "non_missing", "missing", "std_error", "weighted_mean",
]


def column(value) -> Column:
    """A Column from a column name or a Column."""
    return value if isinstance(value, Column) else F.col(value)


def strict(aggregate: Column, value) -> Column:
    """``aggregate`` if no value of the group is missing, else NULL."""
    return F.when(F.count(column(value)) == F.count(F.lit(1)), aggregate)


def strict_sum(value) -> Column:
    return strict(F.sum(column(value)), value)


def strict_avg(value) -> Column:
    return strict(F.avg(column(value)), value)


def strict_var(value) -> Column:
    """Sample variance; one value alone has none and gives NULL."""
    return strict(F.var_samp(column(value)), value)


def strict_sd(value) -> Column:
    return strict(F.stddev_samp(column(value)), value)


def non_missing(value) -> Column:
    return F.count(column(value))


def missing(value) -> Column:
    return F.count_if(column(value).isNull())


def std_error(value) -> Column:
    """Sample standard deviation over the root of the number of rows."""
    return strict_sd(value) / F.sqrt(F.count(F.lit(1)).cast("double"))


def weighted_mean(value, weight, null_weight: str = "skip") -> Column:
    """Mean of ``value`` weighted by ``weight``; missing values are left out.

    ``null_weight='skip'`` also leaves out rows without a weight;
    ``'propagate'`` gives NULL if a row with a value has no weight.
    Negative weights are kept.
    """
    value, weight = column(value), column(weight)
    both = value.isNotNull() & weight.isNotNull()
    mean = F.try_divide(
        F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight))
    )
    if null_weight == "skip":
        return mean
    if null_weight != "propagate":
        raise ValueError("null_weight is 'skip' or 'propagate'")
    return F.when(F.count_if(value.isNotNull() & weight.isNull()) == 0, mean)
