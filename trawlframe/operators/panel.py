"""Which stations count: balanced panels, minimum data, duplicates, positions.

A panel is long: (t, series, value). Station statistics are aggregated and
joined back (semi joins and key joins, which adaptive execution can split when
one station is hot); nothing is pivoted to a column for each station.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.functions import missing, non_missing, strict_avg
from trawlframe.session import attach_groups, same_keys_join, single_value


def counts_by_period(df: DataFrame, series: str, t: str, value: str) -> DataFrame:
    """Non-missing and missing values for each (t, series)."""
    return df.groupBy(t, series).agg(
        non_missing(value).alias("n_present"), missing(value).alias("n_missing")
    )


def counts_by_series(df: DataFrame, series: str, t: str, value: str) -> DataFrame:
    """Column totals of :func:`counts_by_period`, and the number of periods seen."""
    return counts_by_period(df, series, t, value).groupBy(series).agg(
        F.sum("n_present").alias("n_present"), F.sum("n_missing").alias("n_missing"),
        F.count(F.lit(1)).alias("n_periods"),
    )


def frequency_of_missing(df: DataFrame, series: str, t: str, value: str) -> DataFrame:
    """How many series lack how many values."""
    return counts_by_series(df, series, t, value).groupBy("n_missing").agg(
        F.count(F.lit(1)).alias("n_series")
    )


def number_of_periods(df: DataFrame, t: str) -> int:
    return single_value(df.agg(F.count_distinct(t)))


def complete_series(df: DataFrame, series: str, t: str, value: str, mode: str = "count",
                    n_periods: int | None = None) -> DataFrame:
    """The series that a balanced panel keeps.

    ``mode='count'``: as many non-missing rows as there are periods, so a
    second haul can hide a missing year or expel a complete station.
    ``mode='every_period'``: a row in each period.
    """
    if n_periods is None:
        n_periods = number_of_periods(df, t)
    if mode == "count":
        kept = df.groupBy(series).agg(non_missing(value).alias("_n"))
    elif mode == "every_period":
        kept = df.groupBy(series).agg(F.count_distinct(t).alias("_n"))
    else:
        raise ValueError("mode is 'count' or 'every_period'")
    return kept.filter(F.col("_n") == n_periods).select(series)


def balanced_panel(df: DataFrame, series: str, t: str, value: str, mode: str = "count",
                   n_periods: int | None = None) -> DataFrame:
    """The rows of the series that are complete over the periods."""
    return df.join(complete_series(df, series, t, value, mode, n_periods), series, "left_semi")


def min_observations(df: DataFrame, series: str, value: str, k: int = 10) -> DataFrame:
    """Rows of the series with at least ``k`` non-missing values."""
    enough = df.groupBy(series).agg(non_missing(value).alias("_n")).filter(F.col("_n") >= k)
    return df.join(enough, series, "left_semi")


def drop_empty_series(df: DataFrame, series: str, value: str) -> DataFrame:
    """Rows of the series that have any value at all."""
    return min_observations(df, series, value, 1)


def drop_zero_series(df: DataFrame, series: str, value: str, by: list[str]) -> DataFrame:
    """Rows of the (by, series) pairs whose values do not sum to zero."""
    keys = [*by, series]
    caught = df.groupBy(*keys).agg(F.sum(value).alias("_s")).filter(F.col("_s") > 0)
    return df.join(caught, keys, "left_semi")


def station_position(df: DataFrame, station: str = "station", t: str = "year",
                     two_level: bool = True, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Mean position; by default the mean of the yearly means."""
    if two_level:
        df = df.groupBy(station, t).agg(F.avg(lon).alias(lon), F.avg(lat).alias(lat))
    return df.groupBy(station).agg(F.avg(lon).alias(lon), F.avg(lat).alias(lat))


def position_deviation(df: DataFrame, station: str = "station", t: str = "year",
                       lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Largest shift of a station's yearly position from its mean.

    ``*_max`` is the signed maximum, ``*_abs`` the largest absolute shift.
    The extremes determine both, so no second pass over the rows is needed.
    """
    yearly = df.groupBy(station, t).agg(F.avg(lon).alias(lon), F.avg(lat).alias(lat))
    ends = yearly.groupBy(station).agg(*[
        f(c).alias(f"_{n}_{c}")
        for c in (lon, lat) for n, f in (("m", F.avg), ("hi", F.max), ("lo", F.min))
    ])
    out = []
    for c in (lon, lat):
        up, down = F.col(f"_hi_{c}") - F.col(f"_m_{c}"), F.col(f"_m_{c}") - F.col(f"_lo_{c}")
        out += [up.alias(f"{c}_max"), F.greatest(up, down).alias(f"{c}_abs")]
    return ends.select(station, *out)


def gaps(df: DataFrame, series: str, t: str, value: str) -> DataFrame:
    """The (t, series) combinations without a value."""
    periods = df.agg(F.sort_array(F.collect_set(t))).scalar()
    present = df.filter(F.col(value).isNotNull()).select(t, series)
    grid = df.select(series).distinct().select(F.explode(periods).alias(t), series)
    return grid.join(present, [t, series], "left_anti")


def assert_no_gaps(df: DataFrame, series: str, t: str, value: str) -> DataFrame:
    """``df`` itself; raises if a series lacks a period."""
    found = gaps(df, series, t, value).limit(5).collect()
    if found:
        raise ValueError(f"missing series/period combinations, for example {found}")
    return df


def find_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    double = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return df.join(double, keys, "left_semi")


def crowded_series(df: DataFrame, series: str, t: str) -> DataFrame:
    """Series with more rows than there are periods, with their row count."""
    n_periods = number_of_periods(df, t)
    return df.groupBy(series).agg(F.count(F.lit(1)).alias("n_rows")).filter(
        F.col("n_rows") > n_periods
    )


def anomaly(df: DataFrame, t: str, value: str, by: list[str] | None = None,
            skip_missing: bool = False, out: str = "anomaly") -> DataFrame:
    """Value minus the mean over all series of its period."""
    keys = [*(by or []), t]
    mean = F.avg(value) if skip_missing else strict_avg(value)
    return attach_groups(df, df.groupBy(*keys).agg(mean.alias("_mean")), keys).withColumn(
        out, F.col(value) - F.col("_mean")
    ).drop("_mean")


def z_score(df: DataFrame, series: list[str], value: str, out: str = "z") -> DataFrame:
    """Value standardised by its series' mean and sample standard deviation."""
    stats = df.groupBy(*series).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd")
    )
    return same_keys_join(df, stats, series).withColumn(
        out, F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))
    ).drop("_mean", "_sd")


def share_of_total(df: DataFrame, by: list[str], value: str, out: str = "share") -> DataFrame:
    """Value over the strict total of its group."""
    from trawlframe.functions import strict_sum

    totals = df.groupBy(*by).agg(strict_sum(value).alias("_total"))
    return attach_groups(df, totals, by).withColumn(
        out, F.try_divide(F.col(value), F.col("_total"))
    ).drop("_total")


def count_beside(df: DataFrame, series: str, value: str, out: str = "n_values") -> DataFrame:
    """The number of non-missing values of the series beside each row."""
    counts = df.groupBy(series).agg(non_missing(value).alias(out))
    return same_keys_join(df, counts, [series])


def minimum_difference(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Value minus the smallest of its group."""
    least = df.groupBy(*by).agg(F.min(value).alias("_least")) if by else df.agg(
        F.min(value).alias("_least"))
    return attach_groups(df, least, by).withColumn(out, F.col(value) - F.col("_least")).drop("_least")
