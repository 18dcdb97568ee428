"""Row selection and small reshapes before any estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.functions import column

def qc_hauls(df: DataFrame, haul_type: int = 3, min_performance: float = 0,
             min_year: int | None = None) -> DataFrame:
    """Standard, good hauls, from ``min_year`` on."""
    test = (F.col("haul_type") == haul_type) & (F.col("performance") >= min_performance)
    if min_year is not None:
        test = test & (F.col("year") >= min_year)
    return df.filter(test)


def years_from(df: DataFrame, first: int, last: int | None = None, year: str = "year") -> DataFrame:
    test = F.col(year) >= first
    return df.filter(test if last is None else test & (F.col(year) <= last))


def years_in(df: DataFrame, years: list[int], year: str = "year") -> DataFrame:
    return df.filter(F.col(year).isin(years))


def above(df: DataFrame, value: str, bound: float) -> DataFrame:
    """Rows with a value over ``bound``; missing values go as well."""
    return df.filter(F.col(value) > bound)


def positive_only(df: DataFrame, value: str) -> DataFrame:
    return above(df, value, 0)


def stack_tables(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column missing from one table is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def backfill_period(df: DataFrame, source, target, period: str = "year") -> DataFrame:
    """Rows of period ``source`` again under ``target``, replacing what was there."""
    copy = df.filter(F.col(period) == source).withColumn(
        period, F.lit(target).cast(df.schema[period].dataType)
    )
    return df.filter(F.col(period).isNull() | (F.col(period) != target)).unionByName(copy)


def densify(df: DataFrame, keys: list[str], category: str, value: str, fill=0.0,
            categories: list | None = None) -> DataFrame:
    """One row for every key and every category; absent or NULL cells get ``fill``.

    Each key is reduced to one row holding its cells as a map, and the
    categories (the columns a wide table would have, one array) are exploded
    beside it: one shuffle, no product join. (key, category) must be unique.
    """
    kind = T.ArrayType(df.schema[category].dataType)
    if categories is None:
        found = df.agg(F.sort_array(F.collect_set(category)))
        every = found.scalar()
    else:
        every = F.lit(categories).cast(kind)
    cells = df.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(
            F.when(F.col(category).isNotNull(), F.struct(category, value))
        )).alias("_cells")
    )
    return cells.select(
        *keys, F.explode(every).alias(category), "_cells"
    ).select(
        *keys, category,
        F.coalesce(F.try_element_at("_cells", F.col(category)), F.lit(fill)).alias(value),
    )


def collapse_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the mean of every numeric column, NULL if one is NULL."""
    from trawlframe.functions import strict_avg

    numeric = [
        f.name for f in df.schema.fields
        if f.name not in keys and isinstance(f.dataType, T.NumericType)
    ]
    return df.groupBy(*keys).agg(*[strict_avg(c).alias(c) for c in numeric])


def same_members(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many distinct rows are only in ``a``, only in ``b``, and the verdict."""
    sides = a.distinct().withColumn("_in", F.lit(1)).unionByName(
        b.distinct().withColumn("_in", F.lit(2))
    )
    per_row = sides.groupBy(*a.columns).agg(F.sum("_in").alias("_in"))
    return per_row.agg(
        F.count_if(F.col("_in") == 1).alias("only_left"),
        F.count_if(F.col("_in") == 2).alias("only_right"),
    ).withColumn("identical", (F.col("only_left") + F.col("only_right")) == 0)


def to_long(df: DataFrame, ids: list[str], names: list[str], name: str = "key",
            value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(ids, names, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list) -> DataFrame:
    """Long to wide for display, for a stated list of columns."""
    return df.groupBy(*ids).pivot(name, names).agg(F.first(column(value), ignorenulls=True))
