"""The joins of the survey tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catch_with_hauls(catch: DataFrame, haul: DataFrame, on: list[str],
                     effort_side: str = "haul") -> DataFrame:
    """Catch and haul records side by side, clashing names marked ``_haul``.

    ``effort_side='haul'`` keeps hauls without catch (full outer join);
    ``'catch'`` loses them, as a filter on a catch column does.
    """
    clash = [c for c in haul.columns if c in catch.columns and c not in on]
    right = haul.withColumnsRenamed({c: f"{c}_haul" for c in clash})
    return catch.join(right, on, "full" if effort_side == "haul" else "left")


def with_strata(stations: DataFrame, strata: DataFrame, on=("year", "station"),
                effort: str = "area_swept") -> DataFrame:
    """Every stratum row with its station's data; rows without effort go."""
    return stations.join(strata, list(on), "right").filter(F.col(effort).isNotNull())


def with_second_strata(df: DataFrame, strata: DataFrame, on=("year", "station")) -> DataFrame:
    """All rows of ``df`` with a second stratification (twice for double hauls)."""
    return strata.join(df, list(on), "right")


def full_by_key(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full join of yearly tables on shared keys."""
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def keep_members(df: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    return df.join(members, on, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    return df.join(members, on, "left_anti")


def align_by_key(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Columns of ``other`` beside ``df``, matched by key and never by position.

    ``has_match`` tells whether the key was found.
    """
    return df.join(other.withColumn("_found", F.lit(True)), on, "left").withColumn(
        "has_match", F.coalesce(F.col("_found"), F.lit(False))
    ).drop("_found")
