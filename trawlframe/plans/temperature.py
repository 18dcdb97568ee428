"""Haul temperatures to yearly indices, and occupied against raw temperature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.functions import station_key
from trawlframe.operators.impute import complete_panels, impute_panel
from trawlframe.operators.joins import full_by_key
from trawlframe.operators.panel import min_observations
from trawlframe.operators.prep import qc_hauls
from trawlframe.operators.series import cross_correlation, difference, pool_imputations
from trawlframe.operators.spatial import (
    cold_pool_area, cold_pool_center, mean_bottom_temperature, temperature_of_occupancy,
)
from trawlframe.session import cut_lineage

# Names of the corner stations, left out of the cold-pool area.
CORNER_STATIONS = [
    "QP2625", "ON2625", "HG2019", "JI2120", "IH1918",
    "GF2221", "HG1918", "GF2019", "ON2524", "PO2726",
    "IH2221", "GF1918", "JI2221", "JI2019", "JI1918",
    "HG2221", "QP2726", "PO2423", "IH2019", "PO2625",
    "QP2423", "IH2120", "PO2524", "HG2120", "GF2120",
    "QP2524",
]


def temperature_panel(hauls: DataFrame, min_year: int | None = None, min_obs: int = 10) -> DataFrame:
    """Good hauls' temperatures (year, station, gear_temp) of stations with enough values."""
    good = qc_hauls(hauls, min_year=min_year).withColumn("station", station_key())
    return min_observations(
        good.select("year", "station", "gear_temp"), "station", "gear_temp", min_obs)


def imputed_panel(panel: DataFrame, k: int = 20, m: int = 100, seed: int = 1) -> DataFrame:
    """Mean and errors of every (year, station) over m completed panels."""
    panel = cut_lineage(panel)
    copies = impute_panel(panel, "year", "station", "gear_temp", k, m, seed)
    complete = complete_panels(panel, copies, "year", "station", "gear_temp")
    return pool_imputations(complete, "year", "station", "gear_temp")


def temperature_indices(pooled: DataFrame, hauls: DataFrame, corners: DataFrame | None = None,
                        min_year: int | None = None, value: str = "mean") -> DataFrame:
    """Mean bottom temperature, cold-pool area and cold-pool centre by year.

    The corner stations, CORNER_STATIONS unless others are given, are left out of the
    area and stay in the centre.
    """
    if corners is None:
        corners = hauls.sparkSession.createDataFrame([(s,) for s in CORNER_STATIONS], "station string")
    positions = qc_hauls(hauls, min_year=min_year).withColumn("station", station_key())
    return full_by_key([
        mean_bottom_temperature(pooled, value),
        cold_pool_area(pooled, value, corners),
        cold_pool_center(pooled, positions, value),
    ], ["year"])


def occupancy_lags(stations: DataFrame, temp: str, cpue: str,
                   max_lag: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(yearly raw and occupied temperature with their difference, cross-correlations)."""
    yearly = cut_lineage(difference(
        temperature_of_occupancy(stations, temp, cpue, ["year"]), "raw_temp", "occupied_temp"))
    lags = cross_correlation(yearly, "year", "difference", "raw_temp", max_lag=max_lag)
    occupied = cross_correlation(yearly, "year", "occupied_temp", "raw_temp", max_lag=max_lag)
    both = lags.withColumn("pair", F.lit("difference")).unionByName(
        occupied.withColumn("pair", F.lit("occupied_temp")))
    return yearly, both
