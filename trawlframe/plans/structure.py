"""Spatial structure of every taxon in one plan; the taxon is a grouping column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.functions import fourth_root
from trawlframe.operators.joins import full_by_key
from trawlframe.operators.panel import balanced_panel, drop_zero_series, station_position
from trawlframe.operators.pca import spatial_pca
from trawlframe.operators.spatial import inertia, shannon_diversity, temperature_in_range
from trawlframe.session import cut_lineage


def taxon_cells(rows: DataFrame, taxon: str = "taxon", cpue: str = "cpue") -> DataFrame:
    """Mean CPUE by taxon, year and station, for stations of every year that hold the taxon.

    Expects year, station, lon, lat, temperature and CPUE for each haul and
    taxon; adds the station's mean position.
    """
    hauls = rows.select("year", "station", "lon", "lat").distinct()
    full = balanced_panel(hauls, "station", "year", "lat", "every_period")
    positions = station_position(full)
    means = rows.groupBy(taxon, "year", "station").agg(F.avg(cpue).alias(cpue))
    kept = drop_zero_series(
        means.join(positions.select("station"), "station", "left_semi"), "station", cpue, [taxon])
    return kept.join(positions, "station")


def taxon_structure(rows: DataFrame, temp: str, taxon: str = "taxon",
                    cpue: str = "cpue") -> dict[str, DataFrame]:
    """``indices`` (temperature in range, diversity, centre, inertia) and the components."""
    cells = cut_lineage(taxon_cells(rows, taxon, cpue))
    by = [taxon, "year"]
    temps = rows.select(taxon, "year", "station", temp).join(
        cells.select(taxon, "station", "year", cpue), [taxon, "station", "year"], "right")
    indices = full_by_key([
        temperature_in_range(temps, temp, taxon, cpue),
        shannon_diversity(cells, cpue, by),
        inertia(cells, "lon", "lat", cpue, None, by),
    ], by)
    parts = spatial_pca(cells.withColumn("_root", fourth_root(cpue)), "year", "station", "_root", [taxon])
    return {"indices": indices, **parts}
