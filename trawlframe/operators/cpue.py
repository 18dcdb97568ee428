"""From catch, haul and stratum records to catch per unit effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.functions import (
    SIZE_SEX_BOUNDS, area_swept, class_label, cpue, recode, region_from_district,
    size_sex_class, width_bin_1mm,
)
from trawlframe.operators.joins import with_second_strata, with_strata
from trawlframe.operators.prep import densify
from trawlframe.session import spread

STATION_KEYS = ["year", "station", "lat", "lon", "area_swept"]
WIDE_KEYS = [*STATION_KEYS, "district", "stratum_crab", "stratum_fish", "total_area", "region"]
# Catch records from which on the joins keep all shuffle partitions: about what one merged partition holds.
SPREAD_ROWS = 2_000_000


def cpue_long(catch: DataFrame, haul: DataFrame, strata: DataFrame,
              fish_strata: DataFrame | None = None, bounds=SIZE_SEX_BOUNDS,
              on=("station", "year"), strict_catch: bool = True,
              effort_side: str = "haul", spread_out: bool | None = None) -> DataFrame:
    """CPUE of every size/sex class at every sampled station, zeros included.

    The catch is reduced to one row for each haul before it meets the hauls
    (a haul with a third of the records is summed map-side), the classes stay
    columns until the end, and every later step is keyed on (year, station),
    so the joins share one partitioning. The classes are literals, hence no
    second scan to complete them.

    Records of hauls that are not in the haul table have no effort and drop
    out with the stations that have none, so the full outer join of catch and
    hauls comes down to the hauls with their catch; ``effort_side='catch'``
    loses the hauls without catch as well.

    With ``strict_catch`` a class with any missing sampling factor counts as
    0 at that station; without, the known factors are summed.

    With ``spread_out`` the strata go over all shuffle partitions, and with them the joins:
    adaptive execution merges partitions by their size before a station becomes a row for
    each class, and a merged partition takes a task 15 times its size in sorts and hash tables.
    Left out, the records of the catch are counted: so it is beyond SPREAD_ROWS.
    """
    labels = [spec["label"] for spec in bounds]
    label = F.col("_class")
    sums = [
        F.sum(F.when(label == name, F.col("sample_factor"))).alias(f"_s{i}")
        for i, name in enumerate(labels)
    ]
    gaps = [
        F.count_if((label == name) & F.col("sample_factor").isNull()).alias(f"_g{i}")
        for i, name in enumerate(labels)
    ]
    by_haul = (
        catch.withColumn("_class", size_sex_class(bounds=bounds))
        .groupBy(*on).agg(*sums, *gaps)
    )
    strata = _spread_strata(catch, strata, on, spread_out)
    stations = _effort(haul, on).join(
        by_haul, list(on), "left" if effort_side == "haul" else "inner"
    ).groupBy(*STATION_KEYS).agg(*[
        F.sum(f"_{kind}{i}").alias(f"_{kind}{i}") for i in range(len(labels)) for kind in "sg"
    ])
    wide = _stratify(stations, haul if fish_strata is None else fish_strata, strata)
    cells = F.explode(F.array(*[
        F.struct(F.lit(name).alias("size_sex"), _filled(i, strict_catch).alias("num_crab"))
        for i, name in enumerate(labels)
    ]))
    return (
        wide.select(*WIDE_KEYS, cells.alias("_cell"))
        .select(*WIDE_KEYS, "_cell.size_sex", "_cell.num_crab")
        .withColumn("cpue", cpue())
    )


def cpue_1mm_cells(catch: DataFrame, haul: DataFrame, strata: DataFrame,
                   fish_strata: DataFrame | None = None, on=("station", "year"),
                   strict_catch: bool = True,
                   spread_out: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(stations, cells): all sampled stations, and CPUE where a class was caught.

    The classes are sex x 1 mm width, far more than any station catches, so
    the zeros are left implicit here; :func:`cpue_long_1mm` writes them out.
    ``spread_out`` is that of :func:`cpue_long`.
    """
    strata = _spread_strata(catch, strata, on, spread_out)
    effort = _effort(haul, on)
    fish = haul if fish_strata is None else fish_strata
    stations = _stratify(effort.select(*STATION_KEYS).distinct(), fish, strata)
    by_haul = (
        catch.withColumn("size_sex", class_label("sex", width_bin_1mm("cw")))
        .filter(F.col("size_sex").isNotNull())
        .groupBy(*on, "size_sex")
        .agg(F.sum("sample_factor").alias("_s0"),
             F.count_if(F.col("sample_factor").isNull()).alias("_g0"))
    )
    cells = (
        by_haul.join(effort, list(on))
        .groupBy(*STATION_KEYS, "size_sex")
        .agg(F.sum("_s0").alias("_s0"), F.sum("_g0").alias("_g0"))
        .select(*STATION_KEYS, "size_sex", _filled(0, strict_catch).alias("num_crab"))
    )
    cells = _stratify(cells, fish, strata).withColumn("cpue", cpue())
    return stations, cells.select(*WIDE_KEYS, "size_sex", "num_crab", "cpue")


def cpue_long_1mm(catch: DataFrame, haul: DataFrame, strata: DataFrame,
                  categories: list[str] | None = None, **options) -> DataFrame:
    """CPUE of every sex x 1 mm class at every sampled station, zeros included."""
    stations, cells = cpue_1mm_cells(catch, haul, strata, **options)
    known = cells.select(*WIDE_KEYS, "size_sex", "num_crab")
    empty = stations.select(*WIDE_KEYS, F.lit(None).cast("string").alias("size_sex"),
                            F.lit(None).cast("double").alias("num_crab"))
    dense = densify(known.unionByName(empty), WIDE_KEYS, "size_sex", "num_crab",
                    categories=categories)
    return dense.withColumn("cpue", cpue())


def _spread_strata(catch: DataFrame, strata: DataFrame, on, spread_out: bool | None) -> DataFrame:
    if spread_out is None:
        spread_out = catch.count() > SPREAD_ROWS
    if not spread_out:
        return strata
    return spread(strata, *(on if set(on) == {"station", "year"} else ("year", "station")))


def _effort(haul: DataFrame, on) -> DataFrame:
    extra = [c for c in ("year", "station") if c not in on]
    return haul.select(*on, *extra, "lat", "lon", area_swept().alias("area_swept"))


def _filled(i: int, strict_catch: bool) -> Column:
    total = F.coalesce(F.col(f"_s{i}"), F.lit(0.0))
    if strict_catch:
        return F.when(F.col(f"_g{i}") > 0, F.lit(0.0)).otherwise(total)
    return total


def _stratify(stations: DataFrame, fish_strata: DataFrame, strata: DataFrame) -> DataFrame:
    """Both stratifications, region and the crab stratum's one recoded number."""
    crab = strata.select("year", "station", "district", F.col("stratum").alias("stratum_crab"),
                         "total_area")
    fish = fish_strata.select("year", "station", "stratum_fish")
    both = with_second_strata(with_strata(stations, crab), fish)
    return both.withColumns({
        "region": region_from_district(),
        "stratum_crab": recode("stratum_crab", 999, 10),
    })
