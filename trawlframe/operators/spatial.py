"""Where a population sits: centre, spread, areas, and temperature indices."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.functions import (
    STATION_AREA_NM2, log_positive, safe_div, strict_avg, strict_sum, weighted_mean,
    zero_to_null,
)
from trawlframe.operators.ordered import running_totals
from trawlframe.session import attach_single, cut_lineage, same_keys_join


# -- area holding 95 % of the catch --------------------------------------------

def d95_members(df: DataFrame, value: str, by: list[str], station: str = "station",
                threshold: float = 0.95) -> DataFrame:
    """Stations by falling value, with the running share and the membership flag.

    A station belongs while the running share stays at or below the
    threshold, so the one crossing it is out. Ties go by station. A missing
    value anywhere in a group makes the group's shares missing.
    """
    order = [F.col(value).desc_nulls_last(), F.col(station)]
    sums = {"_upto": F.col(value), "_gap": F.col(value).isNull().cast("int")}
    ranked = running_totals(df, by, order, sums)
    total = F.when(F.col("_gap_total") == 0, F.col("_upto_total"))
    return ranked.withColumns({
        "share": F.try_divide(F.col(value), total),
        "cumulative_share": F.try_divide(F.col("_upto"), total),
    }).withColumn("d95", F.col("cumulative_share") <= threshold).drop(
        "_upto", "_gap", "_upto_total", "_gap_total")


def d95_area(members: DataFrame, by: list[str], area: float = STATION_AREA_NM2) -> DataFrame:
    """Area of the member stations."""
    return members.groupBy(*by).agg((F.count_if("d95") * F.lit(area)).alias("d95_area"))


# -- centre, inertia, axes -------------------------------------------------------

# Squares from a power of two to the next, and the part of a sum's terms that is rounding.
SQUARES = 1024
ROUNDING = 1e-15


def _points(df: DataFrame, x, y, z, w, by) -> DataFrame:
    """x, y and the weight z w; rows with anything missing carry no weight."""
    z = F.lit(1.0) if z is None else F.col(z)
    w = F.lit(1.0) if w is None else F.col(w)
    whole = (F.col(x) * F.col(y) * z * w).isNotNull()
    return df.select(
        *by, *[F.when(whole, c).alias(n) for c, n in
               ((F.col(x), "_x"), (F.col(y), "_y"), (z * w, "_q"))]
    )


def _centre(points: DataFrame, by) -> DataFrame:
    q = F.sum("_q")
    return points.groupBy(*by).agg(
        safe_div(F.sum(F.col("_x") * F.col("_q")), q).alias("xcg"),
        safe_div(F.sum(F.col("_y") * F.col("_q")), q).alias("ycg"),
    )


def center_of_gravity(df: DataFrame, x: str, y: str, z: str | None, w: str | None,
                      by: list[str]) -> DataFrame:
    """Mean position weighted by density z and area w (1 where absent)."""
    return _centre(_points(df, x, y, z, w, by), by)


def _middle(value: Column) -> Column:
    """Middle of the value's interval, a SQUARES-th of the power of two below it wide; 0 for 0."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value)))) / SQUARES
    return F.when(value == 0, F.lit(0.0)).otherwise((F.floor(value / width) + 0.5) * width)


def _moments(df: DataFrame, x, y, z, w, by) -> DataFrame:
    """Centre, and second moments about it divided by the total weight.

    Sums of squares about zero would lose the digits that matter at
    longitudes near -180. The points are summed about the middle of a square
    first, and the squares' sums (one row for each occupied square) are then
    moved to the centre of their group, which is joined back to the squares
    alone. A square's sides are a 1024th of the power of two below the
    coordinate, so they follow from the point itself, in any unit, and the data are read
    once; what its sums lose is no more than what the coordinates' own digits hold
    back. A moment that only rounding keeps from zero, measured by the sum of its
    terms' sizes, is zero.
    """
    points = _points(df, x, y, z, w, by)
    tx, ty = F.col("_tx"), F.col("_ty")
    near = points.withColumns({"_tx": _middle(F.col("_x")), "_ty": _middle(F.col("_y"))})
    dx, dy, q = F.col("_x") - tx, F.col("_y") - ty, F.col("_q")
    squares = cut_lineage(near.groupBy(*by, "_tx", "_ty").agg(
        F.sum(q).alias("_n"), F.sum(q * dx).alias("_dx"), F.sum(q * dy).alias("_dy"),
        F.sum(q * dx * dx).alias("_dxx"), F.sum(q * dy * dy).alias("_dyy"),
        F.sum(q * dx * dy).alias("_dxy"),
    ))
    n = F.col("_n")
    centres = squares.groupBy(*by).agg(
        safe_div(F.sum(n * tx + F.col("_dx")), F.sum(n)).alias("xcg"),
        safe_div(F.sum(n * ty + F.col("_dy")), F.sum(n)).alias("ycg"))
    centred = same_keys_join(squares, centres, by) if by else attach_single(squares, centres)
    sx, sy = tx - F.col("xcg"), ty - F.col("ycg")
    terms = {
        "_a": [F.col("_dxx"), 2.0 * sx * F.col("_dx"), sx * sx * n],
        "_c": [F.col("_dyy"), 2.0 * sy * F.col("_dy"), sy * sy * n],
        "_b": [F.col("_dxy"), sx * F.col("_dy"), sy * F.col("_dx"), sx * sy * n],
    }
    out = centred.groupBy(*by).agg(
        F.first("xcg", ignorenulls=True).alias("xcg"),
        F.first("ycg", ignorenulls=True).alias("ycg"),
        *[safe_div(F.sum(reduce(add, t)), F.sum(n)).alias(name) for name, t in terms.items()],
        *[safe_div(F.sum(reduce(add, map(F.abs, t))), F.sum(n)).alias(f"{name}_size")
          for name, t in terms.items()],
    )
    flat = {c: F.when(F.abs(c) <= ROUNDING * F.abs(f"{c}_size"), F.lit(0.0)).otherwise(F.col(c))
            for c in terms}
    return out.withColumns(flat).drop(*[f"{c}_size" for c in terms])


def _with_principal(moments: DataFrame) -> DataFrame:
    """Largest and smallest inertia: the eigenvalues of the 2 x 2 moments."""
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    root = F.sqrt((a - c) * (a - c) + 4.0 * b * b)
    low = F.greatest((a + c - root) / 2.0, F.when(a.isNotNull(), F.lit(0.0)))
    return moments.withColumns({
        "inertia": a + c, "imax": (a + c + root) / 2.0, "imin": low,
    }).withColumn("iso", F.sqrt(safe_div("imin", "imax")))


def inertia(df: DataFrame, x: str, y: str, z: str | None, w: str | None,
            by: list[str]) -> DataFrame:
    """Centre and mean squared distance to it."""
    return _moments(df, x, y, z, w, by).select(
        *by, "xcg", "ycg", (F.col("_a") + F.col("_c")).alias("inertia")
    )


def anisotropy(df: DataFrame, x: str, y: str, z: str | None, w: str | None,
               by: list[str]) -> DataFrame:
    """Inertia along the principal axes and its isotropy."""
    return _with_principal(_moments(df, x, y, z, w, by)).select(
        *by, "xcg", "ycg", "inertia", "imax", "imin", "iso"
    )


def inertia_axes(df: DataFrame, x: str, y: str, z: str | None, w: str | None,
                 by: list[str]) -> DataFrame:
    """End points of both principal axes, one standard deviation from the centre.

    Each axis is two arrays [x1, x2] and [y1, y2], the end with the smaller x
    (then y) first.
    """
    m = _with_principal(_moments(df, x, y, z, w, by))
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    # Direction of the largest inertia; for b = 0 the axes are the coordinates.
    along_x = F.when(b != 0, b).when(a >= c, F.lit(1.0)).otherwise(F.lit(0.0))
    along_y = F.when(b != 0, F.col("imax") - a).when(a >= c, F.lit(0.0)).otherwise(F.lit(1.0))
    norm = F.sqrt(along_x * along_x + along_y * along_y)
    m = m.withColumns({"_ux": along_x / norm, "_uy": along_y / norm})
    first = _ends(F.col("_ux"), F.col("_uy"), F.sqrt("imax"))
    second = _ends(-F.col("_uy"), F.col("_ux"), F.sqrt("imin"))
    return m.withColumns({"_e1": first, "_e2": second}).select(
        *by, "xcg", "ycg",
        F.col("_e1.x").alias("xaxe1"), F.col("_e1.y").alias("yaxe1"),
        F.col("_e2.x").alias("xaxe2"), F.col("_e2.y").alias("yaxe2"),
    )


def _ends(ux, uy, length):
    """Struct of the ends' x values and y values, the smaller end first."""
    ends = F.array_sort(F.array(*[
        F.struct((F.col("xcg") + s * ux * length).alias("x"),
                 (F.col("ycg") + s * uy * length).alias("y")) for s in (1.0, -1.0)
    ]))
    return F.struct(
        F.transform(ends, lambda e: e["x"]).alias("x"),
        F.transform(ends, lambda e: e["y"]).alias("y"),
    )


def collocation_index(pop1: DataFrame, pop2: DataFrame, by: list[str]) -> DataFrame:
    """Overlap of two populations given their ``inertia`` tables; 1 if undefined."""
    a, b = pop1.alias("a"), pop2.alias("b")
    both = a.join(b, by)
    d = (F.col("a.xcg") - F.col("b.xcg")) ** 2 + (F.col("a.ycg") - F.col("b.ycg")) ** 2
    apart = safe_div(d, d + F.col("a.inertia") + F.col("b.inertia"))
    return both.select(*by, F.coalesce(1.0 - apart, F.lit(1.0)).alias("gic"))


# -- areas -------------------------------------------------------------------------

def spatial_abundance(df: DataFrame, z: str, w: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(F.col(z) * F.col(w)), F.lit(0.0)).alias("abundance")
    )


def positive_area(df: DataFrame, z: str, w: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col(z) > 0, F.col(w))), F.lit(0.0)).alias("positive_area")
    )


def equivalent_area(df: DataFrame, z: str, w: str, by: list[str]) -> DataFrame:
    """Area the population would cover at its mean density per individual."""
    q = F.sum(F.col(z) * F.col(w))
    return df.groupBy(*by).agg(
        safe_div(q * q, F.sum(F.col(z) * F.col(z) * F.col(w))).alias("equivalent_area")
    )


def _by_density(df: DataFrame, z: str, w: str, by: list[str]) -> DataFrame:
    """Area and abundance at each distinct density, with running sums upwards.

    Points of equal density enter the formulas only through their sums, so
    they are put together first: a third of a group at one density is one row.
    """
    points = df.filter(F.col(z).isNotNull()).groupBy(*by, z).agg(
        strict_sum(w).alias("_w"), strict_sum(F.col(z) * F.col(w)).alias("_q")
    )
    run = running_totals(points, by, [F.col(z)], {
        "_area": F.col("_w"), "_upto": F.col("_q"), "_gap": F.col("_q").isNull().cast("int")})
    whole = F.col("_gap_total") == 0
    return run.withColumns({
        "_total_area": F.when(whole, F.col("_area_total")),
        "_total": F.when(whole, F.col("_upto_total")),
    })


def spreading_area(df: DataFrame, z: str, w: str, by: list[str]) -> DataFrame:
    """Twice the area under the curve of abundance left against area taken."""
    run = _by_density(df, z, w, by)
    # (before + after) w, where before is the running sum without the row.
    step = (2.0 * F.col("_upto") - F.col("_q")) * F.col("_w")
    return run.groupBy(*by).agg(
        safe_div(F.sum(step), F.max("_total")).alias("spreading_area")
    )


def spreading_curve(df: DataFrame, z: str, w: str, by: list[str]) -> DataFrame:
    """Points (area taken, share of abundance left), densest first.

    Densities are taken from the highest down; ``density`` is the value whose
    points were taken last. The start (0, 1) has no density.
    """
    run = _by_density(df, z, w, by)
    taken_area = F.col("_total_area") - F.col("_area") + F.col("_w")
    taken = F.col("_total") - F.col("_upto") + F.col("_q")
    points = run.select(
        *by, F.col(z).alias("density"), taken_area.alias("area"),
        safe_div(F.col("_total") - taken, F.col("_total")).alias("left"),
    )
    start = df.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("density"), F.lit(0.0).alias("area"),
        F.lit(1.0).alias("left"),
    )
    return points.unionByName(start)


def shannon_diversity(df: DataFrame, z: str, by: list[str], base: float = 2) -> DataFrame:
    """Diversity of the positive values; 0 where none is positive.

    With Q the total, -sum(p log p) = log Q - sum(z log z) / Q, so one
    aggregation is enough.
    """
    value = F.when(F.col(z) > 0, F.col(z))
    q = F.sum(value)
    nats = F.ln(q) - safe_div(F.sum(value * F.ln(value)), q)
    return df.groupBy(*by).agg(
        F.coalesce(nats / F.ln(F.lit(float(base))), F.lit(0.0)).alias("diversity")
    )


# -- temperature ---------------------------------------------------------------------

def temperature_of_occupancy(df: DataFrame, temp: str, cpue: str, by: list[str],
                             null_weight: str = "skip") -> DataFrame:
    """Mean temperature: plain, weighted by CPUE, and by log CPUE (zeros are missing)."""
    weights = df.withColumn("_w", zero_to_null(cpue))
    return weights.groupBy(*by).agg(
        F.avg(temp).alias("raw_temp"),
        weighted_mean(temp, "_w", null_weight).alias("occupied_temp"),
        weighted_mean(temp, log_positive("_w"), null_weight).alias("log_occupied_temp"),
    )


def temperature_in_range(df: DataFrame, temp: str, taxon: str, cpue: str,
                         station: str = "station", t: str = "year") -> DataFrame:
    """Yearly mean temperature over the stations where a taxon ever occurs."""
    ever = df.groupBy(taxon, station).agg(F.sum(cpue).alias("_s")).filter(F.col("_s") > 0)
    return df.join(ever, [taxon, station], "left_semi").groupBy(taxon, t).agg(
        F.avg(temp).alias("mean_temp")
    )


def mean_bottom_temperature(temps: DataFrame, temp: str, t: str = "year") -> DataFrame:
    return temps.groupBy(t).agg(strict_avg(temp).alias("mean_bt"))


def cold_pool_area(temps: DataFrame, temp: str, excluded: DataFrame | None = None,
                   station: str = "station", t: str = "year", below: float = 2.0,
                   area: float = STATION_AREA_NM2) -> DataFrame:
    """Area of the stations colder than ``below``; a year with none has no row."""
    cold = temps.filter(F.col(temp) < below)
    if excluded is not None:
        cold = cold.join(excluded.select(station), station, "left_anti")
    return cold.groupBy(t).agg((F.count(F.lit(1)) * F.lit(area)).alias("cpa"))


def cold_pool_center(temps: DataFrame, hauls: DataFrame, temp: str,
                     excluded: DataFrame | None = None, station: str = "station",
                     t: str = "year", below: float = 2.0, lat: str = "lat") -> DataFrame:
    """Mean latitude of the stations colder than ``below``."""
    cold = temps.filter(F.col(temp) < below).select(t, station, temp)
    if excluded is not None:
        cold = cold.join(excluded.select(station), station, "left_anti")
    return hauls.select(t, station, lat).join(cold, [t, station], "right").groupBy(t).agg(
        F.avg(lat).alias("cp_cod")
    )


def latitude_center(grid: DataFrame, lat: str, density: str, presence: str,
                    by: list[str]) -> DataFrame:
    """Density-weighted mean latitude and mean presence of a predicted grid."""
    return grid.groupBy(*by).agg(
        weighted_mean(lat, density, "propagate").alias("mean_lat"),
        F.avg(presence).alias("mean_presence"),
    )
