"""Regular grids, nearest points, areas of influence, covariograms.

Everything works on distinct positions first: many records at one position
are one candidate, and ties between them are resolved afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.functions import inside_polygon, safe_div
from trawlframe.session import attach_groups, cut_lineage, same_keys_join, spread


def _pair(dlim) -> tuple[float, float, bool]:
    """(limit in x, limit in y, whether the limit is a rectangle)."""
    if isinstance(dlim, (tuple, list)):
        return float(dlim[0]), float(dlim[1]), True
    return float(dlim), float(dlim), False


def grid_geometry(points: DataFrame, dlim, n: int, by: list[str], x="x", y="y") -> DataFrame:
    """Origin, spacing and cell area of each group's grid: one row for each group.

    The bounding box is widened on all sides by the same proportion, at least
    twice the limit.
    """
    lx, ly, _ = _pair(dlim)
    box = points.groupBy(*by).agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")
    )
    rx, ry = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    extend = F.greatest(safe_div(F.lit(2 * lx), rx), safe_div(F.lit(2 * ly), ry))
    return box.withColumn("_extend", extend).select(
        *by,
        (F.col("_x0") - F.col("_extend") * rx).alias("gx0"),
        (F.col("_y0") - F.col("_extend") * ry).alias("gy0"),
        ((rx + 2.0 * F.col("_extend") * rx) / float(n)).alias("gdx"),
        ((ry + 2.0 * F.col("_extend") * ry) / float(n)).alias("gdy"),
    ).withColumn("cell_area", F.col("gdx") * F.col("gdy"))


def _node_x(ix: Column) -> Column:
    return F.col("gx0") + F.col("gdx") * ix


def _node_y(iy: Column) -> Column:
    return F.col("gy0") + F.col("gdy") * iy


def _all_nodes(geometry: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Every (ix, iy) of each group; the columns are spread before the rows unfold."""
    cells = F.sequence(F.lit(0), F.lit(n - 1))
    columns = spread(geometry.withColumn("ix", F.explode(cells)), *by, "ix")
    return columns.withColumn("iy", F.explode(cells))


def regular_grid(points: DataFrame, dlim, n: int, by: list[str], polygon=None,
                 x="x", y="y") -> DataFrame:
    """The n x n nodes (cell corners) of each group, inside the polygon if given."""
    nodes = (
        _all_nodes(grid_geometry(points, dlim, n, by, x, y), n, by)
        .select(*by, "ix", "iy", _node_x(F.col("ix")).alias("x"), _node_y(F.col("iy")).alias("y"),
                "cell_area")
    )
    return nodes if polygon is None else nodes.filter(inside_polygon("x", "y", polygon))


def nearest_point_grid(points: DataFrame, dlim, n: int, by: list[str], polygon=None,
                       max_dist="dlim", x="x", y="y") -> DataFrame:
    """The nearest position(s) of every grid node; equally near ones are all kept.

    ``max_dist='dlim'`` leaves nodes without a position inside the limit (a
    circle, or a rectangle for a pair) unassigned; ``None`` searches as far as
    needed. Output: group, ix, iy, x, y (the position), distance, cell_area.
    """
    # Read for the geometry and for both passes over the candidates.
    positions = cut_lineage(
        points.select(*by, F.col(x).alias("x"), F.col(y).alias("y")).filter(
            F.col("x").isNotNull() & F.col("y").isNotNull()
        ).distinct())
    geometry = grid_geometry(positions, dlim, n, by)
    if max_dist is None:
        candidates = _candidates_anywhere(positions, geometry, n, by, polygon)
    else:
        candidates = _candidates_within(positions, geometry, dlim, n, by, polygon)
    node = [*by, "ix", "iy"]
    # The minimum is combined map-side: one row for each node and task leaves.
    least = candidates.groupBy(*node).agg(F.min("distance").alias("_least"))
    return attach_groups(candidates, least, node).filter(
        F.col("distance") == F.col("_least")
    ).drop("_least")


def _candidates_within(positions, geometry, dlim, n, by, polygon) -> DataFrame:
    """(node, position) pairs inside the limit.

    The grid is regular, so the nodes near a position follow by arithmetic:
    no join, and a crowded cell costs only its own rows.
    """
    lx, ly, rectangle = _pair(dlim)
    here = attach_groups(positions, geometry, by)

    def span(value, origin, step, limit):
        low = F.floor((value - limit - origin) / step)
        high = F.ceil((value + limit - origin) / step)
        low = F.greatest(low, F.lit(0)).cast("int")
        high = F.least(high, F.lit(n - 1)).cast("int")
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    pairs = (
        here.filter((F.col("gdx") > 0) & (F.col("gdy") > 0))
        .withColumn("ix", span(F.col("x"), F.col("gx0"), F.col("gdx"), lx))
        .withColumn("iy", span(F.col("y"), F.col("gy0"), F.col("gdy"), ly))
    )
    dx, dy = F.col("x") - _node_x(F.col("ix")), F.col("y") - _node_y(F.col("iy"))
    pairs = pairs.withColumn("distance", F.sqrt(dx * dx + dy * dy))
    near = (F.abs(dx) <= lx) & (F.abs(dy) <= ly) if rectangle else F.col("distance") <= lx
    if polygon is not None:
        near = near & inside_polygon(_node_x(F.col("ix")), _node_y(F.col("iy")), polygon)
    return pairs.filter(near).select(*by, "ix", "iy", "x", "y", "distance", "cell_area")


def _candidates_anywhere(positions, geometry, n, by, polygon, side: int = 8) -> DataFrame:
    """(node, position) pairs among which the nearest of every node is found.

    Positions are put in side x side tiles, and those in side x side finer
    ones, each known by the box around its content. A tile can hold the
    nearest position only if its box begins no farther away than the closest
    box ends, so each node keeps a few tiles, then a few fine tiles, and meets
    only the positions in those. A group has at most side**2 tiles, and a tile
    side**2 fine ones, so the arrays are bounded whatever the data.
    """
    extent = positions.groupBy(*by).agg(
        F.min("x").alias("_x0"), F.min("y").alias("_y0"),
        (F.max("x") - F.min("x")).alias("_rx"), (F.max("y") - F.min("y")).alias("_ry"),
    )
    fine_n = side * side

    def index(value, origin, width):
        at = F.floor(F.coalesce(safe_div((value - origin) * fine_n, width), F.lit(0.0)))
        return F.least(at, F.lit(fine_n - 1)).cast("int")

    placed = attach_groups(positions, extent, by).select(
        *by, "x", "y",
        index(F.col("x"), F.col("_x0"), F.col("_rx")).alias("_fx"),
        index(F.col("y"), F.col("_y0"), F.col("_ry")).alias("_fy"),
    )
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"),
           F.min("y").alias("y0"), F.max("y").alias("y1")]
    again = [F.min("x0").alias("x0"), F.max("x1").alias("x1"),
             F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    coarse_of = [F.floor(F.col(f) / side).cast("int").alias(c) for f, c in (("_fx", "_cx"), ("_fy", "_cy"))]
    fine = placed.groupBy(*by, "_fx", "_fy").agg(*box).select("*", *coarse_of)
    coarse = fine.groupBy(*by, "_cx", "_cy").agg(*again)
    fine_lists = fine.groupBy(*by, "_cx", "_cy").agg(
        F.collect_list(F.struct("_fx", "_fy", "x0", "x1", "y0", "y1")).alias("_fine"))
    coarse_lists = coarse.groupBy(*by).agg(
        F.collect_list(F.struct("_cx", "_cy", "x0", "x1", "y0", "y1")).alias("_coarse"))

    nodes = _all_nodes(geometry, n, by).select(
        *by, "ix", "iy", _node_x(F.col("ix")).alias("nx"), _node_y(F.col("iy")).alias("ny"),
        "cell_area")
    if polygon is not None:
        nodes = nodes.filter(inside_polygon("nx", "ny", polygon))
    nx, ny = F.col("nx"), F.col("ny")

    def begins(b):
        dx = F.greatest(b["x0"] - nx, nx - b["x1"], F.lit(0.0))
        dy = F.greatest(b["y0"] - ny, ny - b["y1"], F.lit(0.0))
        return F.sqrt(dx * dx + dy * dy)

    def ends(b):
        dx = F.greatest(F.abs(nx - b["x0"]), F.abs(nx - b["x1"]))
        dy = F.greatest(F.abs(ny - b["y0"]), F.abs(ny - b["y1"]))
        return F.sqrt(dx * dx + dy * dy)

    slack = 1.0 + 1e-12
    list_bytes = side * side * 64
    near = attach_groups(nodes, coarse_lists, by, list_bytes).withColumn(
        "_bound", F.array_min(F.transform("_coarse", ends)) * slack
    ).withColumn("_tile", F.explode(F.filter("_coarse", lambda b: begins(b) <= F.col("_bound"))))
    near = near.select(*by, "ix", "iy", "nx", "ny", "cell_area", "_bound", "_tile._cx", "_tile._cy")
    near = attach_groups(near, fine_lists, [*by, "_cx", "_cy"], list_bytes).withColumn(
        "_bound", F.least(F.col("_bound"), F.array_min(F.transform("_fine", ends)) * slack)
    ).withColumn("_tile", F.explode(F.filter("_fine", lambda b: begins(b) <= F.col("_bound"))))
    near = near.select(*by, "ix", "iy", "nx", "ny", "cell_area", "_tile._fx", "_tile._fy")
    pairs = same_keys_join(placed, near, [*by, "_fx", "_fy"], "inner")
    dx, dy = F.col("x") - nx, F.col("y") - ny
    return pairs.select(*by, "ix", "iy", "x", "y", F.sqrt(dx * dx + dy * dy).alias("distance"),
                        "cell_area")


def influence_area(points: DataFrame, dlim, n: int, by: list[str], polygon=None,
                   x="x", y="y") -> DataFrame:
    """Every point with the area of the nodes it is nearest to (0 where none)."""
    points = cut_lineage(points)
    near = nearest_point_grid(points, dlim, n, by, polygon, "dlim", x, y)
    areas = near.groupBy(*by, "x", "y").agg(F.sum("cell_area").alias("influence_area"))
    areas = areas.withColumnsRenamed({"x": x, "y": y})
    return attach_groups(points, areas, [*by, x, y]).withColumn(
        "influence_area", F.coalesce("influence_area", F.lit(0.0)))


def migrate_to_grid(points: DataFrame, value: str, dlim, n: int, by: list[str], polygon=None,
                    max_dist="dlim", station="station", x="x", y="y", mode: str = "value") -> DataFrame:
    """The value, station or area of influence of the nearest point at each node.

    Of equally near points the one with the largest station id counts.
    ``mode`` is 'value', 'rank' (the station) or 'area'.
    """
    # The search reads the points several times; what made them runs once.
    points = cut_lineage(points.select(*by, station, x, y, value))
    near = nearest_point_grid(points, dlim, n, by, polygon, max_dist, x, y)
    if mode == "area":
        areas = near.groupBy(*by, "x", "y").agg(F.sum("cell_area").alias("_area"))
        near = same_keys_join(near, areas, [*by, "x", "y"])
    top = points.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.max(F.struct(F.col(station).alias("station"), F.col(value).alias("value"))).alias("_top"))
    best = same_keys_join(near, top, [*by, "x", "y"])
    extra = [F.col("_area").alias("area")] if mode == "area" else []
    chosen = best.groupBy(*by, "ix", "iy").agg(
        F.max(F.struct("_top.station", "_top.value", *extra)).alias("_best"),
        F.first("cell_area").alias("cell_area"),
    )
    field = {"value": "value", "rank": "station", "area": "area"}[mode]
    return chosen.select(*by, "ix", "iy", F.col(f"_best.{field}").alias("zg"), "cell_area")


def grid_covariogram(cells: DataFrame, max_lag: int, by: list[str]) -> DataFrame:
    """Sum of products of cells (kx, ky) apart, times the cell area.

    Each cell names its partner by index, so this is an equi-join; a lag
    without any pair has no row.
    """
    lags = F.sequence(F.lit(-max_lag), F.lit(max_lag))
    return _products(
        cells.withColumn("kx", F.explode(lags)).withColumn("ky", F.explode(lags)), cells, by
    )


def _products(shifted: DataFrame, cells: DataFrame, by) -> DataFrame:
    left = shifted.select(*by, "kx", "ky", "zg", "cell_area",
                          (F.col("ix") + F.col("kx")).alias("ix"),
                          (F.col("iy") + F.col("ky")).alias("iy"))
    right = cells.select(*by, "ix", "iy", F.col("zg").alias("_other"))
    pairs = same_keys_join(left, right, [*by, "ix", "iy"], "inner")
    return pairs.groupBy(*by, "kx", "ky").agg(
        (F.sum(F.col("zg") * F.col("_other")) * F.first("cell_area")).alias("g"))


def microstructure_index(points: DataFrame, z: str, h0: float, dlim, n: int, by: list[str],
                         polygon=None, max_dist=None, station="station", x="x", y="y") -> DataFrame:
    """(g(0) - mean of g at distances from h0/2 to 3 h0/2) / g(0).

    The nodes get the nearest point's value however far it is, unless
    ``max_dist='dlim'``.
    """
    whole = cut_lineage(
        points.filter((F.col(x) * F.col(y) * F.col(z)).isNotNull()).select(*by, station, x, y, z))
    geometry = grid_geometry(whole, dlim, n, by, x, y).drop("cell_area")
    cells = migrate_to_grid(whole, z, dlim, n, by, polygon, max_dist, station, x, y)
    reach = F.ceil(1.5 * h0 / F.least("gdx", "gdy")).cast("int")
    lags = F.sequence(-reach, reach)
    h = F.sqrt(F.pow(F.col("kx") * F.col("gdx"), 2) + F.pow(F.col("ky") * F.col("gdy"), 2))
    ring = (h >= h0 / 2) & (h <= 1.5 * h0)

    def with_lags(df):
        return df.withColumn("kx", F.explode(lags)).withColumn("ky", F.explode(lags))

    # Every lag of the ring counts in the mean, also one without any pair.
    ring_size = with_lags(geometry).filter(ring).groupBy(*by).agg(F.count(F.lit(1)).alias("_n_lags"))
    zero = (F.col("kx") == 0) & (F.col("ky") == 0)
    # Lags wider than the grid have no pair; they only count above.
    on_grid = (F.abs("kx") < n) & (F.abs("ky") < n)
    shifted = with_lags(attach_groups(cells, geometry, by)).filter((ring | zero) & on_grid)
    g = _products(shifted, cells, by)
    sums = g.groupBy(*by).agg(
        F.sum(F.when(zero, F.col("g"))).alias("_g0"),
        F.sum(F.when(~zero, F.col("g"))).alias("_ring"),
    )
    mean = safe_div(F.coalesce("_ring", F.lit(0.0)), F.col("_n_lags"))
    return same_keys_join(sums, ring_size, by).select(
        *by, safe_div(F.col("_g0") - mean, F.col("_g0")).alias("microstructure"))
