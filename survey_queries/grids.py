"""Grids, areas of influence, microstructure and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from survey_queries import views
from survey_queries.estimates import CPUE_CTE, cpue_frame, rounded
from survey_queries.registry import query
from survey_queries.space import TOTAL_CTE, station_total
from trawlframe.operators import grid, patches

N = 40
DLIM = 0.15
H0 = 0.6
POLYGON = [(-178.5, 53.5), (-157.0, 53.5), (-157.0, 60.0), (-170.0, 62.5), (-178.5, 60.0)]

GRID_CTE = TOTAL_CTE + f""",
box AS (SELECT year, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM total GROUP BY 1),
geo0 AS (SELECT *, greatest(2 * {DLIM} / (x1 - x0), 2 * {DLIM} / (y1 - y0))::DOUBLE AS e FROM box),
geo AS (SELECT year, x0 - e * (x1 - x0) AS gx0, y0 - e * (y1 - y0) AS gy0,
               ((x1 - x0) + 2 * e * (x1 - x0)) / {N}.0::DOUBLE AS gdx, ((y1 - y0) + 2 * e * (y1 - y0)) / {N}.0::DOUBLE AS gdy FROM geo0),
nodes AS (SELECT year, ix, iy, gx0 + gdx * ix AS gx, gy0 + gdy * iy AS gy, gdx, gdy, gdx * gdy AS cell_area
          FROM geo CROSS JOIN range(0, {N}) a(ix) CROSS JOIN range(0, {N}) b(iy)),
pos AS (SELECT DISTINCT year, lon, lat FROM total)
"""
NEAR_CTE = GRID_CTE + """,
pairs AS (SELECT n.*, p.lon, p.lat, sqrt((p.lon - gx) * (p.lon - gx) + (p.lat - gy) * (p.lat - gy)) AS d
          FROM nodes n JOIN pos p ON p.year = n.year),
near AS (SELECT * FROM pairs WHERE {limit} QUALIFY d = min(d) OVER (PARTITION BY year, ix, iy))
"""
CIRCLE = NEAR_CTE.format(limit=f"d <= {DLIM}")
RECTANGLE = NEAR_CTE.format(limit=f"abs(lon - gx) <= {DLIM} AND abs(lat - gy) <= 0.1")
ANYWHERE = NEAR_CTE.format(limit="TRUE")


def _points(spark, sf_dir):
    return station_total(spark, sf_dir).withColumnsRenamed({"lon": "x", "lat": "y"})


@query("regular_grid", """
SELECT year, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round(gx, 6) AS x, round(gy, 6) AS y, round(cell_area, 9) AS cell_area FROM nodes""", GRID_CTE)
def regular_grid(spark, sf_dir):
    return rounded(grid.regular_grid(_points(spark, sf_dir), DLIM, N, ["year"]), 6, cell_area=9)


def _edges_sql():
    ends = POLYGON[1:] + POLYGON[:1]
    return " + ".join(
        f"(CASE WHEN ({y1} > gy) <> ({y2} > gy) AND gx < {x1} + (gy - {y1}) / ({y2} - ({y1}))::DOUBLE * ({x2} - ({x1})) THEN 1 ELSE 0 END)"
        for (x1, y1), (x2, y2) in zip(POLYGON, ends) if y1 != y2)


@query("regular_grid_polygon", f"""
SELECT year, count(*) AS nodes, CAST(sum(ix) AS BIGINT) AS ix_sum, CAST(sum(iy) AS BIGINT) AS iy_sum
FROM nodes WHERE ({_edges_sql()}) % 2 = 1 GROUP BY 1""", GRID_CTE)
def regular_grid_polygon(spark, sf_dir):
    nodes = grid.regular_grid(_points(spark, sf_dir), DLIM, N, ["year"], POLYGON)
    return nodes.groupBy("year").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("ix").alias("ix_sum"), F.sum("iy").alias("iy_sum"))


NEAR_SQL = """
SELECT year, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round(lon, 6) AS x, round(lat, 6) AS y, round(d, 6) AS distance FROM near"""


@query("nearest_point_grid", NEAR_SQL, CIRCLE)
def nearest_point_grid(spark, sf_dir):
    near = grid.nearest_point_grid(_points(spark, sf_dir), DLIM, N, ["year"])
    return rounded(near.drop("cell_area"))


@query("nearest_point_grid_unlimited", NEAR_SQL, ANYWHERE)
def nearest_point_grid_unlimited(spark, sf_dir):
    near = grid.nearest_point_grid(_points(spark, sf_dir), DLIM, N, ["year"], max_dist=None)
    return rounded(near.drop("cell_area"))


INFLUENCE_SQL = """
SELECT t.year, t.station, round(coalesce(a.area, 0), 6) AS influence_area FROM total t
LEFT JOIN (SELECT year, lon, lat, sum(cell_area) AS area FROM near GROUP BY 1, 2, 3) a
  ON a.year = t.year AND a.lon = t.lon AND a.lat = t.lat"""


@query("influence_area", INFLUENCE_SQL, CIRCLE)
def influence_area(spark, sf_dir):
    return rounded(grid.influence_area(_points(spark, sf_dir), DLIM, N, ["year"]).select(
        "year", "station", "influence_area"))


@query("influence_area_rectangle", INFLUENCE_SQL, RECTANGLE)
def influence_area_rectangle(spark, sf_dir):
    return rounded(grid.influence_area(_points(spark, sf_dir), (DLIM, 0.1), N, ["year"]).select(
        "year", "station", "influence_area"))


MIGRATED_CTE = """,
placed AS (
  SELECT year, ix, iy, gdx, gdy, cell_area, arg_max(total_cpue, station) AS zg, max(station) AS station
  FROM (SELECT n.year, n.ix, n.iy, n.gdx, n.gdy, n.cell_area, t.station, t.total_cpue FROM near n
        JOIN total t ON t.year = n.year AND t.lon = n.lon AND t.lat = n.lat) GROUP BY ALL)
"""


@query("influence_grid", """
SELECT year, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round(zg, 3) AS zg, station FROM placed""", CIRCLE + MIGRATED_CTE)
def influence_grid(spark, sf_dir):
    points = _points(spark, sf_dir)
    value = grid.migrate_to_grid(points, "total_cpue", DLIM, N, ["year"])
    rank = grid.migrate_to_grid(points, "total_cpue", DLIM, N, ["year"], mode="rank")
    return rounded(value.drop("cell_area"), 3).join(
        rank.select("year", "ix", "iy", F.col("zg").alias("station")), ["year", "ix", "iy"])


@query("influence_grid_area", """
SELECT p.year, CAST(p.ix AS INT) AS ix, CAST(p.iy AS INT) AS iy, round(a.area, 6) AS zg FROM placed p
JOIN total t ON t.year = p.year AND t.station = p.station
JOIN (SELECT year, lon, lat, sum(cell_area) AS area FROM near GROUP BY 1, 2, 3) a
  ON a.year = t.year AND a.lon = t.lon AND a.lat = t.lat""", CIRCLE + MIGRATED_CTE)
def influence_grid_area(spark, sf_dir):
    return rounded(grid.migrate_to_grid(_points(spark, sf_dir), "total_cpue", DLIM, N, ["year"],
                                        mode="area").drop("cell_area"))


@query("grid_covariogram", """
SELECT a.year, CAST(kx AS INT) AS kx, CAST(ky AS INT) AS ky, round(sum(a.zg * b.zg * a.cell_area) / 1e6, 4) AS g
FROM placed a CROSS JOIN range(-3, 4) x(kx) CROSS JOIN range(-3, 4) y(ky)
JOIN placed b ON b.year = a.year AND b.ix = a.ix + kx AND b.iy = a.iy + ky GROUP BY 1, 2, 3""", CIRCLE + MIGRATED_CTE)
def grid_covariogram(spark, sf_dir):
    cells = grid.migrate_to_grid(_points(spark, sf_dir), "total_cpue", DLIM, N, ["year"])
    return rounded(grid.grid_covariogram(cells, 3, ["year"]).withColumn("g", F.col("g") / 1e6), 4)


@query("microstructure_index", f"""
SELECT p.year, round((g0 - ring / n_lags) / g0, 6) AS microstructure FROM (
  SELECT year, sum(CASE WHEN kx = 0 AND ky = 0 THEN g END) AS g0,
         sum(CASE WHEN kx <> 0 OR ky <> 0 THEN g END) AS ring FROM (
    SELECT a.year, l.kx, l.ky, sum(a.zg * b.zg * a.cell_area) AS g
    FROM placed a JOIN lags l ON l.year = a.year
    JOIN placed b ON b.year = a.year AND b.ix = a.ix + kx AND b.iy = a.iy + ky GROUP BY 1, 2, 3) GROUP BY 1) p
JOIN (SELECT year, count(*) AS n_lags FROM lags WHERE kx <> 0 OR ky <> 0 GROUP BY 1) c ON c.year = p.year""",
    ANYWHERE + MIGRATED_CTE + f""",
lags AS (SELECT year, kx, ky FROM geo CROSS JOIN range(-{2 * N}, {2 * N} + 1) x(kx) CROSS JOIN range(-{2 * N}, {2 * N} + 1) y(ky)
  WHERE (kx = 0 AND ky = 0) OR (sqrt(kx * gdx * kx * gdx + ky * gdy * ky * gdy) >= {H0} / 2
         AND sqrt(kx * gdx * kx * gdx + ky * gdy * ky * gdy) <= 1.5 * {H0}))
""")
def microstructure_index(spark, sf_dir):
    return rounded(grid.microstructure_index(
        _points(spark, sf_dir), "total_cpue", H0, DLIM, N, ["year"]))


LIMIT = 1.47

# The rule is sequential, so the SQL is a recursion over the rank within each
# group, with the patches' sums as a list.
PATCH_CTE = CPUE_CTE + f""",
pts AS (SELECT year, size_sex, station, lon AS x, lat AS y, cpue AS z, area_swept AS w, cpue * area_swept AS q,
    CASE WHEN cpue * area_swept > 0 THEN row_number() OVER (PARTITION BY year, size_sex ORDER BY cpue DESC, station) END AS rn
  FROM cpue_long),
grow AS (
  SELECT year, size_sex, rn, station, 1 AS patch, [{{'q': q, 'qx': q * x, 'qy': q * y}}] AS st FROM pts WHERE rn = 1
  UNION ALL
  SELECT year, size_sex, rn, station, CASE WHEN near < {LIMIT} THEN k ELSE len(st) + 1 END AS patch,
         CASE WHEN near < {LIMIT}
              THEN list_transform(st, lambda s, i: CASE WHEN i = k THEN {{'q': s.q + q, 'qx': s.qx + q * x, 'qy': s.qy + q * y}} ELSE s END)
              ELSE list_append(st, {{'q': q, 'qx': q * x, 'qy': q * y}}) END AS st
  FROM (SELECT *, list_min(ds) AS near, list_position(ds, list_min(ds)) AS k FROM (
    SELECT p.*, g.st, list_transform(g.st, lambda s: sqrt((s.qx / s.q - p.x) * (s.qx / s.q - p.x) + (s.qy / s.q - p.y) * (s.qy / s.q - p.y))) AS ds
    FROM grow g JOIN pts p ON p.year = g.year AND p.size_sex = g.size_sex AND p.rn = g.rn + 1))),
centres AS (SELECT p.year, p.size_sex, patch, sum(q * x) / sum(q) AS cx, sum(q * y) / sum(q) AS cy
  FROM grow g JOIN pts p ON p.year = g.year AND p.size_sex = g.size_sex AND p.station = g.station GROUP BY 1, 2, 3),
empty AS (SELECT p.year, p.size_sex, p.station, min(CASE WHEN d < {LIMIT} THEN {{'d': d, 'patch': patch}} END) AS best
  FROM (SELECT p.*, c.patch, sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy)) AS d
        FROM pts p LEFT JOIN centres c ON c.year = p.year AND c.size_sex = p.size_sex WHERE p.rn IS NULL) p GROUP BY 1, 2, 3),
assigned AS (
  SELECT p.year, p.size_sex, p.station, p.x, p.y, p.z, p.w, p.q, coalesce(g.patch, e.best.patch, 0) AS patch FROM pts p
  LEFT JOIN grow g ON g.year = p.year AND g.size_sex = p.size_sex AND g.station = p.station
  LEFT JOIN empty e ON e.year = p.year AND e.size_sex = p.size_sex AND e.station = p.station)
"""


def _patches(spark, sf_dir):
    return patches.spatial_patches(cpue_frame(spark, sf_dir), "lon", "lat", "cpue", "area_swept",
                                   ["year", "size_sex"], limit=LIMIT)


@query("spatial_patches", """
SELECT year, size_sex, station, CAST(patch AS INT) AS patch FROM assigned""",
       PATCH_CTE)
def spatial_patches(spark, sf_dir):
    return _patches(spark, sf_dir).select("year", "size_sex", "station", "patch")


@query("patch_summary", """
SELECT year, size_sex, CAST(patch AS INT) AS patch, round(xg, 6) AS xg, round(yg, 6) AS yg, round(share, 4) AS pabun, round(parea, 6) AS parea,
       count_if(share >= 10 AND patch > 0) OVER (PARTITION BY year, size_sex) AS n_patches_over,
       CAST(max(CASE WHEN share >= 10 AND patch > 0 THEN patch END) OVER (PARTITION BY year, size_sex) AS INT) AS max_patch_over
FROM (SELECT year, size_sex, patch, sum(q * x) / nullif(sum(q), 0) AS xg, sum(q * y) / nullif(sum(q), 0) AS yg,
             100 * sum(q) / sum(sum(q)) OVER (PARTITION BY year, size_sex) AS share,
             sum(w) / sum(sum(w)) OVER (PARTITION BY year, size_sex) AS parea
      FROM assigned GROUP BY 1, 2, 3)""", PATCH_CTE)
def patch_summary(spark, sf_dir):
    out = patches.patch_summary(_patches(spark, sf_dir), ["year", "size_sex"], digits=4)
    return rounded(out, 6, pabun=4)
