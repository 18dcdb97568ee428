"""Panels, spatial indicators and temperature indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from survey_queries import views
from survey_queries.estimates import CPUE_CTE, cpue_frame, rounded
from survey_queries.records import EXCLUDED, WIDE_CTE, excluded_stations, station_wide
from survey_queries.registry import query
from trawlframe.operators import panel as pn
from trawlframe.operators import prep, spatial

BY = ["year", "size_sex"]
XYZW = ("lon", "lat", "cpue", "area_swept", BY)

TOTAL_CTE = CPUE_CTE + """,
total AS (
  SELECT c.year, c.station, any_value(c.lat) AS lat, any_value(c.lon) AS lon,
         any_value(c.area_swept) AS area_swept, any_value(h.gear_temp) AS nbt, sum(cpue) AS total_cpue
  FROM cpue_long c JOIN sv_haul h ON h.year = c.year AND h.station = c.station GROUP BY 1, 2)
"""


def station_total(spark, sf_dir):
    """Total CPUE and temperature of each station and year."""
    totals = cpue_frame(spark, sf_dir).groupBy("year", "station", "lat", "lon", "area_swept").agg(
        F.sum("cpue").alias("total_cpue"))
    temps = views.haul(spark, sf_dir).select("year", "station", F.col("gear_temp").alias("nbt"))
    return totals.join(temps, ["year", "station"])


# -- panels ------------------------------------------------------------------------

@query("balanced_panel", """
SELECT year, station, nbt FROM station_wide WHERE station IN (
  SELECT station FROM station_wide GROUP BY 1
  HAVING count(nbt) = (SELECT count(DISTINCT year) FROM station_wide))""", WIDE_CTE)
def balanced_panel(spark, sf_dir):
    return pn.balanced_panel(station_wide(spark, sf_dir).select("year", "station", "nbt"),
                             "station", "year", "nbt")


@query("balanced_panel_every_period", """
SELECT year, station, nbt FROM station_wide WHERE station IN (
  SELECT station FROM station_wide GROUP BY 1
  HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM station_wide))""", WIDE_CTE)
def balanced_every_period(spark, sf_dir):
    return pn.balanced_panel(station_wide(spark, sf_dir).select("year", "station", "nbt"),
                             "station", "year", "nbt", "every_period")


@query("min_observations", """
SELECT year, station, nbt FROM station_wide WHERE station IN (
  SELECT station FROM station_wide GROUP BY 1 HAVING count(nbt) >= 6)""", WIDE_CTE)
def min_observations(spark, sf_dir):
    return pn.min_observations(station_wide(spark, sf_dir).select("year", "station", "nbt"),
                               "station", "nbt", 6)


@query("count_beside_rows", """
SELECT year, station, count(nbt) OVER (PARTITION BY station) AS n_values FROM station_wide""", WIDE_CTE)
def count_beside(spark, sf_dir):
    return pn.count_beside(station_wide(spark, sf_dir).select("year", "station", "nbt"),
                           "station", "nbt").drop("nbt")


@query("drop_empty_series", """
SELECT year, station, male_total FROM station_wide WHERE station IN (
  SELECT station FROM station_wide WHERE male_total IS NOT NULL)""", WIDE_CTE)
def drop_empty_series(spark, sf_dir):
    return pn.drop_empty_series(station_wide(spark, sf_dir).select("year", "station", "male_total"),
                                "station", "male_total")


@query("drop_zero_series", """
SELECT year, station, size_sex, round(cpue, 4) AS cpue FROM cpue_long c WHERE EXISTS (
  SELECT 1 FROM (SELECT size_sex, station FROM cpue_long GROUP BY 1, 2 HAVING sum(cpue) > 0) k
  WHERE k.size_sex = c.size_sex AND k.station = c.station)""", CPUE_CTE)
def drop_zero_series(spark, sf_dir):
    cells = cpue_frame(spark, sf_dir).select("year", "station", "size_sex", "cpue")
    return rounded(pn.drop_zero_series(cells, "station", "cpue", ["size_sex"]), 4)


@query("station_position", """
SELECT station, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM (
  SELECT station, year, avg(lon) AS lon, avg(lat) AS lat FROM sv_haul GROUP BY 1, 2) GROUP BY 1""")
def station_position(spark, sf_dir):
    return rounded(pn.station_position(views.haul(spark, sf_dir)))


@query("position_deviation", """
SELECT station, round(max(lon - m_lon), 6) AS lon_max, round(max(abs(lon - m_lon)), 6) AS lon_abs,
       round(max(lat - m_lat), 6) AS lat_max, round(max(abs(lat - m_lat)), 6) AS lat_abs
FROM (SELECT *, avg(lon) OVER (PARTITION BY station) AS m_lon, avg(lat) OVER (PARTITION BY station) AS m_lat
      FROM sv_haul) GROUP BY 1""")
def position_deviation(spark, sf_dir):
    return rounded(pn.position_deviation(views.haul(spark, sf_dir)))


@query("panel_gaps", """
SELECT y.year, s.station FROM (SELECT DISTINCT year FROM sv_haul) y CROSS JOIN (SELECT DISTINCT station FROM sv_haul) s
WHERE NOT EXISTS (SELECT 1 FROM sv_haul h WHERE h.year = y.year AND h.station = s.station AND gear_temp IS NOT NULL)""")
def panel_gaps(spark, sf_dir):
    return pn.gaps(views.haul(spark, sf_dir), "station", "year", "gear_temp")


@query("assert_no_gaps", """
SELECT year, station, lat FROM station_wide WHERE station IN (
  SELECT station FROM station_wide GROUP BY 1
  HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM station_wide))""", WIDE_CTE)
def assert_no_gaps(spark, sf_dir):
    full = pn.balanced_panel(station_wide(spark, sf_dir).select("year", "station", "lat"),
                             "station", "year", "lat", "every_period")
    return pn.assert_no_gaps(full, "station", "year", "lat")


@query("find_duplicates", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (
  SELECT (l_partkey, l_suppkey) FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)""", views=False)
def find_duplicates(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return pn.find_duplicates(lines, ["l_partkey", "l_suppkey"])


@query("crowded_series", """
SELECT station, count(*) AS n_rows FROM sv_catch GROUP BY 1
HAVING count(*) > (SELECT count(DISTINCT year) FROM sv_catch)""")
def crowded_series(spark, sf_dir):
    return pn.crowded_series(views.catch(spark, sf_dir), "station", "year")


@query("anomaly", """
SELECT year, station, round(nbt - avg(nbt) OVER (PARTITION BY year), 9) AS anomaly FROM station_wide""", WIDE_CTE)
def anomaly(spark, sf_dir):
    return rounded(pn.anomaly(station_wide(spark, sf_dir), "year", "nbt", skip_missing=True).select(
        "year", "station", "anomaly"), 9)


@query("z_score", """
SELECT year, station, round((nbt - avg(nbt) OVER (PARTITION BY station))
       / nullif(stddev_samp(nbt) OVER (PARTITION BY station), 0), 6) AS z FROM station_wide""", WIDE_CTE)
def z_score(spark, sf_dir):
    return rounded(pn.z_score(station_wide(spark, sf_dir), ["station"], "nbt").select("year", "station", "z"))


@query("share_of_total", """
SELECT year, size_sex, station, round(cpue / sum(cpue) OVER (PARTITION BY year, size_sex), 9) AS share
FROM cpue_long""", CPUE_CTE)
def share_of_total(spark, sf_dir):
    return rounded(pn.share_of_total(cpue_frame(spark, sf_dir), BY, "cpue").select(
        *BY, "station", "share"), 9)


@query("minimum_difference", """
SELECT year, station, round(nbt - min(nbt) OVER (PARTITION BY year), 6) AS above_min FROM station_wide""", WIDE_CTE)
def minimum_difference(spark, sf_dir):
    return rounded(pn.minimum_difference(station_wide(spark, sf_dir), "nbt", ["year"], "above_min").select(
        "year", "station", "above_min"))


# -- indicators ----------------------------------------------------------------------

D95_CTE = TOTAL_CTE + """,
ranked AS (
  SELECT year, station, total_cpue, total_cpue / sum(total_cpue) OVER (PARTITION BY year) AS share,
         sum(total_cpue) OVER (PARTITION BY year ORDER BY total_cpue DESC, station ROWS UNBOUNDED PRECEDING)
           / sum(total_cpue) OVER (PARTITION BY year) AS cumulative_share FROM total)
"""


@query("d95_members", """
SELECT year, station, round(share, 9) AS share, round(cumulative_share, 6) AS cumulative_share,
       CAST(cumulative_share <= 0.95 AS INT) AS d95 FROM ranked""", D95_CTE)
def d95_members(spark, sf_dir):
    members = spatial.d95_members(station_total(spark, sf_dir), "total_cpue", ["year"])
    return rounded(members.select("year", "station", "share", "cumulative_share",
                                  F.col("d95").cast("int").alias("d95")), 6, share=9)


@query("d95_area", """
SELECT year, CAST(count_if(cumulative_share <= 0.95) * 401 AS BIGINT) AS d95_area FROM ranked GROUP BY 1""", D95_CTE)
def d95_area(spark, sf_dir):
    return spatial.d95_area(
        spatial.d95_members(station_total(spark, sf_dir), "total_cpue", ["year"]), ["year"])


@query("spatial_abundance", """
SELECT year, size_sex, round(sum(cpue * area_swept), 4) AS abundance FROM cpue_long GROUP BY 1, 2""", CPUE_CTE)
def spatial_abundance(spark, sf_dir):
    return rounded(spatial.spatial_abundance(cpue_frame(spark, sf_dir), "cpue", "area_swept", BY), 4)


CENTRE_CTE = CPUE_CTE + """,
centre AS (
  SELECT year, size_sex, sum(lon * cpue * area_swept) / sum(cpue * area_swept) AS xcg,
         sum(lat * cpue * area_swept) / sum(cpue * area_swept) AS ycg FROM cpue_long GROUP BY 1, 2),
moments AS (
  SELECT c.year, c.size_sex, any_value(xcg) AS xcg, any_value(ycg) AS ycg,
         sum((lon - xcg) * (lon - xcg) * cpue * area_swept) / sum(cpue * area_swept) AS a,
         sum((lat - ycg) * (lat - ycg) * cpue * area_swept) / sum(cpue * area_swept) AS c,
         sum((lon - xcg) * (lat - ycg) * cpue * area_swept) / sum(cpue * area_swept) AS b
  FROM cpue_long c JOIN centre g ON c.year = g.year AND c.size_sex = g.size_sex GROUP BY 1, 2),
principal AS (
  SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS imax,
         (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS imin FROM moments)
"""


@query("center_of_gravity", """
SELECT year, size_sex, round(xcg, 6) AS xcg, round(ycg, 6) AS ycg FROM centre""", CENTRE_CTE)
def center_of_gravity(spark, sf_dir):
    return rounded(spatial.center_of_gravity(cpue_frame(spark, sf_dir), *XYZW))


@query("inertia", """
SELECT year, size_sex, round(xcg, 6) AS xcg, round(ycg, 6) AS ycg, round(a + c, 6) AS inertia FROM moments""", CENTRE_CTE)
def inertia(spark, sf_dir):
    return rounded(spatial.inertia(cpue_frame(spark, sf_dir), *XYZW))


@query("anisotropy", """
SELECT year, size_sex, round(xcg, 6) AS xcg, round(ycg, 6) AS ycg, round(a + c, 6) AS inertia,
       round(imax, 6) AS imax, round(imin, 6) AS imin, round(sqrt(imin / imax), 6) AS iso FROM principal""", CENTRE_CTE)
def anisotropy(spark, sf_dir):
    return rounded(spatial.anisotropy(cpue_frame(spark, sf_dir), *XYZW))


@query("inertia_axes", """
SELECT year, size_sex, round(xcg - abs(ux) * sqrt(imax), 5) AS x1a, round(xcg + abs(ux) * sqrt(imax), 5) AS x1b,
       round(ycg - sign(ux) * uy * sqrt(imax), 5) AS y1a, round(ycg + sign(ux) * uy * sqrt(imax), 5) AS y1b,
       round(xcg - abs(uy) * sqrt(imin), 5) AS x2a, round(xcg + abs(uy) * sqrt(imin), 5) AS x2b,
       round(ycg + sign(uy) * ux * sqrt(imin), 5) AS y2a, round(ycg - sign(uy) * ux * sqrt(imin), 5) AS y2b
FROM (SELECT *, b / sqrt(b * b + (imax - a) * (imax - a)) AS ux,
             (imax - a) / sqrt(b * b + (imax - a) * (imax - a)) AS uy FROM principal)""", CENTRE_CTE)
def inertia_axes(spark, sf_dir):
    axes = spatial.inertia_axes(cpue_frame(spark, sf_dir), *XYZW)
    return axes.select(*BY, *[
        F.round(F.col(f"{c}axe{i}")[end], 5).alias(f"{c}{i}{'ab'[end]}")
        for i in (1, 2) for c in "xy" for end in (0, 1)])


@query("collocation_index", """
SELECT p.year, p.size_sex, round(1 - d / (d + p.i + q.i), 6) AS gic
FROM (SELECT m.year, m.size_sex, m.a + m.c AS i, o.a + o.c AS oi,
             (m.xcg - o.xcg) * (m.xcg - o.xcg) + (m.ycg - o.ycg) * (m.ycg - o.ycg) AS d
      FROM moments m JOIN moments o ON o.year = m.year AND o.size_sex = 'mature_female') p
JOIN (SELECT year, a + c AS i FROM moments WHERE size_sex = 'mature_female') q ON q.year = p.year""", CENTRE_CTE)
def collocation_index(spark, sf_dir):
    spread = spatial.inertia(cpue_frame(spark, sf_dir), *XYZW)
    mature = spread.filter(F.col("size_sex") == "mature_female").drop("size_sex")
    against = spread.select("year", "size_sex").join(mature, "year")
    return rounded(spatial.collocation_index(spread, against, BY))


@query("positive_area", """
SELECT year, size_sex, round(coalesce(sum(CASE WHEN cpue > 0 THEN area_swept END), 0), 6) AS positive_area FROM cpue_long GROUP BY 1, 2""", CPUE_CTE)
def positive_area(spark, sf_dir):
    return rounded(spatial.positive_area(cpue_frame(spark, sf_dir), "cpue", "area_swept", BY))


@query("equivalent_area", """
SELECT year, size_sex, round(sum(cpue * area_swept) * sum(cpue * area_swept) / sum(cpue * cpue * area_swept), 6) AS equivalent_area
FROM cpue_long GROUP BY 1, 2""", CPUE_CTE)
def equivalent_area(spark, sf_dir):
    return rounded(spatial.equivalent_area(cpue_frame(spark, sf_dir), "cpue", "area_swept", BY))


SPREAD_CTE = CPUE_CTE + """,
dense AS (SELECT year, size_sex, cpue, sum(area_swept) AS w, sum(cpue * area_swept) AS q FROM cpue_long GROUP BY 1, 2, 3),
run AS (
  SELECT *, sum(q) OVER (PARTITION BY year, size_sex ORDER BY cpue) AS qt,
         sum(q) OVER (PARTITION BY year, size_sex) AS total,
         sum(w) OVER (PARTITION BY year, size_sex ORDER BY cpue DESC) AS area,
         sum(q) OVER (PARTITION BY year, size_sex ORDER BY cpue DESC) AS taken FROM dense)
"""


@query("spreading_area", """
SELECT year, size_sex, round(sum((qt + qt - q) * w) / max(total), 6) AS spreading_area FROM run GROUP BY 1, 2""", SPREAD_CTE)
def spreading_area(spark, sf_dir):
    return rounded(spatial.spreading_area(cpue_frame(spark, sf_dir), "cpue", "area_swept", BY))


@query("spreading_curve", """
SELECT year, size_sex, round(area, 5) AS area, CAST(round((total - taken) / total, 5) + 0.0 AS DOUBLE) AS "left", round(cpue, 3) AS density FROM run
UNION ALL SELECT DISTINCT year, size_sex, 0.0, 1.0, NULL FROM run""", SPREAD_CTE)
def spreading_curve(spark, sf_dir):
    return rounded(spatial.spreading_curve(cpue_frame(spark, sf_dir), "cpue", "area_swept", BY), 5, density=3)


@query("shannon_diversity", """
SELECT year, size_sex, round(coalesce(sum(-p * log2(p)), 0), 6) AS diversity
FROM (SELECT year, size_sex, cpue / sum(cpue) OVER (PARTITION BY year, size_sex) AS p FROM cpue_long WHERE cpue > 0)
GROUP BY 1, 2""", CPUE_CTE)
def shannon_diversity(spark, sf_dir):
    return rounded(spatial.shannon_diversity(cpue_frame(spark, sf_dir), "cpue", BY))


@query("temperature_of_occupancy", """
SELECT year, round(avg(nbt), 9) AS raw_temp,
       round(sum(nbt * w) / sum(CASE WHEN nbt IS NOT NULL THEN w END), 6) AS occupied_temp,
       round(sum(nbt * ln(w)) / sum(CASE WHEN nbt IS NOT NULL THEN ln(w) END), 6) AS log_occupied_temp
FROM (SELECT year, nbt, nullif(total_cpue, 0) AS w FROM total) GROUP BY 1""", TOTAL_CTE)
def temperature_of_occupancy(spark, sf_dir):
    return rounded(spatial.temperature_of_occupancy(
        station_total(spark, sf_dir), "nbt", "total_cpue", ["year"]), 6, raw_temp=9)


@query("temperature_in_range", """
SELECT c.size_sex, c.year, round(avg(h.gear_temp), 9) AS mean_temp
FROM cpue_long c JOIN sv_haul h ON h.year = c.year AND h.station = c.station
JOIN (SELECT size_sex, station FROM cpue_long GROUP BY 1, 2 HAVING sum(cpue) > 0) k
  ON k.size_sex = c.size_sex AND k.station = c.station GROUP BY 1, 2""", CPUE_CTE)
def temperature_in_range(spark, sf_dir):
    temps = views.haul(spark, sf_dir).select("year", "station", "gear_temp")
    cells = cpue_frame(spark, sf_dir).select("year", "station", "size_sex", "cpue")
    return rounded(spatial.temperature_in_range(
        cells.join(temps, ["year", "station"]), "gear_temp", "size_sex", "cpue"), 9)


def _temps(spark, sf_dir):
    good = prep.qc_hauls(views.haul(spark, sf_dir))
    return good.filter(F.col("gear_temp").isNotNull()).select("year", "station", "gear_temp")


TEMPS_CTE = """
temps AS (SELECT year, station, gear_temp FROM sv_haul WHERE haul_type = 3 AND performance >= 0 AND gear_temp IS NOT NULL)
"""


@query("mean_bottom_temperature", "SELECT year, round(avg(gear_temp), 9) AS mean_bt FROM temps GROUP BY 1", TEMPS_CTE)
def mean_bottom_temperature(spark, sf_dir):
    return rounded(spatial.mean_bottom_temperature(_temps(spark, sf_dir), "gear_temp"), 9)


@query("cold_pool_area", f"""
SELECT year, count(*) * 401 AS cpa FROM temps WHERE gear_temp < 2 AND station NOT IN ({EXCLUDED}) GROUP BY 1""", TEMPS_CTE)
def cold_pool_area(spark, sf_dir):
    return spatial.cold_pool_area(_temps(spark, sf_dir), "gear_temp", excluded_stations(spark, sf_dir))


@query("cold_pool_center", """
SELECT t.year, round(avg(h.lat), 9) AS cp_cod FROM temps t LEFT JOIN (SELECT year, station, lat FROM sv_haul
  WHERE haul_type = 3 AND performance >= 0) h ON h.year = t.year AND h.station = t.station
WHERE t.gear_temp < 2 GROUP BY 1""", TEMPS_CTE)
def cold_pool_center(spark, sf_dir):
    return rounded(spatial.cold_pool_center(
        _temps(spark, sf_dir), prep.qc_hauls(views.haul(spark, sf_dir)), "gear_temp"), 9)


@query("latitude_center", """
SELECT year, round(sum(lat * total_cpue) / sum(total_cpue), 6) AS mean_lat, round(avg(CASE WHEN total_cpue > 0 THEN 1.0 ELSE 0.0 END), 9) AS mean_presence
FROM total GROUP BY 1""", TOTAL_CTE)
def latitude_center(spark, sf_dir):
    rows = station_total(spark, sf_dir).withColumn(
        "present", F.when(F.col("total_cpue") > 0, 1.0).otherwise(0.0))
    return rounded(spatial.latitude_center(rows, "lat", "total_cpue", "present", ["year"]), 6, mean_presence=9)


@query("imputed_position_join", """
SELECT t.year, t.station, t.gear_temp, h.lat FROM sv_haul h RIGHT JOIN temps t ON h.year = t.year AND h.station = t.station""", TEMPS_CTE)
def imputed_position_join(spark, sf_dir):
    return views.haul(spark, sf_dir).select("year", "station", "lat").join(
        _temps(spark, sf_dir), ["year", "station"], "right")
