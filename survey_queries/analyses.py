"""Whole analyses and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from survey_queries import views
from survey_queries.estimates import CPUE_CTE, CRAB_CTE, FISH_CTE, Z, cpue_frame, rounded
from survey_queries.records import EXCLUDED, excluded_stations
from survey_queries.registry import query
from survey_queries.relations import FACTOR_CTE
from survey_queries.space import TOTAL_CTE, station_total
from trawlframe.functions import station_key
from trawlframe.operators import estimate
from trawlframe.plans import abundance, structure, temperature
from trawlframe.session import scratch_folder
from trawlframe.sources import read_imputations, read_table, write_imputations, write_table


@query("abundance_comparison", f"""
SELECT method, year, region, size_sex, round(e, 6) AS estimate, round(e - {Z} * s, 6) AS lwr_95, round(e + {Z} * s, 6) AS upp_95
FROM (SELECT 'abundance_naive' AS method, year, region, size_sex, sum(abundance_mil) AS e, sum(stderr_mil) AS s FROM stats GROUP BY ALL
UNION ALL SELECT 'abundance_weighted_crab', year, region, size_sex, sum(total_area * abundance_mil) / sum(total_area),
       sum(total_area * total_area * stderr_mil) / (sum(total_area) * sum(total_area)) FROM stats GROUP BY ALL
UNION ALL SELECT 'cpue_naive', year, region, size_sex, sum(num_crab) / sum(area_swept), sum(stderr_cpue) FROM stats GROUP BY ALL)""", CRAB_CTE)
def abundance_comparison(spark, sf_dir):
    frame = cpue_frame(spark, sf_dir)
    report = {
        "abundance_naive": estimate.abundance_naive(frame),
        "abundance_weighted_crab": estimate.abundance_weighted(frame),
        "cpue_naive": estimate.cpue_naive(frame),
    }
    return rounded(abundance.stacked(report, {
        "abundance_naive": "abundance_mil", "abundance_weighted_crab": "weighted_abundance",
        "cpue_naive": "cpue"}))


@query("interannual_comparison", """
SELECT l.region, l.size_sex, year, n, CASE WHEN l.size_sex LIKE '%female%' THEN 'Female' ELSE 'Male' END AS sex,
       round(estimate, 6) AS estimate, round(CASE WHEN year = 1995 THEN estimate ELSE estimate - base END, 6) AS coef,
       round(se, 6) AS se_coef, round(sqrt(s2 / n), 6) AS se_mean,
       round(greatest(estimate - 1.96 * se, 0), 6) AS lower, round(estimate + 1.96 * se, 6) AS upper
FROM (SELECT l.*, p.base, p.s2, CASE WHEN year = 1995 THEN sqrt(s2 / n) ELSE sqrt(s2 / n + s2 / base_n) END AS se
      FROM levels l JOIN pooled p ON l.region = p.region AND l.size_sex = p.size_sex) l""", FACTOR_CTE)
def interannual_comparison(spark, sf_dir):
    return rounded(abundance.interannual_comparison(cpue_frame(spark, sf_dir), 1995))


@query("temperature_indices", f"""
SELECT year, mean_bt, cpa, cp_cod FROM
  (SELECT year, round(avg(v), 9) AS mean_bt FROM pooled GROUP BY 1)
  FULL JOIN (SELECT year, count(*) * 401 AS cpa FROM pooled WHERE v < 2 AND station NOT IN ({EXCLUDED}) GROUP BY 1) USING (year)
  FULL JOIN (SELECT p.year, round(avg(h.lat), 9) AS cp_cod FROM good h RIGHT JOIN pooled p ON h.year = p.year AND h.station = p.station
             WHERE p.v < 2 GROUP BY 1) USING (year)""", """
good AS (SELECT * FROM sv_haul WHERE haul_type = 3 AND performance >= 0 AND year >= 1996),
pooled AS (SELECT year, station, gear_temp AS v FROM good WHERE gear_temp IS NOT NULL AND station IN (
  SELECT station FROM good GROUP BY 1 HAVING count(gear_temp) >= 4))
""")
def temperature_indices(spark, sf_dir):
    hauls = views.haul(spark, sf_dir)
    panel = temperature.temperature_panel(hauls, 1996, 4).filter(F.col("gear_temp").isNotNull())
    corners = excluded_stations(spark, sf_dir).select(station_key().alias("station"))
    return rounded(temperature.temperature_indices(panel, hauls, corners, 1996, "gear_temp"), 9)


@query("temperature_indices_imputed")
def temperature_indices_imputed(spark, sf_dir):
    hauls = views.haul(spark, sf_dir)
    panel = temperature.temperature_panel(hauls, None, 5)
    corners = excluded_stations(spark, sf_dir).select(station_key().alias("station"))
    pooled = temperature.imputed_panel(panel, k=200, m=100)
    return temperature.temperature_indices(pooled.filter(F.col("mean").isNotNull()), hauls, corners)


YEARLY_TEMP = """,
yearly AS (SELECT year, avg(nbt) AS raw_temp,
  sum(nbt * w) / sum(CASE WHEN nbt IS NOT NULL THEN w END) AS occupied_temp
  FROM (SELECT year, nbt, nullif(total_cpue, 0) AS w FROM total) GROUP BY 1),
two AS (SELECT 'difference' AS pair, year, raw_temp - occupied_temp AS x, raw_temp AS y FROM yearly
        UNION ALL SELECT 'occupied_temp', year, occupied_temp, raw_temp FROM yearly)
"""


@query("occupancy_lags", """
SELECT a.pair, CAST(lag AS INT) AS lag, round(sum((a.x - mx) * (b.y - my)) / (max(n) * max(sx) * max(sy)), 5) AS ccf
FROM two b CROSS JOIN range(-3, 4) l(lag) JOIN two a ON a.pair = b.pair AND a.year = b.year + lag
JOIN (SELECT pair, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, count(*) AS n FROM two GROUP BY 1) s
  ON s.pair = a.pair GROUP BY 1, 2""", TOTAL_CTE + YEARLY_TEMP)
def occupancy_lags(spark, sf_dir):
    _, lags = temperature.occupancy_lags(station_total(spark, sf_dir), "nbt", "total_cpue", 3)
    return rounded(lags, 5)


@query("taxon_structure", """
SELECT taxon, year, round(t.mean_temp, 9) AS mean_temp, round(d.diversity, 6) AS diversity, round(xcg, 6) AS xcg,
       round(ycg, 6) AS ycg, round(inertia, 5) AS inertia
FROM (SELECT taxon, year, avg(gear_temp) AS mean_temp FROM cells GROUP BY 1, 2) t
JOIN (SELECT taxon, year, coalesce(sum(CASE WHEN p > 0 THEN -p * log2(p) END), 0) AS diversity
      FROM (SELECT taxon, year, cpue / sum(cpue) OVER (PARTITION BY taxon, year) AS p FROM cells) GROUP BY 1, 2) d USING (taxon, year)
JOIN (SELECT taxon, year, any_value(xcg) AS xcg, any_value(ycg) AS ycg,
             sum(((lon - xcg) * (lon - xcg) + (lat - ycg) * (lat - ycg)) * cpue) / sum(cpue) AS inertia
      FROM (SELECT *, sum(lon * cpue) OVER (PARTITION BY taxon, year) / sum(cpue) OVER (PARTITION BY taxon, year) AS xcg,
                   sum(lat * cpue) OVER (PARTITION BY taxon, year) / sum(cpue) OVER (PARTITION BY taxon, year) AS ycg FROM cells)
      GROUP BY 1, 2) g USING (taxon, year)""", CPUE_CTE + """,
rows0 AS (SELECT c.year, c.station, c.lon, c.lat, c.size_sex AS taxon, c.cpue, h.gear_temp FROM cpue_long c
  JOIN sv_haul h ON h.year = c.year AND h.station = c.station),
full_stations AS (SELECT station FROM rows0 GROUP BY 1 HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM rows0)),
positions AS (SELECT station, avg(lon) AS lon, avg(lat) AS lat FROM (
  SELECT DISTINCT station, year, lon, lat FROM rows0) GROUP BY 1),
held AS (SELECT taxon, station FROM rows0 GROUP BY 1, 2 HAVING sum(cpue) > 0),
cells AS (SELECT r.taxon, r.year, r.station, r.cpue, r.gear_temp, p.lon, p.lat FROM rows0 r
  JOIN full_stations f ON f.station = r.station JOIN positions p ON p.station = r.station
  JOIN held k ON k.taxon = r.taxon AND k.station = r.station)
""")
def taxon_structure(spark, sf_dir):
    temps = views.haul(spark, sf_dir).select("year", "station", "gear_temp")
    rows = cpue_frame(spark, sf_dir).select(
        "year", "station", "lon", "lat", F.col("size_sex").alias("taxon"), "cpue")
    out = structure.taxon_structure(rows.join(temps, ["year", "station"]), "gear_temp")
    return rounded(out["indices"], 6, inertia=5, mean_temp=9)


# -- sinks: written to the shared folder, read back --------------------------------------

@query("write_table", """
SELECT fmt, year, count(*) AS n, round(sum(cpue), 2) AS cpue
FROM cpue_long CROSS JOIN (VALUES ('csv'), ('parquet')) AS f(fmt) GROUP BY 1, 2""", CPUE_CTE)
def write_table_query(spark, sf_dir):
    """The same table as CSV and as Parquet by year, both read back."""
    path = f"{scratch_folder(spark)}/cpue-{uuid.uuid4()}"
    cpue = cpue_frame(spark, sf_dir)
    write_table(cpue, path, partition_by=["year"])
    write_table(cpue, f"{path}.csv", "csv")
    back = {"parquet": read_table(spark, path), "csv": read_table(spark, f"{path}.csv", cpue.schema)}
    parts = [df.groupBy(F.lit(fmt).alias("fmt"), "year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cpue"), 2).alias("cpue")) for fmt, df in back.items()]
    return parts[0].unionByName(parts[1])


@query("write_imputations", """
SELECT CAST(l_linenumber AS INT) AS imputation, count(*) AS n, sum(l_quantity) AS total FROM lineitem
WHERE l_linenumber IN (1, 3) GROUP BY 1""", views=False)
def write_imputations_query(spark, sf_dir):
    path = f"{scratch_folder(spark)}/imputations-{uuid.uuid4()}"
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("imputation"), "l_partkey", "l_quantity")
    write_imputations(lines, path)
    return read_imputations(spark, path, [1, 3]).groupBy("imputation").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))
