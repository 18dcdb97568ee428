"""Catch to abundance: sources, CPUE, stratified estimates, bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from survey_queries import views
from survey_queries.registry import query
from trawlframe.functions import area_swept, region_from_district, size_sex_class, strict_sum
from trawlframe.operators import bootstrap, cpue, estimate, joins, prep

REPS = 1000
SEED = 1

CLASS_SQL = """CASE WHEN sex = 1 AND cw > 31 AND cw <= 60 THEN 'male31to60'
     WHEN sex = 1 AND cw > 61 AND cw <= 90 THEN 'male61to90'
     WHEN sex = 1 AND cw > 91 AND cw <= 120 THEN 'male91to120'
     WHEN sex = 2 AND clutch > 0 THEN 'mature_female'
     WHEN sex = 2 AND clutch = 0 THEN 'immature_female' END"""
AREA_SQL = "distance_fished * (net_width / 1000.0) * (CAST(0.539957 AS DOUBLE) * CAST(0.539957 AS DOUBLE))"

CPUE_CTE = f"""
joined AS (
  SELECT coalesce(c.year, h.year) AS year, coalesce(c.station, h.station) AS station, lat, lon,
         {AREA_SQL} AS area_swept, {CLASS_SQL} AS size_sex, sample_factor
  FROM sv_catch c FULL OUTER JOIN sv_haul h ON c.station = h.station AND c.year = h.year),
per_class AS (
  SELECT year, station, lat, lon, area_swept, size_sex,
         CASE WHEN count(sample_factor) = count(*) THEN sum(sample_factor) END AS num_crab
  FROM joined GROUP BY ALL),
stations AS (
  SELECT DISTINCT p.year, p.station, p.lat, p.lon, p.area_swept, s.district,
         CASE WHEN s.stratum = 999 THEN 10 ELSE s.stratum END AS stratum_crab, s.total_area,
         CASE WHEN s.district = 'NBS All' THEN 'NBS' ELSE 'EBS' END AS region
  FROM per_class p RIGHT JOIN sv_strata s ON p.year = s.year AND p.station = s.station
  WHERE p.area_swept IS NOT NULL),
cpue_long AS (
  SELECT s.*, h.stratum_fish, k.size_sex, coalesce(p.num_crab, 0) AS num_crab,
         coalesce(p.num_crab, 0) / s.area_swept AS cpue
  FROM stations s
  CROSS JOIN (SELECT unnest(['male31to60','male61to90','male91to120','mature_female','immature_female']) AS size_sex) k
  LEFT JOIN per_class p ON p.year = s.year AND p.station = s.station AND p.lat = s.lat
        AND p.lon = s.lon AND p.area_swept = s.area_swept AND p.size_sex = k.size_sex
  LEFT JOIN sv_haul h ON h.year = s.year AND h.station = s.station)
"""


def cpue_frame(spark, sf_dir, **options):
    return cpue.cpue_long(
        views.catch(spark, sf_dir), views.haul(spark, sf_dir), views.strata(spark, sf_dir), **options
    )


def rounded(df, digits=6, **special):
    """Doubles rounded for comparison, floats aside."""
    return df.withColumns({
        f.name: F.round(f.name, special.get(f.name, digits))
        for f in df.schema.fields if f.dataType.typeName() == "double"
    })


@query("cpue_long", """
SELECT year, station, round(lat, 6) AS lat, round(lon, 6) AS lon, round(area_swept, 9) AS area_swept,
       district, CAST(stratum_crab AS INT) AS stratum_crab, stratum_fish, total_area, region,
       size_sex, num_crab, round(cpue, 4) AS cpue FROM cpue_long""", CPUE_CTE)
def cpue_long(spark, sf_dir):
    return rounded(cpue_frame(spark, sf_dir), 6, area_swept=9, cpue=4)


@query("catch_haul_full_join", f"""
SELECT coalesce(c.year, h.year) AS year, coalesce(c.station, h.station) AS station,
       count(c.rec_id) AS records, count(*) AS n_rows, round(max({AREA_SQL}), 9) AS area_swept
FROM sv_catch c FULL OUTER JOIN sv_haul h ON c.station = h.station AND c.year = h.year
GROUP BY 1, 2""")
def catch_haul_full_join(spark, sf_dir):
    both = joins.catch_with_hauls(
        views.catch(spark, sf_dir), views.haul(spark, sf_dir), ["year", "station"]
    )
    return both.groupBy("year", "station").agg(
        F.count("rec_id").alias("records"), F.count(F.lit(1)).alias("n_rows"),
        F.round(F.max(area_swept()), 9).alias("area_swept"),
    )


@query("strata_right_join", f"""
SELECT s.year, s.station, district, stratum, total_area, round({AREA_SQL}, 9) AS area_swept
FROM sv_haul h RIGHT JOIN sv_strata s ON h.year = s.year AND h.station = s.station
WHERE {AREA_SQL} IS NOT NULL""")
def strata_right_join(spark, sf_dir):
    effort = views.haul(spark, sf_dir).select(
        "year", "station", F.round(area_swept(), 9).alias("area_swept")
    )
    return joins.with_strata(effort, views.strata(spark, sf_dir))


@query("second_strata_right_join", """
SELECT s.year, s.station, s.district, h.stratum_fish
FROM sv_haul h RIGHT JOIN sv_strata s ON h.year = s.year AND h.station = s.station""")
def second_strata_right_join(spark, sf_dir):
    fish = views.haul(spark, sf_dir).select("year", "station", "stratum_fish")
    return joins.with_second_strata(
        views.strata(spark, sf_dir).select("year", "station", "district"), fish
    )


@query("strict_catch_sum", f"""
SELECT year, station, {CLASS_SQL} AS size_sex,
       CASE WHEN count(sample_factor) = count(*) THEN sum(sample_factor) END AS num_crab,
       count(*) AS n_rows
FROM sv_catch GROUP BY 1, 2, 3""")
def strict_catch_sum(spark, sf_dir):
    records = views.catch(spark, sf_dir).withColumn("size_sex", size_sex_class())
    return records.groupBy("year", "station", "size_sex").agg(
        strict_sum("sample_factor").alias("num_crab"), F.count(F.lit(1)).alias("n_rows")
    )


@query("densify", f"""
SELECT y.year, d.district, k.size_sex, coalesce(n.n, 0) AS n
FROM (SELECT DISTINCT year FROM sv_catch) y CROSS JOIN (SELECT DISTINCT district FROM sv_strata) d
CROSS JOIN (SELECT DISTINCT {CLASS_SQL} AS size_sex FROM sv_catch WHERE {CLASS_SQL} IS NOT NULL) k
LEFT JOIN (SELECT c.year, s.district, {CLASS_SQL} AS size_sex, count(*) AS n
           FROM sv_catch c JOIN sv_strata s ON c.year = s.year AND c.station = s.station
           GROUP BY 1, 2, 3) n
  ON n.year = y.year AND n.district = d.district AND n.size_sex = k.size_sex""")
def densify(spark, sf_dir):
    counts = (
        views.catch(spark, sf_dir).withColumn("size_sex", size_sex_class())
        .join(views.strata(spark, sf_dir), ["year", "station"])
        .groupBy("year", "district", "size_sex").agg(F.count(F.lit(1)).alias("n"))
    )
    return prep.densify(counts, ["year", "district"], "size_sex", "n", fill=0)


STATS_CTE = CPUE_CTE + """,
stats AS (
  SELECT year, region, {stratum} AS stratum, size_sex, avg(total_area) AS total_area,
         avg(cpue) AS mean_cpue, var_samp(cpue) AS var_cpue, count(*) AS n_stations,
         sum(num_crab) AS num_crab, sum(area_swept) AS area_swept,
         avg(total_area) * avg(cpue) / 1e6 AS abundance_mil,
         sqrt(avg(total_area) * avg(total_area) * var_samp(cpue) / 1e12 / count(*)) AS stderr_mil,
         sqrt(var_samp(cpue) / count(*)) AS stderr_cpue
  FROM cpue_long GROUP BY 1, 2, 3, 4)
"""
CRAB_CTE = STATS_CTE.format(stratum="stratum_crab")
FISH_CTE = STATS_CTE.format(stratum="stratum_fish")
Z = "CAST(1.959963984540054 AS DOUBLE)"


def _limits_sql(estimate, se, e_name, s_name, digits=6):
    return f"""
SELECT year, region, size_sex, round({e_name}, {digits}) AS {e_name}, round({s_name}, {digits}) AS {s_name},
       round({e_name} - {Z} * {s_name}, {digits}) AS lwr_95, round({e_name} + {Z} * {s_name}, {digits}) AS upp_95
FROM (SELECT year, region, size_sex, {estimate} AS {e_name}, {se} AS {s_name} FROM stats GROUP BY 1, 2, 3)"""


NAIVE_SQL = _limits_sql("sum(abundance_mil)", "sum(stderr_mil)", "abundance_mil", "stderr_mil")
WEIGHTED_SQL = _limits_sql(
    "sum(total_area * abundance_mil) / sum(total_area)",
    "sum(total_area * total_area * stderr_mil) / (sum(total_area) * sum(total_area))",
    "weighted_abundance", "stderr_mil")
CPUE_NAIVE_SQL = _limits_sql(
    "sum(num_crab) / sum(area_swept)", "sum(stderr_cpue)", "cpue", "stderr", 4)
CPUE_WEIGHTED_SQL = _limits_sql(
    "sum(total_area * num_crab) / sum(total_area * area_swept)",
    "sum(total_area * total_area * stderr_cpue) / (sum(total_area) * sum(total_area))",
    "cpue", "stderr", 4)


@query("stratum_stats", """
SELECT year, region, CAST(stratum AS INT) AS stratum_crab, size_sex, round(total_area, 6) AS total_area, round(mean_cpue, 4) AS mean_cpue,
       round(var_cpue, 1) AS var_cpue, n_stations, num_crab, round(area_swept, 6) AS area_swept,
       round(abundance_mil, 6) AS abundance_mil,
       round(stderr_mil * stderr_mil * n_stations, 6) AS var_abund_mil,
       round(stderr_mil, 6) AS stderr_mil, round(stderr_cpue, 4) AS stderr_cpue
FROM stats""", CRAB_CTE)
def stratum_stats(spark, sf_dir):
    return rounded(estimate.stratum_stats(cpue_frame(spark, sf_dir)), 6,
                   mean_cpue=4, var_cpue=1, stderr_cpue=4)


@query("abundance_naive", NAIVE_SQL, CRAB_CTE)
def abundance_naive(spark, sf_dir):
    return rounded(estimate.abundance_naive(cpue_frame(spark, sf_dir)))


@query("abundance_naive_quadrature", _limits_sql(
    "sum(abundance_mil)", "sqrt(sum(stderr_mil * stderr_mil))", "abundance_mil", "stderr_mil"),
    CRAB_CTE)
def abundance_naive_quadrature(spark, sf_dir):
    return rounded(estimate.abundance_naive(cpue_frame(spark, sf_dir), se_rule="quadrature"))


@query("abundance_weighted", WEIGHTED_SQL, CRAB_CTE)
def abundance_weighted(spark, sf_dir):
    return rounded(estimate.abundance_weighted(cpue_frame(spark, sf_dir)))


@query("abundance_weighted_fish", WEIGHTED_SQL, FISH_CTE)
def abundance_weighted_fish(spark, sf_dir):
    return rounded(estimate.abundance_weighted(cpue_frame(spark, sf_dir), "stratum_fish"))


@query("cpue_naive", CPUE_NAIVE_SQL, CRAB_CTE)
def cpue_naive(spark, sf_dir):
    return rounded(estimate.cpue_naive(cpue_frame(spark, sf_dir)), 4)


@query("cpue_weighted", CPUE_WEIGHTED_SQL, CRAB_CTE)
def cpue_weighted(spark, sf_dir):
    return rounded(estimate.cpue_weighted(cpue_frame(spark, sf_dir)), 4)


@query("cpue_weighted_fish", CPUE_WEIGHTED_SQL, FISH_CTE)
def cpue_weighted_fish(spark, sf_dir):
    return rounded(estimate.cpue_weighted(cpue_frame(spark, sf_dir), "stratum_fish"), 4)


# -- bootstrap ---------------------------------------------------------------

PRIME = 2**52 - 47


def _hash_sql(row):
    """The two whole numbers of a row, from which all its draws follow (up to 1024 of them)."""
    digest = f"md5(concat_ws('|', '{SEED}', year, district, size_sex, {row}, 0))"
    return ", ".join(f"(('0x' || substr({digest}, {i}, 13))::BIGINT % {PRIME}) AS {name}"
                     for i, name in ((1, "ha"), (14, "hb")))


DRAW = f"((ha + (rep - 1) * hb) % {PRIME})"
POISSON_STEPS = " + ".join(
    f"CAST(u >= {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r}::DOUBLE AS INT)"
    for k in range(bootstrap.MOST))


INDEX_CTE = CRAB_CTE + f""",
ranked AS (
  SELECT year, district, size_sex, cpue, total_area,
         row_number() OVER (PARTITION BY year, district, size_sex ORDER BY station, cpue) - 1 AS k,
         count(*) OVER (PARTITION BY year, district, size_sex) AS n
  FROM cpue_long),
numbered AS (SELECT *, {_hash_sql('k')} FROM ranked),
draws AS (
  SELECT year, district, size_sex, rep, {DRAW} % n AS pick
  FROM numbered CROSS JOIN (SELECT unnest(range(1, {REPS + 1})) AS rep)),
means AS (
  SELECT d.year, d.district, d.size_sex, d.rep, avg(n.cpue) AS mean_cpue, avg(n.total_area) AS mean_area
  FROM draws d JOIN numbered n ON n.year = d.year AND n.district = d.district
       AND n.size_sex = d.size_sex AND n.k = d.pick
  GROUP BY ALL)"""
POISSON_CTE = CRAB_CTE + f""",
hashed AS (SELECT year, district, size_sex, cpue, total_area, {_hash_sql('station')} FROM cpue_long),
drawn AS (
  SELECT year, district, size_sex, rep, cpue, total_area, {DRAW}::DOUBLE / {PRIME} AS u
  FROM hashed CROSS JOIN (SELECT unnest(range(1, {REPS + 1})) AS rep)),
counted AS (SELECT *, {POISSON_STEPS} AS w FROM drawn),
means AS (
  SELECT year, district, size_sex, rep, sum(w * cpue) / nullif(sum(w), 0) AS mean_cpue,
         sum(w * total_area) / nullif(sum(w), 0) AS mean_area
  FROM counted GROUP BY ALL)"""
BOOT_ABUNDANCE_SQL = """
SELECT year, region, size_sex, round(abundance_mil, 6) AS abundance_mil,
       round(lwr_95, 6) AS lwr_95, round(upp_95, 6) AS upp_95
FROM (SELECT year, CASE WHEN district = 'NBS All' THEN 'NBS' ELSE 'EBS' END AS region, size_sex,
             sum(lwr) AS lwr_95, sum(upp) AS upp_95
      FROM (SELECT year, district, size_sex,
                   quantile_cont(mean_cpue * mean_area / 1e6, 0.025) AS lwr,
                   quantile_cont(mean_cpue * mean_area / 1e6, 0.975) AS upp
            FROM means GROUP BY ALL) GROUP BY ALL)
FULL JOIN (SELECT year, region, size_sex, sum(abundance_mil) AS abundance_mil FROM stats GROUP BY ALL)
  USING (year, region, size_sex)"""
BOOT_CPUE_SQL = """
SELECT year, region, size_sex, round(cpue, 4) AS cpue, round(lwr_95, 4) AS lwr_95, round(upp_95, 4) AS upp_95
FROM (SELECT year, CASE WHEN district = 'NBS All' THEN 'NBS' ELSE 'EBS' END AS region, size_sex,
             avg(lwr) AS lwr_95, avg(upp) AS upp_95
      FROM (SELECT year, district, size_sex, quantile_cont(mean_cpue, 0.025) AS lwr,
                   quantile_cont(mean_cpue, 0.975) AS upp
            FROM means GROUP BY ALL) GROUP BY ALL)
FULL JOIN (SELECT year, region, size_sex, sum(num_crab) / sum(area_swept) AS cpue FROM stats GROUP BY ALL)
  USING (year, region, size_sex)"""


@query("abundance_bootstrap", BOOT_ABUNDANCE_SQL, INDEX_CTE)
def abundance_bootstrap(spark, sf_dir):
    frame = cpue_frame(spark, sf_dir)
    return rounded(bootstrap.abundance_bootstrap(
        frame, estimate.abundance_naive(frame), REPS, SEED))


@query("abundance_bootstrap_poisson", BOOT_ABUNDANCE_SQL, POISSON_CTE)
def abundance_bootstrap_poisson(spark, sf_dir):
    frame = cpue_frame(spark, sf_dir)
    return rounded(bootstrap.abundance_bootstrap(
        frame, estimate.abundance_naive(frame), REPS, SEED, "poisson"))


@query("abundance_bootstrap_multinomial")
def abundance_bootstrap_multinomial(spark, sf_dir):
    frame = cpue_frame(spark, sf_dir)
    return rounded(bootstrap.abundance_bootstrap(
        frame, estimate.abundance_naive(frame), REPS, SEED, "multinomial"))


@query("cpue_bootstrap", BOOT_CPUE_SQL, INDEX_CTE)
def cpue_bootstrap(spark, sf_dir):
    frame = cpue_frame(spark, sf_dir)
    return rounded(bootstrap.cpue_bootstrap(frame, estimate.cpue_naive(frame), REPS, SEED), 4)


# -- 1 mm classes --------------------------------------------------------------

MM_CTE = CPUE_CTE + f""",
mm_rows AS (
  SELECT year, station, sample_factor,
         CASE WHEN sex IS NULL AND cw IS NULL THEN NULL
              ELSE coalesce(CAST(sex AS VARCHAR), 'NA') || '_' ||
                   coalesce(CAST(CAST(round_even(cw, 0) AS INT) AS VARCHAR), 'NA') END AS size_sex
  FROM sv_catch),
mm_class AS (
  SELECT year, station, size_sex,
         CASE WHEN count(sample_factor) = count(*) THEN sum(sample_factor) END AS num_crab
  FROM mm_rows WHERE size_sex IS NOT NULL GROUP BY ALL),
mm_long AS (
  SELECT s.*, k.size_sex, coalesce(p.num_crab, 0) AS num_crab,
         coalesce(p.num_crab, 0) / s.area_swept AS cpue
  FROM stations s CROSS JOIN (SELECT DISTINCT size_sex FROM mm_class) k
  LEFT JOIN mm_class p ON p.year = s.year AND p.station = s.station AND p.size_sex = k.size_sex),
mm_stats AS (
  SELECT year, region, stratum_crab, size_sex, avg(total_area) AS total_area,
         avg(total_area) * avg(cpue) / 1e6 AS abundance_mil,
         sqrt(avg(total_area) * avg(total_area) * var_samp(cpue) / 1e12 / count(*)) AS stderr_mil
  FROM mm_long GROUP BY 1, 2, 3, 4),
mm_abundance AS (
  SELECT year, region, size_sex, sum(total_area * abundance_mil) / sum(total_area) AS weighted_abundance,
         sum(total_area * total_area * stderr_mil) / (sum(total_area) * sum(total_area)) AS stderr_mil
  FROM mm_stats GROUP BY 1, 2, 3)
"""


def _mm_cells(spark, sf_dir):
    return cpue.cpue_1mm_cells(
        views.catch(spark, sf_dir), views.haul(spark, sf_dir), views.strata(spark, sf_dir)
    )


@query("cpue_long_1mm", """
SELECT year, district, size_sex, count(*) AS stations, count_if(num_crab > 0) AS with_catch,
       sum(num_crab) AS num_crab, round(sum(cpue), 3) AS cpue_sum, round(max(cpue), 3) AS cpue_max
FROM mm_long GROUP BY 1, 2, 3""", MM_CTE)
def cpue_long_1mm(spark, sf_dir):
    dense = cpue.cpue_long_1mm(
        views.catch(spark, sf_dir), views.haul(spark, sf_dir), views.strata(spark, sf_dir)
    )
    return dense.groupBy("year", "district", "size_sex").agg(
        F.count(F.lit(1)).alias("stations"), F.count_if(F.col("num_crab") > 0).alias("with_catch"),
        F.sum("num_crab").alias("num_crab"), F.round(F.sum("cpue"), 3).alias("cpue_sum"),
        F.round(F.max("cpue"), 3).alias("cpue_max"),
    )


@query("abundance_1mm", f"""
SELECT year, region, size_sex, round(weighted_abundance, 6) AS weighted_abundance,
       round(stderr_mil, 6) AS stderr_mil, round(weighted_abundance - {Z} * stderr_mil, 6) AS lwr_95,
       round(weighted_abundance + {Z} * stderr_mil, 6) AS upp_95 FROM mm_abundance""", MM_CTE)
def abundance_1mm(spark, sf_dir):
    return rounded(estimate.abundance_1mm(*_mm_cells(spark, sf_dir)))


@query("size_composition", """
SELECT year, sex, size, round(abundance_mil, 6) AS abundance_mil, round(w, 6) AS w,
       round(median_size, 4) AS median_size, round(q90_size, 4) AS q90_size
FROM kept JOIN marks USING (year, sex)""", MM_CTE + """,
sized AS (
  SELECT year, CASE WHEN split_part(size_sex, '_', 1) = '1' THEN 'Male' ELSE 'Female' END AS sex,
         TRY_CAST(split_part(size_sex, '_', 2) AS DOUBLE) AS size, sum(weighted_abundance) AS abundance_mil
  FROM mm_abundance WHERE region = 'NBS' AND weighted_abundance <> 0 GROUP BY 1, 2, 3 HAVING size >= 30),
kept AS (SELECT *, abundance_mil / sum(abundance_mil) OVER (PARTITION BY year, sex) AS w FROM sized),
steps AS (
  SELECT *, sum(abundance_mil) OVER (PARTITION BY year, sex ORDER BY size)
            / sum(abundance_mil) OVER (PARTITION BY year, sex) AS c FROM sized),
ends AS (
  SELECT year, sex, p, max(CASE WHEN c <= p THEN c END) AS c0, max(CASE WHEN c <= p THEN size END) AS x0,
         min(CASE WHEN c > p THEN c END) AS c1, min(CASE WHEN c > p THEN size END) AS x1
  FROM steps CROSS JOIN (SELECT unnest([0.5, 0.9]::DOUBLE[]) AS p) GROUP BY ALL),
marks AS (
  SELECT year, sex,
         max(CASE WHEN p = 0.5 THEN CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0
             ELSE x0 + (p - c0) / (c1 - c0) * (x1 - x0) END END) AS median_size,
         max(CASE WHEN p = 0.9 THEN CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0
             ELSE x0 + (p - c0) / (c1 - c0) * (x1 - x0) END END) AS q90_size
  FROM ends GROUP BY 1, 2)
""")
def size_composition(spark, sf_dir):
    out = estimate.size_composition(estimate.abundance_1mm(*_mm_cells(spark, sf_dir)))
    return rounded(out, 6, median_size=4, q90_size=4)


@query("backfill_period", """
SELECT year, station, stratum_fish FROM sv_haul WHERE year <> 1997
UNION ALL SELECT 1997, station, stratum_fish FROM sv_haul WHERE year = 1996""")
def backfill_period(spark, sf_dir):
    fish = views.haul(spark, sf_dir).select("year", "station", "stratum_fish")
    return prep.backfill_period(fish, 1996, 1997)


@query("assign_region", """
SELECT district, CASE WHEN district = 'NBS All' THEN 'NBS' ELSE 'EBS' END AS region,
       count(*) AS n_rows FROM sv_strata GROUP BY 1, 2""")
def assign_region(spark, sf_dir):
    return views.strata(spark, sf_dir).groupBy("district").agg(
        F.count(F.lit(1)).alias("n_rows")
    ).withColumn("region", region_from_district())
