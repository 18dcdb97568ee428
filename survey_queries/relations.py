"""Series: correlation, regression, variograms, imputation, PCA, delta models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from survey_queries import views
from survey_queries.estimates import CPUE_CTE, PRIME, cpue_frame, rounded
from survey_queries.records import WIDE_CTE, station_wide
from survey_queries.registry import query
from survey_queries.space import TOTAL_CTE, station_total
from trawlframe.functions import fourth_root, log_plus_one, strict_avg
from trawlframe.operators import impute, models, pairs, panel, pca, prep, series
from trawlframe.session import BROADCAST_BYTES, ROW_BYTES, cut_lineage

K = 20
# Copies of each imputed panel.
COPIES = 100

DISTRICT_CTE = CPUE_CTE + """,
district_panel AS (SELECT year AS t, district || '|' || size_sex AS series, avg(cpue) AS value FROM cpue_long GROUP BY 1, 2)
"""


def district_panel(spark, sf_dir):
    """Mean CPUE of each district and class: a panel with few series, from all rows."""
    return cpue_frame(spark, sf_dir).groupBy(
        F.col("year").alias("t"), F.concat_ws("|", "district", "size_sex").alias("series")
    ).agg(F.avg("cpue").alias("value"))


@query("pairwise_corr", """
SELECT a.series, b.series AS other, round(corr(a.value, b.value), 6) AS r, count(*) AS n
FROM district_panel a JOIN district_panel b ON a.t = b.t AND a.series < b.series GROUP BY 1, 2""", DISTRICT_CTE)
def pairwise_corr(spark, sf_dir):
    return rounded(pairs.pairwise_corr(district_panel(spark, sf_dir), "t", "series", "value"))


@query("pairwise_cov", """
SELECT a.series, b.series AS other, round(covar_samp(a.value, b.value), 1) AS cov, count(*) AS n
FROM district_panel a JOIN district_panel b ON a.t = b.t AND a.series <= b.series GROUP BY 1, 2""", DISTRICT_CTE)
def pairwise_cov(spark, sf_dir):
    return rounded(pairs.pairwise_cov(district_panel(spark, sf_dir), "t", "series", "value"), 1)


PREDICTOR_CTE = TOTAL_CTE + f""",
known AS (SELECT year, station, pow(total_cpue, 0.25) AS v FROM total),
strength AS (SELECT a.station AS series, b.station AS predictor, corr(a.v, b.v) AS r
  FROM known a JOIN known b ON a.year = b.year GROUP BY 1, 2 HAVING count(*) >= 2),
ranked AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY d)
         + (count(*) OVER (PARTITION BY series, d) - 1) / 2.0::DOUBLE AS rank
  FROM (SELECT *, round(1 - abs(r), 9) AS d FROM strength WHERE r IS NOT NULL AND NOT isnan(r))),
predictors AS (SELECT series, predictor, r, rank FROM ranked WHERE rank <= {K} AND series <> predictor)
"""


def catch_panel(spark, sf_dir):
    """Fourth-root total CPUE of every station by year, with the gaps the survey has."""
    return station_total(spark, sf_dir).select("year", "station", fourth_root("total_cpue").alias("v"))


@query("best_predictors", """
SELECT series, predictor, round(r, 6) AS r, rank FROM predictors""", PREDICTOR_CTE)
def best_predictors(spark, sf_dir):
    return rounded(pairs.best_predictors(catch_panel(spark, sf_dir), "year", "station", "v", K))


IMPUTE_CTE = PREDICTOR_CTE + """,
fits AS (SELECT *, greatest(1 - r2, 0) * var_y AS rv FROM (
  SELECT p.series, p.predictor, regr_slope(y.v, x.v) AS slope, regr_intercept(y.v, x.v) AS intercept,
         regr_r2(y.v, x.v) AS r2, var_samp(y.v) AS var_y
  FROM predictors p JOIN known x ON x.station = p.predictor JOIN known y ON y.station = p.series AND y.year = x.year
  GROUP BY 1, 2 HAVING regr_r2(y.v, x.v) IS NOT NULL)),
missing AS (SELECT y.year, s.station FROM (SELECT DISTINCT year FROM known) y
  CROSS JOIN (SELECT DISTINCT station FROM known) s
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.year = y.year AND k.station = s.station)),
parts AS (SELECT k.year, f.series, f.slope, f.intercept, f.r2, f.rv, k.v AS x FROM fits f JOIN known k ON k.station = f.predictor),
guess AS (SELECT m.year, m.station, sum(r2 * (intercept + slope * x)) / sum(r2) AS v, sqrt(sum(r2 * rv) / sum(r2)) AS sd,
                 count(x) AS n_predictors
  FROM missing m LEFT JOIN parts p ON p.year = m.year AND p.series = m.station GROUP BY 1, 2)
"""


@query("impute_panel", """
SELECT year, station, round(v, 5) AS v, n_predictors FROM guess""", IMPUTE_CTE)
def impute_panel(spark, sf_dir):
    return rounded(impute.impute_panel(catch_panel(spark, sf_dir), "year", "station", "v", K), 5)


@query("impute_panel_multiple", f"""
SELECT imputation, year, station, round(v, 5) AS v FROM known CROSS JOIN (SELECT unnest(range(1, {COPIES + 1}))::INT AS imputation)
UNION ALL
SELECT imputation, year, station, round(v + coalesce(sd, 0) * sqrt(-2 * ln((a + 1)::DOUBLE / ({PRIME} + 1)::DOUBLE)) * cos(2 * pi() * (b::DOUBLE / {PRIME}::DOUBLE)), 5)
FROM (SELECT *, ('0x' || substr(digest, 1, 13))::BIGINT % {PRIME} AS a, ('0x' || substr(digest, 14, 13))::BIGINT % {PRIME} AS b
      FROM (SELECT *, md5(concat_ws('|', '7', station, year, imputation)) AS digest
            FROM guess CROSS JOIN (SELECT unnest(range(1, {COPIES + 1}))::INT AS imputation)))""", IMPUTE_CTE)
def impute_panel_multiple(spark, sf_dir):
    observed = catch_panel(spark, sf_dir)
    copies = impute.impute_panel(observed, "year", "station", "v", K, m=COPIES, seed=7)
    return rounded(impute.complete_panels(observed, copies, "year", "station", "v"), 5)


@query("pool_imputations", """
SELECT year, l_suppkey AS supplier, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd,
       round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS std_error
FROM (SELECT *, CAST(year(l_shipdate) AS INT) AS year FROM lineitem) GROUP BY 1, 2""", views=False)
def pool_imputations(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("supplier"), "l_quantity")
    return rounded(series.pool_imputations(lines, "year", "supplier", "l_quantity"))


@query("fill_from", """
SELECT year, station, round(coalesce(nbt, avg(nbt) OVER (PARTITION BY year)), 9) AS nbt FROM station_wide""", WIDE_CTE)
def fill_from(spark, sf_dir):
    wide = station_wide(spark, sf_dir).select("year", "station", "nbt")
    means = wide.groupBy("year").agg(F.avg("nbt").alias("mean"))
    return rounded(series.fill_from(wide, means, ["year"], "nbt"), 9)


@query("correlate", """
SELECT size_sex, round(corr(value, nbt), 6) AS r, count(*) AS n, round(corr(value, nbt) * corr(value, nbt), 6) AS r_squared,
       round(corr(value, nbt) * sqrt((count(*) - 2) / (1 - corr(value, nbt) * corr(value, nbt))), 5) AS t
FROM (SELECT c.size_sex, h.gear_temp AS nbt, pow(c.cpue, 0.25) AS value FROM cpue_long c
      JOIN sv_haul h ON h.year = c.year AND h.station = c.station WHERE h.gear_temp IS NOT NULL) GROUP BY 1""", CPUE_CTE)
def correlate(spark, sf_dir):
    temps = views.haul(spark, sf_dir).select("year", "station", F.col("gear_temp").alias("nbt"))
    both = cpue_frame(spark, sf_dir).join(temps, ["year", "station"]).withColumn("value", fourth_root("cpue"))
    return rounded(series.correlate(both, "value", "nbt", ["size_sex"]), 6, t=5)


YEARLY_CTE = CPUE_CTE + """,
yearly AS (SELECT c.size_sex, c.year, avg(c.cpue) AS x, avg(h.gear_temp) AS y FROM cpue_long c
  JOIN sv_haul h ON h.year = c.year AND h.station = c.station GROUP BY 1, 2)
"""


def yearly(spark, sf_dir):
    temps = views.haul(spark, sf_dir).select("year", "station", "gear_temp")
    return cpue_frame(spark, sf_dir).join(temps, ["year", "station"]).groupBy("size_sex", "year").agg(
        F.avg("cpue").alias("x"), F.avg("gear_temp").alias("y"))


@query("cross_correlation", """
SELECT a.size_sex, CAST(lag AS INT) AS lag, round(sum((a.x - s.mx) * (b.y - s.my)) / (max(n) * max(sx) * max(sy)), 6) AS ccf
FROM yearly b CROSS JOIN range(-3, 4) l(lag) JOIN yearly a ON a.size_sex = b.size_sex AND a.year = b.year + lag
JOIN (SELECT size_sex, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, count(*) AS n FROM yearly GROUP BY 1) s
  ON s.size_sex = a.size_sex GROUP BY 1, 2""", YEARLY_CTE)
def cross_correlation(spark, sf_dir):
    return rounded(series.cross_correlation(yearly(spark, sf_dir), "year", "x", "y", ["size_sex"], 3))


@query("difference_slope", """
SELECT size_sex, round(regr_slope(x - y, year), 4) AS slope FROM yearly GROUP BY 1""", YEARLY_CTE)
def difference_slope(spark, sf_dir):
    gap = series.difference(yearly(spark, sf_dir), "x", "y", "gap")
    return rounded(series.slope(gap, "year", "gap", ["size_sex"]), 4)


FACTOR_CTE = CPUE_CTE + """,
levels AS (SELECT region, size_sex, year, count(*) AS n, avg(pow(cpue, 0.25)) AS estimate,
                  var_pop(pow(cpue, 0.25)) * count(*) AS ss FROM cpue_long GROUP BY 1, 2, 3),
pooled AS (SELECT region, size_sex, sum(ss) / (sum(n) - count(*)) AS s2, max(CASE WHEN year = 1995 THEN n END) AS base_n,
                  max(CASE WHEN year = 1995 THEN estimate END) AS base FROM levels GROUP BY 1, 2)
"""


@query("factor_regression", """
SELECT l.region, l.size_sex, year, n, round(estimate, 6) AS estimate,
       round(CASE WHEN year = 1995 THEN estimate ELSE estimate - base END, 6) AS coef,
       round(CASE WHEN year = 1995 THEN sqrt(s2 / n) ELSE sqrt(s2 / n + s2 / base_n) END, 6) AS se_coef,
       round(sqrt(s2 / n), 6) AS se_mean
FROM levels l JOIN pooled p ON l.region = p.region AND l.size_sex = p.size_sex""", FACTOR_CTE)
def factor_regression(spark, sf_dir):
    return rounded(series.factor_regression(
        cpue_frame(spark, sf_dir), fourth_root("cpue"), "year", ["region", "size_sex"], 1995))


@query("factor_residuals", """
SELECT region, size_sex, year, station, round(pow(cpue, 0.25) - avg(pow(cpue, 0.25)) OVER (PARTITION BY region, size_sex, year), 6) AS residual
FROM cpue_long""", CPUE_CTE)
def factor_residuals(spark, sf_dir):
    out = series.factor_residuals(
        cpue_frame(spark, sf_dir), fourth_root("cpue"), "year", ["region", "size_sex"])
    return rounded(out.select("region", "size_sex", "year", "station", "residual"))


REACH = 0.35
PAIR_CTE = TOTAL_CTE + f""",
resid AS (SELECT year, station, lat, lon, pow(total_cpue, 0.25) - avg(pow(total_cpue, 0.25)) OVER (PARTITION BY year) AS residual FROM total),
cloud AS (
  SELECT a.year, least(a.lon, b.lon) AS k1, greatest(a.lon, b.lon) AS k2, least(a.lat, b.lat) AS k3, greatest(a.lat, b.lat) AS k4,
         (a.lon - b.lon) * (a.lat - b.lat) > 0 AS k5,
         sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS distance,
         (a.residual - b.residual) * (a.residual - b.residual) / 2 AS half
  FROM resid a JOIN resid b ON a.year = b.year AND a.station < b.station
   AND abs(a.lat - b.lat) <= {REACH} AND abs(a.lon - b.lon) <= {REACH}
  WHERE sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) <= {REACH})
"""


def _residuals(spark, sf_dir):
    # Read for the means and for the residuals.
    total = cut_lineage(station_total(spark, sf_dir))
    return series.factor_residuals(total, fourth_root("total_cpue"), "year", [])


@query("variogram_cloud", """
SELECT year, round(avg(distance), 6) AS distance, count(*) AS n_pairs, round(avg(half), 5) AS semivariance
FROM cloud GROUP BY year, k1, k2, k3, k4, k5""", PAIR_CTE)
def variogram_cloud(spark, sf_dir):
    return rounded(series.variogram_cloud(_residuals(spark, sf_dir), "residual", ["year"], REACH),
                   6, semivariance=5)


@query("variogram_binned", f"""
SELECT year, CAST(greatest(ceil(round(distance / {REACH / 7}, 9)), 1) AS INT) AS bin, count(*) AS n_pairs,
       round(avg(distance), 6) AS distance, round(avg(half), 5) AS semivariance FROM cloud GROUP BY 1, 2""", PAIR_CTE)
def variogram_binned(spark, sf_dir):
    return rounded(series.variogram_binned(_residuals(spark, sf_dir), "residual", ["year"], REACH, 7),
                   6, semivariance=5)


@query("delta_aicc", """
SELECT size_sex, model, k, n, round(loglik, 3) AS loglik, round(aicc, 3) AS aicc,
       round(aicc - min(aicc) OVER (PARTITION BY size_sex), 3) AS delta_aicc
FROM (SELECT *, -2 * loglik + 2.0 * k * n / (n - k - 1) AS aicc
      FROM (SELECT size_sex, model, k, n, -n / 2.0 * (ln(2 * pi() * sse / n) + 1) AS loglik FROM (
        SELECT size_sex, 'constant' AS model, 2 AS k, count(*) AS n, var_pop(pow(cpue, 0.25)) * count(*) AS sse FROM cpue_long GROUP BY 1
        UNION ALL SELECT size_sex, 'year', CAST(count(*) + 1 AS INT), CAST(sum(n) AS BIGINT), sum(ss) FROM (
          SELECT size_sex, year, count(*) AS n, var_pop(pow(cpue, 0.25)) * count(*) AS ss FROM cpue_long GROUP BY 1, 2) GROUP BY 1)))""", CPUE_CTE)
def delta_aicc(spark, sf_dir):
    value = fourth_root("cpue")
    frame = cpue_frame(spark, sf_dir)
    constant = frame.groupBy("size_sex").agg(
        F.lit(2).alias("k"), F.count(F.lit(1)).alias("n"),
        (F.var_pop(value) * F.count(F.lit(1))).alias("sse")).withColumn("model", F.lit("constant"))
    by_year = frame.groupBy("size_sex", "year").agg(
        F.count(F.lit(1)).alias("n"), (F.var_pop(value) * F.count(F.lit(1))).alias("ss"))
    yearly_fit = by_year.groupBy("size_sex").agg(
        (F.count(F.lit(1)) + 1).cast("int").alias("k"), F.sum("n").alias("n"),
        F.sum("ss").alias("sse")).withColumn("model", F.lit("year"))
    fits = constant.unionByName(yearly_fit).withColumn(
        "loglik", -F.col("n") / 2.0 * (F.ln(2.0 * math.pi * F.col("sse") / F.col("n")) + 1.0))
    return rounded(series.delta_aicc(fits.drop("sse"), "loglik", "k", "n", ["size_sex"]), 3)


@query("histogram", """
SELECT size_sex, bin, count(*) AS n, round(min(low + (bin - 1) * width), 6) AS lower, round(min(low + bin * width), 6) AS upper
FROM (SELECT size_sex, low, width, CAST(least(floor((v - low) / width) + 1, 20) AS INT) AS bin
      FROM (SELECT size_sex, ln(cpue + 1) AS v, min(ln(cpue + 1)) OVER (PARTITION BY size_sex) AS low,
                   (max(ln(cpue + 1)) OVER (PARTITION BY size_sex) - min(ln(cpue + 1)) OVER (PARTITION BY size_sex)) / 20 AS width
            FROM cpue_long)) GROUP BY 1, 2""", CPUE_CTE)
def histogram(spark, sf_dir):
    return rounded(series.histogram(cpue_frame(spark, sf_dir), log_plus_one("cpue"), 20, ["size_sex"]))


# -- components ------------------------------------------------------------------------

def complete_cells(spark, sf_dir):
    """Fourth-root CPUE of the stations present in every year, empty ones dropped."""
    # Read by the count of years, both choices of series and the panel itself.
    cells = cut_lineage(cpue_frame(spark, sf_dir, spread_out=True).groupBy("year", "station", "size_sex").agg(
        strict_avg("cpue").alias("cpue")))
    full = panel.balanced_panel(cells, "station", "year", "cpue", "every_period")
    return panel.drop_zero_series(full, "station", "cpue", ["size_sex"]).withColumn(
        "value", fourth_root("cpue"))


# The leading eigenvector of the periods x periods matrix by repeated
# multiplication, written as a recursion.
PCA_CTE = CPUE_CTE + """,
complete AS (SELECT c.size_sex, c.year, c.station, pow(c.cpue, 0.25) AS v FROM cpue_long c
  WHERE c.station IN (SELECT station FROM cpue_long GROUP BY 1
                      HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM cpue_long))
    AND (c.size_sex, c.station) IN (SELECT (size_sex, station) FROM cpue_long GROUP BY size_sex, station HAVING sum(cpue) > 0)),
anom AS (SELECT size_sex, year, station, v - avg(v) OVER (PARTITION BY size_sex, year) AS a FROM complete),
dev AS (SELECT *, a - avg(a) OVER (PARTITION BY size_sex, station) AS d FROM anom),
gram AS (SELECT p.size_sex, p.year AS t1, q.year AS t2, sum(p.d * q.d) AS g FROM dev p
  JOIN dev q ON p.size_sex = q.size_sex AND p.station = q.station GROUP BY 1, 2, 3),
mat AS (SELECT size_sex, list(row ORDER BY t1) AS m FROM (
  SELECT size_sex, t1, list(g ORDER BY t2) AS row FROM gram GROUP BY 1, 2) GROUP BY 1),
power AS (
  SELECT size_sex, m, 0 AS i, list_transform(range(1, len(m) + 1), lambda k: (k * k)::DOUBLE) AS u FROM mat
  UNION ALL
  SELECT size_sex, m, i + 1, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) FROM (
    SELECT size_sex, m, i, list_transform(m, lambda row: list_dot_product(row, u)) AS v FROM power WHERE i < 2000)),
lead AS (SELECT size_sex, m, u, list_dot_product(u, list_transform(m, lambda row: list_dot_product(row, u))) AS lambda1
  FROM power WHERE i = 2000),
years AS (SELECT size_sex, list_sort(list(DISTINCT year)) AS ys FROM dev GROUP BY 1),
vec AS (SELECT l.size_sex, unnest(y.ys) AS year, unnest(l.u) AS u, l.lambda1 FROM lead l JOIN years y ON y.size_sex = l.size_sex),
load0 AS (SELECT d.size_sex, d.station, sum(d.d * v.u) / sqrt(max(v.lambda1)) AS loading FROM dev d
  JOIN vec v ON v.size_sex = d.size_sex AND v.year = d.year GROUP BY 1, 2),
score0 AS (SELECT a.size_sex, a.year, sum(a.a * l.loading) AS score FROM anom a
  JOIN load0 l ON l.size_sex = a.size_sex AND l.station = a.station GROUP BY 1, 2),
turn AS (SELECT size_sex, CASE WHEN regr_slope(score, year) < 0 THEN -1 ELSE 1 END AS s, avg(score) AS m, stddev_samp(score) AS sd
  FROM score0 GROUP BY 1)
"""


def eigen_ctes(source: str, key: str, count: int) -> str:
    """Leading eigenvectors by size of the symmetric matrices ``m`` of ``source``, one by ``key``.

    A matrix squared 45 times over is the projector on its leading vector; the matrix
    less that part goes on. ``eigen`` holds component, u and value for each key.
    """
    parts = []
    for k in range(1, count + 1):
        parts.append(f"""sq{k} AS (
  SELECT {key}, m AS p, 0 AS i FROM {source if k == 1 else f"left{k - 1}"}
  UNION ALL
  SELECT {key}, list_transform(q, lambda r: list_transform(r, lambda e: e / scale)), i + 1 FROM (
    SELECT {key}, i, q, sqrt(list_sum(list_transform(q, lambda r: list_dot_product(r, r)))) AS scale FROM (
      SELECT {key}, i, list_transform(p, lambda r: list_transform(p, lambda c: list_dot_product(r, c))) AS q
      FROM sq{k} WHERE i < 45))),
unit{k} AS (SELECT {key}, list_transform(r, lambda e: e / sqrt(list_dot_product(r, r))) AS u FROM (
  SELECT {key}, p[list_position(d, list_max(d))] AS r FROM (
    SELECT {key}, p, list_transform(range(1, len(p) + 1), lambda k: p[k][k]) AS d FROM sq{k} WHERE i = 45))),
value{k} AS (SELECT s.{key}, m, u, list_dot_product(u, list_transform(m, lambda r: list_dot_product(r, u))) AS value
  FROM {source if k == 1 else f"left{k - 1}"} s JOIN unit{k} x ON x.{key} = s.{key}),
left{k} AS (SELECT {key}, list_transform(m, lambda r, k: list_transform(r, lambda e, l: e - value * u[k] * u[l])) AS m
  FROM value{k})""")
    union = " UNION ALL ".join(f"SELECT {key}, {k}::INT AS component, u, value FROM value{k}" for k in range(1, count + 1))
    return ",\n" + ",\n".join(parts) + f",\neigen AS ({union})\n"


def _spatial(spark, sf_dir):
    return pca.spatial_pca(complete_cells(spark, sf_dir), "year", "station", "value", ["size_sex"])


@query("spatial_pca_first_share", """
SELECT l.size_sex, round(lambda1 / (n - 1), 6) AS eigenvalue, round(lambda1 / trace, 6) AS share FROM lead l
JOIN (SELECT size_sex, sum(CASE WHEN t1 = t2 THEN g END) AS trace, count(DISTINCT t1) AS n FROM gram GROUP BY 1) t
  ON t.size_sex = l.size_sex""", PCA_CTE)
def spatial_pca_first_share(spark, sf_dir):
    shares = _spatial(spark, sf_dir)["shares"]
    return rounded(shares.filter(F.col("component") == 1).drop("component"))


@query("spatial_pca_shares", """
SELECT e.size_sex, component, round(value / (n - 1), 5) AS eigenvalue, round(value / trace, 5) AS share FROM eigen e
JOIN (SELECT size_sex, sum(CASE WHEN t1 = t2 THEN g END) AS trace, count(DISTINCT t1) AS n FROM gram GROUP BY 1) t
  ON t.size_sex = e.size_sex""", PCA_CTE + eigen_ctes("mat", "size_sex", 5))
def spatial_pca_shares(spark, sf_dir):
    return rounded(_spatial(spark, sf_dir)["shares"], 5)


@query("spatial_pca_loadings", """
SELECT l.size_sex, station, round(loading * s, 6) AS loading FROM load0 l JOIN turn t ON t.size_sex = l.size_sex""", PCA_CTE)
def spatial_pca_loadings(spark, sf_dir):
    return rounded(_spatial(spark, sf_dir)["loadings"])


@query("spatial_pca_scores", """
SELECT c.size_sex, year, round(s * (score - m) / sd, 5) AS pc FROM score0 c JOIN turn t ON t.size_sex = c.size_sex""", PCA_CTE)
def spatial_pca_scores(spark, sf_dir):
    return rounded(_spatial(spark, sf_dir)["scores"], 5)


# Covariances over the years two districts share.
GAP_CTE = """cells AS (SELECT h.year, s.district, avg(h.gear_temp) AS value FROM sv_haul h
  JOIN sv_strata s ON s.year = h.year AND s.station = h.station GROUP BY 1, 2),
away AS (SELECT year, district, value - avg(value) OVER (PARTITION BY year) AS a FROM cells WHERE value IS NOT NULL),
names AS (SELECT DISTINCT district FROM away),
cov AS (SELECT x.district AS one, y.district AS two, coalesce((
    SELECT covar_samp(p.a, q.a) FROM away p JOIN away q ON p.year = q.year
    WHERE p.district = x.district AND q.district = y.district), 0) AS c FROM names x, names y),
mat AS (SELECT 1 AS one_key, list(r ORDER BY one) AS m FROM (SELECT one, list(c ORDER BY two) AS r FROM cov GROUP BY 1))
""" + eigen_ctes("mat", "one_key", 1) + """,
loads AS (SELECT unnest(ns) AS district, unnest(u) AS loading FROM eigen, (SELECT list_sort(list(district)) AS ns FROM names)),
score AS (SELECT year, sum(a * loading) AS score FROM away JOIN loads USING (district) GROUP BY 1)
"""


@query("gap_pca", """
SELECT year, round(sign * (score - m) / sd, 5) AS pc FROM score,
 (SELECT CASE WHEN regr_slope(score, year) < 0 THEN -1 ELSE 1 END AS sign, avg(score) AS m, stddev_samp(score) AS sd FROM score)""", GAP_CTE)
def gap_pca(spark, sf_dir):
    temps = views.haul(spark, sf_dir).join(
        views.strata(spark, sf_dir).select("year", "station", "district"), ["year", "station"])
    means = temps.groupBy("year", "district").agg(F.avg("gear_temp").alias("value"))
    return rounded(pca.gap_pca(means, "year", "district", "value")["scores"], 5)


# Correlations of the strata's yearly means.
STRATUM_CTE = CPUE_CTE + """,
cells AS (SELECT year, stratum_crab, avg(cpue) AS value FROM cpue_long WHERE stratum_crab < 20 GROUP BY 1, 2),
names AS (SELECT stratum_crab FROM cells GROUP BY 1 HAVING stddev_samp(value) > 0),
cor AS (SELECT x.stratum_crab AS one, y.stratum_crab AS two, corr(x.value, y.value) AS c FROM cells x
  JOIN cells y ON x.year = y.year WHERE x.stratum_crab IN (FROM names) AND y.stratum_crab IN (FROM names) GROUP BY 1, 2),
mat AS (SELECT 1 AS one_key, list(r ORDER BY one) AS m FROM (SELECT one, list(c ORDER BY two) AS r FROM cor GROUP BY 1))
""" + eigen_ctes("mat", "one_key", 3) + """,
loads AS (SELECT component, unnest(ns) AS stratum_crab, unnest(u) AS loading
  FROM eigen, (SELECT list_sort(list(stratum_crab)) AS ns FROM names)),
turned AS (SELECT component, CASE WHEN arg_max(loading, abs(loading)) < 0 THEN -1 ELSE 1 END AS sign FROM loads GROUP BY 1)
"""


@query("stratum_pca", """
SELECT component, stratum_crab, round(sign * loading, 5) AS loading FROM loads JOIN turned USING (component)""", STRATUM_CTE)
def stratum_pca(spark, sf_dir):
    means = cpue_frame(spark, sf_dir).filter(F.col("stratum_crab") < 20).groupBy(
        "year", "stratum_crab").agg(F.avg("cpue").alias("value"))
    return rounded(pca.standardized_pca(means, "year", "stratum_crab", "value")["loadings"], 5)


# -- delta models ----------------------------------------------------------------------------

def taxa_rows(spark, sf_dir):
    """Catch and covariates by station, year and class; price stands for depth.

    Depths meet the temperatures, before a station is a row for each class: broadcast where
    the counted stations are few, else joined by key, whatever size the planner takes them for.
    """
    days = views.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("station"), F.year("l_shipdate").alias("year")
    ).agg(F.min(F.dayofyear("l_shipdate")).alias("julian"))
    depth = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("station"), F.ln("p_retailprice").alias("logdepth"))
    few = depth.count() * ROW_BYTES <= BROADCAST_BYTES
    temps = views.haul(spark, sf_dir).select(
        "year", "station", F.col("gear_temp").alias("bottom_temp")
    ).join(F.broadcast(depth) if few else depth.hint("merge"), "station")
    return (
        cpue_frame(spark, sf_dir).select("year", "station", "lat", "lon",
                                         F.col("size_sex").alias("taxon"), F.col("num_crab").alias("abund"))
        .join(temps, ["year", "station"]).join(days, ["year", "station"])
        .filter(F.col("bottom_temp") > -10)
    )


def _total_rows(spark, sf_dir):
    rows = taxa_rows(spark, sf_dir)
    keys = [c for c in rows.columns if c not in ("taxon", "abund")]
    return rows.groupBy(*keys).agg(F.sum("abund").alias("abund"))


@query("fit_presence")
def fit_presence(spark, sf_dir):
    return models.fit_presence(_total_rows(spark, sf_dir)).coefficients(spark)


@query("fit_density")
def fit_density(spark, sf_dir):
    return models.fit_density(_total_rows(spark, sf_dir)).coefficients(spark)


@query("shared_years", """
SELECT DISTINCT year FROM sv_catch WHERE year IN (SELECT year FROM cpue_long WHERE cpue > 0)""", CPUE_CTE)
def shared_years(spark, sf_dir):
    positive = prep.positive_only(cpue_frame(spark, sf_dir), "cpue")
    return models.shared_years(views.catch(spark, sf_dir), positive)


@query("prediction_grid", """
SELECT year, round(lo + i * (hi - lo) / 99, 9) AS lat, round(lon, 9) AS lon, round(temp, 9) AS bottom_temp
FROM (SELECT DISTINCT year FROM total), range(0, 100) r(i),
     (SELECT quantile_cont(lat, 0.025) AS lo, quantile_cont(lat, 0.975) AS hi, avg(lon) AS lon, avg(nbt) AS temp FROM total)""", TOTAL_CTE)
def prediction_grid(spark, sf_dir):
    rows = station_total(spark, sf_dir).withColumn("bottom_temp", F.col("nbt")).withColumns(
        {"logdepth": F.lit(0.0), "julian": F.lit(0.0)})
    grid = models.prediction_grid(rows, rows.select("year").distinct())
    return rounded(grid.select("year", "lat", "lon", "bottom_temp"), 9)


@query("predict_delta")
def predict_delta(spark, sf_dir):
    rows = _total_rows(spark, sf_dir)
    grid = models.prediction_grid(rows, rows.select("year").distinct())
    return models.predict_delta(grid, models.fit_presence(rows), models.fit_density(rows))


@query("model_center_of_gravity")
def model_center_of_gravity(spark, sf_dir):
    taxa = ["male31to60", "male61to90", "male91to120", "mature_female", "immature_female"]
    # Ten fits and five grids read these rows: join once, keep the result.
    return models.model_center_of_gravity(cut_lineage(taxa_rows(spark, sf_dir)), taxa)
