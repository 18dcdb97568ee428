"""Sources, row filters, expressions, set operations and plain aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from survey_queries import views
from survey_queries.estimates import rounded
from survey_queries.registry import query
from trawlframe import functions as fx
from trawlframe.operators import joins, ordered, prep
from trawlframe.operators import panel as pn
from trawlframe.session import scratch_folder
from trawlframe.sources import drop_row_numbers, null_sentinels, read_table, rename_all, write_table

WIDE_CTE = """
station_wide AS (
  SELECT h.year, h.station, lat, lon, gear_temp AS nbt, f.total_female, f.male_total
  FROM sv_haul h LEFT JOIN (
    SELECT year, station, sum(CASE WHEN sex = 2 THEN sample_factor END) AS total_female,
           sum(CASE WHEN sex = 1 THEN sample_factor END) AS male_total
    FROM sv_catch GROUP BY 1, 2) f ON f.year = h.year AND f.station = h.station)
"""


def station_wide(spark, sf_dir):
    totals = views.catch(spark, sf_dir).groupBy("year", "station").agg(
        F.sum(F.when(F.col("sex") == 2, F.col("sample_factor"))).alias("total_female"),
        F.sum(F.when(F.col("sex") == 1, F.col("sample_factor"))).alias("male_total"),
    )
    hauls = views.haul(spark, sf_dir).select(
        "year", "station", "lat", "lon", F.col("gear_temp").alias("nbt"))
    return hauls.join(totals, ["year", "station"], "left")


@query("read_table", """
SELECT year, count(*) AS n_rows, count(cw) AS n_cw, sum(cw) AS cw_sum, count(sex) AS n_sex,
       sum(sample_factor) AS factor_sum FROM sv_catch GROUP BY 1""")
def read_table_query(spark, sf_dir):
    """The records written as CSV with NA, read with their stated schema."""
    path = f"{scratch_folder(spark)}/catch-{uuid.uuid4()}.csv"
    records = views.catch(spark, sf_dir)
    write_table(records, path, "csv")
    return read_table(spark, path, records.schema).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("cw").alias("n_cw"), F.sum("cw").alias("cw_sum"),
        F.count("sex").alias("n_sex"), F.sum("sample_factor").alias("factor_sum"),
    )


@query("rename_all", "SELECT station AS id, year AS survey_year, district AS area_name FROM sv_strata")
def rename_query(spark, sf_dir):
    frame = views.strata(spark, sf_dir).select("station", "year", "district")
    return rename_all(frame, ["id", "survey_year", "area_name"])


@query("drop_row_numbers", """
SELECT s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier""", views=False)
def row_numbers(spark, sf_dir):
    table = views.table(spark, sf_dir, "supplier").withColumnsRenamed(
        {"s_suppkey": "_c0", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"})
    return drop_row_numbers(table)


@query("choose_columns", """
SELECT year AS survey_year, station, lat AS mid_lat, lon AS mid_lon FROM sv_haul""")
def choose_columns(spark, sf_dir):
    kept = views.haul(spark, sf_dir).drop("gear_temp", "haul_type", "performance", "stratum_fish")
    return kept.withColumnsRenamed({"year": "survey_year", "lat": "mid_lat", "lon": "mid_lon"}).select(
        "survey_year", "station", "mid_lat", "mid_lon")


@query("sort_two_keys", """
SELECT station, year, gear_temp FROM sv_haul ORDER BY station, year DESC""")
def sort_two_keys(spark, sf_dir):
    return views.haul(spark, sf_dir).select("station", "year", "gear_temp").orderBy(
        "station", F.desc("year"))


@query("normal_ci", """
SELECT year, round(m, 9) AS estimate, round(m - 1.959963984540054::DOUBLE * s, 6) AS lower, round(m + 1.959963984540054::DOUBLE * s, 6) AS upper,
       round(m - 1.96 * s, 6) AS lower_196
FROM (SELECT year, avg(nbt) AS m, stddev_samp(nbt) / sqrt(count(*)) AS s FROM station_wide WHERE nbt IS NOT NULL GROUP BY 1)""", WIDE_CTE)
def normal_ci(spark, sf_dir):
    stats = station_wide(spark, sf_dir).filter(F.col("nbt").isNotNull()).groupBy("year").agg(
        F.avg("nbt").alias("estimate"), fx.std_error("nbt").alias("se"))
    low, high = fx.normal_ci("estimate", "se")
    low_196, _ = fx.normal_ci("estimate", "se", z=1.96)
    return rounded(stats.select("year", "estimate", low.alias("lower"), high.alias("upper"),
                                low_196.alias("lower_196")), 6, estimate=9)


@query("group_and_back", """
SELECT year, station, count(*) AS n, min(cw) AS smallest, max(cw) AS largest, sum(cw) AS total FROM sv_catch
WHERE cw IS NOT NULL GROUP BY 1, 2""")
def group_and_back(spark, sf_dir):
    return views.catch(spark, sf_dir).filter(F.col("cw").isNotNull()).groupBy("year", "station").agg(
        F.count(F.lit(1)).alias("n"), F.min("cw").alias("smallest"), F.max("cw").alias("largest"),
        F.sum("cw").alias("total"))


@query("null_sentinels", """
SELECT l_returnflag, count(*) AS n_rows, count(nullif(l_tax, 0)) AS n_tax, count(nullif(l_discount, 0)) AS n_discount,
       round(avg(nullif(l_tax, 0)), 6) AS mean_tax FROM lineitem GROUP BY 1""", views=False)
def sentinels(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    return null_sentinels(lines, {"l_tax": 0.0, "l_discount": 0.0}).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("l_tax").alias("n_tax"),
        F.count("l_discount").alias("n_discount"), F.round(F.avg("l_tax"), 6).alias("mean_tax"),
    )


@query("qc_hauls", """
SELECT year, station, gear_temp FROM sv_haul
WHERE haul_type = 3 AND performance >= 0 AND year >= 1997""")
def qc_hauls(spark, sf_dir):
    return prep.qc_hauls(views.haul(spark, sf_dir), min_year=1997).select("year", "station", "gear_temp")


@query("year_filters", """
SELECT 'range' AS rule, year, count(*) AS n FROM sv_haul WHERE year >= 1997 AND year <= 1999 GROUP BY 2
UNION ALL SELECT 'list' AS rule, year, count(*) AS n FROM sv_haul WHERE year IN (1995, 2000) GROUP BY 2""")
def year_filters(spark, sf_dir):
    hauls = views.haul(spark, sf_dir)
    parts = [("range", prep.years_from(hauls, 1997, 1999)), ("list", prep.years_in(hauls, [1995, 2000]))]
    return prep.stack_tables(*[
        df.groupBy("year").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(rule))
        for rule, df in parts
    ])


@query("range_filter_drops_null", """
SELECT year, station, gear_temp FROM sv_haul WHERE gear_temp > -1.0""")
def range_filter(spark, sf_dir):
    return prep.above(views.haul(spark, sf_dir), "gear_temp", -1.0).select("year", "station", "gear_temp")


@query("total_cpue", """
SELECT year, station, total_female + male_total AS total_cpue FROM station_wide""", WIDE_CTE)
def total_cpue(spark, sf_dir):
    return station_wide(spark, sf_dir).select(
        "year", "station", (F.col("total_female") + F.col("male_total")).alias("total_cpue"))


@query("positive_only", """
SELECT year, station, male_total FROM station_wide WHERE male_total > 0""", WIDE_CTE)
def positive_only(spark, sf_dir):
    return prep.positive_only(station_wide(spark, sf_dir), "male_total").select(
        "year", "station", "male_total")


@query("station_key", """
SELECT s_suppkey, replace(replace(s_name, '-', ''), '#', '') AS station FROM supplier""", views=False)
def station_key(spark, sf_dir):
    return views.table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.translate(fx.station_key("s_name"), "#", "").alias("station"))


@query("region_from_cruise", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%NBS%' THEN 'NBS' WHEN o_custkey % 2 = 0 THEN 'NBS' ELSE 'EBS' END AS region
FROM orders""", views=False)
def region_from_cruise(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", fx.region_from_cruise("o_custkey", "o_orderpriority").alias("region"))


@query("size_sex_class", """
SELECT rec_id, rec_no, CASE WHEN sex = 1 AND cw > 31 AND cw <= 60 THEN 'male31to60'
     WHEN sex = 1 AND cw > 61 AND cw <= 90 THEN 'male61to90'
     WHEN sex = 1 AND cw > 91 AND cw <= 120 THEN 'male91to120'
     WHEN sex = 2 AND clutch > 0 THEN 'mature_female'
     WHEN sex = 2 AND clutch = 0 THEN 'immature_female' END AS size_sex FROM sv_catch""")
def size_sex(spark, sf_dir):
    return views.catch(spark, sf_dir).select("rec_id", "rec_no", fx.size_sex_class().alias("size_sex"))


@query("width_bin_1mm", """
SELECT rec_id, rec_no, round_even(cw, 0) AS cw_bin FROM sv_catch""")
def width_bin(spark, sf_dir):
    return views.catch(spark, sf_dir).select("rec_id", "rec_no", fx.width_bin_1mm().alias("cw_bin"))


@query("class_labels", """
SELECT rec_id, rec_no, label, CASE WHEN split_part(label, '_', 1) = '1' THEN 'Male' WHEN label IS NOT NULL THEN 'Female' END AS sex_name,
       TRY_CAST(split_part(label, '_', 2) AS DOUBLE) AS width
FROM (SELECT rec_id, rec_no, CASE WHEN sex IS NOT NULL OR cw IS NOT NULL THEN
        coalesce(CAST(sex AS VARCHAR), 'NA') || '_' || coalesce(CAST(CAST(round_even(cw, 0) AS INT) AS VARCHAR), 'NA') END AS label
      FROM sv_catch)""")
def class_labels(spark, sf_dir):
    labels = views.catch(spark, sf_dir).select(
        "rec_id", "rec_no", fx.class_label("sex", fx.width_bin_1mm()).alias("label"))
    sex, width = fx.split_class_label("label")
    return labels.select("*", F.when(F.col("label").isNotNull(), sex).alias("sex_name"),
                         width.alias("width"))


@query("area_swept_cpue", """
SELECT year, station, round(a, 9) AS area_swept, round(male_total / a, 4) AS cpue
FROM (SELECT h.year, h.station, w.male_total,
        h.distance_fished * (h.net_width / 1000.0) * (CAST(0.539957 AS DOUBLE) * CAST(0.539957 AS DOUBLE)) AS a
      FROM sv_haul h JOIN station_wide w ON h.year = w.year AND h.station = w.station)""", WIDE_CTE)
def area_swept_cpue(spark, sf_dir):
    both = views.haul(spark, sf_dir).join(
        station_wide(spark, sf_dir).select("year", "station", "male_total"), ["year", "station"])
    return both.withColumn("area_swept", fx.area_swept()).select(
        "year", "station", F.round("area_swept", 9).alias("area_swept"),
        F.round(fx.cpue("male_total"), 4).alias("cpue"))


@query("recode_stratum", """
SELECT station, year, CAST(CASE WHEN stratum = 999 THEN 10 ELSE stratum END AS INT) AS stratum FROM sv_strata""")
def recode(spark, sf_dir):
    return views.strata(spark, sf_dir).select(
        "station", "year", fx.recode("stratum", 999, 10).cast("int").alias("stratum"))


@query("transforms", """
SELECT year, station, round(pow(male_total, 0.25), 6) AS fourth_root,
       round(CASE WHEN male_total > 0 THEN ln(male_total) END, 6) AS log_value,
       round(ln(male_total + 1), 6) AS log_plus, round(log10(male_total + 10), 6) AS log10_plus,
       round(nbt * nbt, 6) AS squared, CAST(ceil(male_total / 1e10) AS INT) AS present,
       nullif(male_total, 0) AS zero_gone, coalesce(male_total, 0) AS null_gone,
       lon + 360 AS east, CASE WHEN nbt > 0 THEN nbt WHEN nbt IS NOT NULL THEN 0 END AS floored
FROM station_wide""", WIDE_CTE)
def transforms(spark, sf_dir):
    return station_wide(spark, sf_dir).select(
        "year", "station",
        F.round(fx.fourth_root("male_total"), 6).alias("fourth_root"),
        F.round(fx.log_positive("male_total"), 6).alias("log_value"),
        F.round(fx.log_plus_one("male_total"), 6).alias("log_plus"),
        F.round(fx.log10_plus("male_total"), 6).alias("log10_plus"),
        F.round(fx.squared("nbt"), 6).alias("squared"),
        fx.presence("male_total").alias("present"),
        fx.zero_to_null("male_total").alias("zero_gone"),
        fx.null_to_zero("male_total").alias("null_gone"),
        fx.degrees_east("lon").alias("east"),
        fx.floor_at_zero("nbt").alias("floored"),
    )


@query("sex_from_group", """
SELECT key, CASE WHEN key LIKE '%FEM%' THEN 'Female' ELSE 'Male' END AS sex, count(value) AS n
FROM (SELECT 'TOTAL_FEMALE' AS key, total_female AS value FROM station_wide
      UNION ALL SELECT 'MALE_TOTAL', male_total FROM station_wide) GROUP BY 1, 2""", WIDE_CTE)
def sex_from_group(spark, sf_dir):
    wide = station_wide(spark, sf_dir).withColumnsRenamed(
        {"total_female": "TOTAL_FEMALE", "male_total": "MALE_TOTAL"})
    return prep.to_long(wide, ["year", "station"], ["TOTAL_FEMALE", "MALE_TOTAL"]).groupBy(
        "key", fx.sex_from_group("key").alias("sex")).agg(F.count("value").alias("n"))


@query("project_nm", """
SELECT year, station,
  round((lon - lon0) * 60 * cos(radians(lat0)), 6) AS x_mean, round((lat - lat0) * 60, 6) AS y_mean,
  round((lon - lon0) * 60 * cos(radians(lat)), 6) AS x_cosine, round((lon - lon0) * 60 * 0.3, 6) AS x_fixed
FROM sv_haul, (SELECT min(lon) AS lon0, min(lat) AS lat0 FROM sv_haul)""")
def project(spark, sf_dir):
    hauls = views.haul(spark, sf_dir)
    lon0, lat0 = hauls.agg(F.min("lon"), F.min("lat")).first()
    (xm, ym), (xc, _), (xf, _) = [
        fx.project_nm("lon", "lat", mode, lon0, lat0) for mode in ("mean", "cosine", 0.3)]
    return hauls.select("year", "station", *[
        F.round(c, 6).alias(n) for c, n in
        ((xm, "x_mean"), (ym, "y_mean"), (xc, "x_cosine"), (xf, "x_fixed"))])


@query("unproject_nm", """
SELECT year, station, round(lon, 6) AS lon, round(lat, 6) AS lat FROM sv_haul""")
def unproject(spark, sf_dir):
    hauls = views.haul(spark, sf_dir)
    lon0, lat0 = hauls.agg(F.min("lon"), F.min("lat")).first()
    x, y = fx.project_nm("lon", "lat", "cosine", lon0, lat0)
    lon, lat = fx.unproject_nm("x", "y", "cosine", lon0, lat0)
    return hauls.select("year", "station", x.alias("x"), y.alias("y")).select(
        "year", "station", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


# -- joins and sets -------------------------------------------------------------

EXCLUDED = "SELECT p_partkey FROM part WHERE p_size >= 45"


def excluded_stations(spark, sf_dir):
    return views.table(spark, sf_dir, "part").filter(F.col("p_size") >= 45).select(
        F.col("p_partkey").alias("station"))


@query("semi_join_kept", f"""
SELECT year, station, gear_temp FROM sv_haul WHERE station IN ({EXCLUDED})""")
def semi_join(spark, sf_dir):
    return joins.keep_members(views.haul(spark, sf_dir), excluded_stations(spark, sf_dir),
                              ["station"]).select("year", "station", "gear_temp")


@query("anti_join_excluded", f"""
SELECT year, station, gear_temp FROM sv_haul WHERE station NOT IN ({EXCLUDED})""")
def anti_join(spark, sf_dir):
    return joins.drop_members(views.haul(spark, sf_dir), excluded_stations(spark, sf_dir),
                              ["station"]).select("year", "station", "gear_temp")


@query("full_join_indices", """
SELECT coalesce(a.year, b.year) AS year, a.mean_bt, b.cpa
FROM (SELECT year, round(avg(gear_temp), 9) AS mean_bt FROM sv_haul GROUP BY 1) a
FULL JOIN (SELECT year, count(*) * 401 AS cpa FROM sv_haul WHERE gear_temp < 2 GROUP BY 1) b
ON a.year = b.year""")
def full_join_indices(spark, sf_dir):
    hauls = views.haul(spark, sf_dir)
    means = hauls.groupBy("year").agg(F.round(F.avg("gear_temp"), 9).alias("mean_bt"))
    cold = hauls.filter(F.col("gear_temp") < 2).groupBy("year").agg(
        (F.count(F.lit(1)) * 401).alias("cpa"))
    return joins.full_by_key([means, cold], ["year"])


@query("align_by_key", """
SELECT w.year, w.station, w.nbt, CAST(h.gear_temp IS NOT NULL AS INT) AS has_match
FROM station_wide w LEFT JOIN (SELECT year, station, gear_temp FROM sv_haul WHERE gear_temp IS NOT NULL) h
ON w.year = h.year AND w.station = h.station""", WIDE_CTE)
def align(spark, sf_dir):
    known = views.haul(spark, sf_dir).filter(F.col("gear_temp").isNotNull()).select("year", "station")
    return joins.align_by_key(
        station_wide(spark, sf_dir).select("year", "station", "nbt"), known, ["year", "station"]
    ).withColumn("has_match", F.col("has_match").cast("int"))


@query("union_by_name", """
SELECT station, year, district, CAST(NULL AS VARCHAR) AS note FROM sv_strata WHERE district = 'NBS All'
UNION ALL SELECT station, year, district, 'south' FROM sv_strata WHERE district <> 'NBS All'""")
def union_by_name(spark, sf_dir):
    strata = views.strata(spark, sf_dir).select("station", "year", "district")
    return prep.stack_tables(
        strata.filter(F.col("district") == "NBS All"),
        strata.filter(F.col("district") != "NBS All").withColumn("note", F.lit("south")))


@query("same_members", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT station FROM sv_haul EXCEPT SELECT p_partkey FROM part)) AS only_left,
       (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT station FROM sv_haul)) AS only_right,
       CAST((SELECT count(*) FROM (SELECT station FROM sv_haul EXCEPT SELECT p_partkey FROM part)) +
            (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT station FROM sv_haul)) = 0 AS INT) AS identical""")
def same_members(spark, sf_dir):
    return prep.same_members(
        views.haul(spark, sf_dir).select("station"),
        views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("station")),
    ).withColumn("identical", F.col("identical").cast("int"))


@query("distinct_values", "SELECT DISTINCT year, haul_type, performance FROM sv_haul")
def distinct_values(spark, sf_dir):
    return views.haul(spark, sf_dir).select("year", "haul_type", "performance").distinct()


PANEL_YEARS = list(range(1995, 2002))


@query("wide_panel", f"""
SELECT station, {", ".join(f"max(CASE WHEN year = {y} THEN nbt END) AS y{y}" for y in PANEL_YEARS)}
FROM station_wide GROUP BY 1""", WIDE_CTE)
def wide_panel(spark, sf_dir):
    wide = prep.to_wide(station_wide(spark, sf_dir), ["station"], "year", "nbt", PANEL_YEARS)
    return wide.withColumnsRenamed({str(y): f"y{y}" for y in PANEL_YEARS})


@query("wide_to_long", """
SELECT year, station, 'total_female' AS key, total_female AS value FROM station_wide
UNION ALL SELECT year, station, 'male_total', male_total FROM station_wide""", WIDE_CTE)
def wide_to_long(spark, sf_dir):
    return prep.to_long(station_wide(spark, sf_dir), ["year", "station"], ["total_female", "male_total"])


@query("collapse_duplicates", """
SELECT l_partkey, l_suppkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
       round(CASE WHEN count(d) = count(*) THEN avg(d) END, 6) AS d
FROM (SELECT *, nullif(l_discount, 0) AS d FROM lineitem) GROUP BY 1, 2""", views=False)
def collapse_duplicates(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", fx.zero_to_null("l_discount").alias("d"))
    return rounded(prep.collapse_duplicates(lines, ["l_partkey", "l_suppkey"]))


# -- aggregates ------------------------------------------------------------------

@query("counts_by_period", """
SELECT year, station, count(nbt) AS n_present, count(*) - count(nbt) AS n_missing FROM station_wide GROUP BY 1, 2""", WIDE_CTE)
def counts_by_period(spark, sf_dir):
    return pn.counts_by_period(station_wide(spark, sf_dir), "station", "year", "nbt")


@query("counts_by_series", """
SELECT station, count(nbt) AS n_present, count(*) - count(nbt) AS n_missing, count(DISTINCT year) AS n_periods
FROM station_wide GROUP BY 1""", WIDE_CTE)
def counts_by_series(spark, sf_dir):
    return pn.counts_by_series(station_wide(spark, sf_dir), "station", "year", "nbt")


@query("frequency_of_missing", """
SELECT n_missing, count(*) AS n_series FROM (SELECT station, count(*) - count(nbt) AS n_missing FROM station_wide GROUP BY 1) GROUP BY 1""", WIDE_CTE)
def frequency_of_missing(spark, sf_dir):
    return pn.frequency_of_missing(station_wide(spark, sf_dir), "station", "year", "nbt")


@query("group_means", """
SELECT year, station % 10 AS line, round(avg(nbt), 9) AS mean_skip,
       round(CASE WHEN count(nbt) = count(*) THEN avg(nbt) END, 9) AS mean_strict, count(*) AS n,
       round(CASE WHEN count(lat) = count(*) THEN stddev_samp(lat) / sqrt(count(*)) END, 6) AS se_lat,
       round(var_samp(nbt), 6) AS var_skip, round(min(nbt), 6) AS lowest, round(max(nbt), 6) AS highest
FROM station_wide GROUP BY 1, 2""", WIDE_CTE)
def group_means(spark, sf_dir):
    return rounded(station_wide(spark, sf_dir).groupBy("year", (F.col("station") % 10).alias("line")).agg(
        F.avg("nbt").alias("mean_skip"), fx.strict_avg("nbt").alias("mean_strict"),
        F.count(F.lit(1)).alias("n"), fx.std_error("lat").alias("se_lat"),
        F.var_samp("nbt").alias("var_skip"), F.min("nbt").alias("lowest"), F.max("nbt").alias("highest")), 6, mean_skip=9, mean_strict=9)


@query("weighted_mean", """
SELECT year, round(sum(CASE WHEN male_total IS NOT NULL THEN nbt * male_total END)
                   / sum(CASE WHEN nbt IS NOT NULL THEN male_total END), 6) AS skipped,
       round(CASE WHEN count(CASE WHEN nbt IS NOT NULL AND male_total IS NULL THEN 1 END) = 0
             THEN sum(nbt * male_total) / sum(CASE WHEN nbt IS NOT NULL THEN male_total END) END, 6) AS propagated
FROM station_wide GROUP BY 1""", WIDE_CTE)
def weighted_mean(spark, sf_dir):
    return rounded(station_wide(spark, sf_dir).groupBy("year").agg(
        fx.weighted_mean("nbt", "male_total").alias("skipped"),
        fx.weighted_mean("nbt", "male_total", "propagate").alias("propagated")))


@query("quantiles", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS q_2_5,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS q_50, round(quantile_cont(l_extendedprice, 0.975), 6) AS q_97_5
FROM lineitem GROUP BY 1""", views=False)
def quantiles(spark, sf_dir):
    return rounded(ordered.quantiles(views.table(spark, sf_dir, "lineitem"), "l_extendedprice",
                                     [0.025, 0.5, 0.975], ["l_returnflag"]))


@query("weighted_quantile", """
SELECT year, round(max(CASE WHEN p = 0.5 THEN q END), 4) AS q_50, round(max(CASE WHEN p = 0.9 THEN q END), 4) AS q_90
FROM (SELECT year, p, CASE WHEN max(x0) IS NULL THEN max(x1) WHEN max(x1) IS NULL THEN max(x0)
             ELSE max(x0) + (p - max(c0)) / (max(c1) - max(c0)) * (max(x1) - max(x0)) END AS q
      FROM (SELECT year, p, max(CASE WHEN c <= p THEN c END) AS c0, max(CASE WHEN c <= p THEN cw END) AS x0,
                   min(CASE WHEN c > p THEN c END) AS c1, min(CASE WHEN c > p THEN cw END) AS x1
            FROM (SELECT year, cw, sum(sum(sample_factor)) OVER (PARTITION BY year ORDER BY cw)
                         / sum(sum(sample_factor)) OVER (PARTITION BY year) AS c
                  FROM sv_catch WHERE cw IS NOT NULL AND sample_factor IS NOT NULL GROUP BY 1, 2)
            CROSS JOIN (SELECT unnest([0.5, 0.9]::DOUBLE[]) AS p) GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1""")
def weighted_quantile(spark, sf_dir):
    return rounded(ordered.weighted_quantiles(
        views.catch(spark, sf_dir), "cw", "sample_factor", [0.5, 0.9], ["year"]), 4)


@query("weighted_median", """
SELECT sex, round(CASE WHEN max(x0) IS NULL THEN max(x1) WHEN max(x1) IS NULL THEN max(x0)
             ELSE max(x0) + (0.5 - max(c0)) / (max(c1) - max(c0)) * (max(x1) - max(x0)) END, 4) AS q_50
FROM (SELECT sex, max(CASE WHEN c <= 0.5 THEN c END) AS c0, max(CASE WHEN c <= 0.5 THEN cw END) AS x0,
             min(CASE WHEN c > 0.5 THEN c END) AS c1, min(CASE WHEN c > 0.5 THEN cw END) AS x1
      FROM (SELECT sex, cw, sum(sum(sample_factor)) OVER (PARTITION BY sex ORDER BY cw)
                   / sum(sum(sample_factor)) OVER (PARTITION BY sex) AS c
            FROM sv_catch WHERE cw IS NOT NULL AND sample_factor IS NOT NULL GROUP BY 1, 2) GROUP BY 1) GROUP BY 1""")
def weighted_median(spark, sf_dir):
    return rounded(ordered.weighted_median(
        views.catch(spark, sf_dir), "cw", "sample_factor", ["sex"]), 4)


@query("contingency", """
SELECT stratum_fish, year, count(*) AS n FROM sv_haul GROUP BY 1, 2""")
def contingency(spark, sf_dir):
    return views.haul(spark, sf_dir).groupBy("stratum_fish", "year").agg(F.count(F.lit(1)).alias("n"))


@query("top_k", """
SELECT district, n, CAST(row_number() OVER (ORDER BY n DESC, district) AS INT) AS place
FROM (SELECT district, count(*) AS n FROM sv_strata GROUP BY 1) QUALIFY place <= 10""")
def top_k(spark, sf_dir):
    counts = views.strata(spark, sf_dir).groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    return ordered.top_k(counts, [F.desc("n"), F.col("district")], 10)
