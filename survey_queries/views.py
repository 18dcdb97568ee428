"""The test tables in the shape of survey records.

Station = part key, year = ship year, one haul for each station and year, one
catch record for each line item. The same text runs on Spark and on DuckDB;
only the way the tables are named differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.session import attach_groups

CATCH = """
SELECT l_orderkey AS rec_id, l_linenumber AS rec_no,
       l_partkey AS station, CAST(year(l_shipdate) AS INT) AS year,
       CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS sex,
       CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_quantity * CAST(2.5 AS DOUBLE) END AS cw,
       CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 + l_linenumber % 4 END AS clutch,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL
            ELSE CAST(1 AS DOUBLE) + l_linenumber * CAST(0.5 AS DOUBLE) END AS sample_factor
FROM {lineitem}
"""

HAUL = """
SELECT station, year,
       CAST(54 AS DOUBLE) + (station % 80) * CAST(0.1 AS DOUBLE) + (year % 3) * CAST(0.01 AS DOUBLE) AS lat,
       CAST(-178 AS DOUBLE) + ((station - station % 80) % 16000) * CAST(0.00125 AS DOUBLE) AS lon,
       CASE WHEN (station + year) % 11 = 0 THEN NULL
            ELSE ((station * 31 + year * 17) % 97) * CAST(0.1 AS DOUBLE) - CAST(1.5 AS DOUBLE) END AS gear_temp,
       CASE WHEN (station * 7 + year) % 53 = 0 THEN NULL
            ELSE CAST(2.5 AS DOUBLE) + (station % 7) * CAST(0.1 AS DOUBLE) END AS distance_fished,
       CAST(15 AS DOUBLE) + (year % 5) * CAST(0.5 AS DOUBLE) AS net_width,
       CASE WHEN (station + year) % 23 = 0 THEN 4 ELSE 3 END AS haul_type,
       CASE WHEN (station + 2 * year) % 29 = 0 THEN -1 ELSE 0 END AS performance,
       CAST(1 + station % 6 AS INT) * 10 AS stratum_fish
FROM (SELECT DISTINCT station, year FROM {catch}) t
"""

# Strata: a district for each brand, for every survey year.
STRATA_DUCK = """
SELECT p.p_partkey AS station, y.year AS year,
       CASE WHEN b.bn <= 5 THEN 'NBS All' ELSE p.p_brand END AS district,
       CASE WHEN b.bn = 25 THEN 999 ELSE b.bn END AS stratum,
       b.n * CAST(401 AS DOUBLE) AS total_area
FROM part p
JOIN (SELECT p_brand, CAST(substr(p_brand, 7) AS INT) AS bn, count(*) AS n FROM part GROUP BY p_brand) b
  ON p.p_brand = b.p_brand
CROSS JOIN (SELECT DISTINCT year FROM sv_catch) y
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATCH.format(lineitem="{lines}"), lines=table(spark, sf_dir, "lineitem"))


def haul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HAUL.format(catch="{records}"), records=catch(spark, sf_dir))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each part with a brand and each year.

    The planner does not count the years, so by its estimate it would broadcast tables of
    many millions of rows; the hint has joins shuffle them.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand").filter(F.col("p_brand").isNotNull())
    brands = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "bn", F.substring("p_brand", 7, 10).cast("int")
    )
    years = catch(spark, sf_dir).agg(F.sort_array(F.collect_set("year"))).scalar()
    return attach_groups(part, brands, ["p_brand"]).select(
        F.col("p_partkey").alias("station"),
        F.explode(years).alias("year"),
        F.when(F.col("bn") <= 5, "NBS All").otherwise(F.col("p_brand")).alias("district"),
        F.when(F.col("bn") == 25, 999).otherwise(F.col("bn")).alias("stratum"),
        (F.col("n") * F.lit(401.0)).alias("total_area"),
    ).hint("merge")


VIEWS_SQL = (
    f"sv_catch AS ({CATCH.format(lineitem='lineitem')}),\n"
    f"sv_haul AS ({HAUL.format(catch='sv_catch')}),\n"
    f"sv_strata AS ({STRATA_DUCK})"
)
