"""URL rules as a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlframe.llm.common import lower_ascii, shuffle_partitions
from trawlframe.session import cut_lineage


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; '' without ``://`` or for null."""
    rest = F.get(F.split(url, "://", 2), 1)
    return F.coalesce(lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; '' without ``://`` or for null."""
    rest = F.get(F.split(url, "://", 2), 1)
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_labels(host: Column) -> Column:
    """``a.b.org`` as the array org, b, a."""
    return F.reverse(F.split(host, r"\."))


def _host_key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def rule_intervals(rules: DataFrame) -> DataFrame:
    """The rules (host, path, verdict) as nested intervals of canonical keys.

    A key is the reversed host with a closing dot, then the path: ``org.example./es/``.
    What starts with the key is one interval of the sorted keys, and two such
    intervals are nested or disjoint. ``stack`` lists the rules that are open where
    the rule begins, itself included. Equal rules become one, where block wins.
    Rules without a host, or whose path could never begin a path, fit nothing.
    """
    known = (
        rules.select(lower_ascii(F.col("host")).alias("host"),
                     F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where((F.col("host") != "") & ((F.col("path") == "") | F.col("path").startswith("/")))
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("key", F.concat(_host_key(reversed_labels(F.col("host"))), "path"))
    )
    opened = known.select(
        F.col("key").alias("inner_key"),
        F.explode(F.transform(F.sequence(F.lit(1), F.length("key")),
                              lambda n: F.col("key").substr(F.lit(1), n))).alias("key"))
    entry = F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"), "verdict", "key")
    return (opened.join(known, "key").groupBy("inner_key")
            .agg(F.array_sort(F.collect_list(entry)).alias("stack"))
            .withColumnRenamed("inner_key", "key"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id",
               url_column: str = "url", default: str = "allow") -> DataFrame:
    """The longest rule that fits each url's host, or a parent of it, and its path.

    ``rules`` has host, path, verdict. Every url is probed once for each of the
    last labels of its host, as many as the longest rule has. Probes and rules are
    sorted together by key into range slices; within a slice the last rule that
    began before a probe brings the stack of rules open there, and those whose
    interval has ended are taken off. A slice begins with the stack that the slices
    before it left open: one row for each slice. Distinct (host, path) are swept,
    so repeated urls cost one probe, and the range also orders by path, so a host
    with a third of all urls spreads over slices.

    Returns id, url, host, path, rule, verdict for every row. Null urls, or urls
    without ``://``, have empty host and path. Without a fitting rule, rule is null
    and verdict ``default``. Ties in length go to the longer host, then to the
    greater rule text. Repeated rows and null ids are kept as they are; other
    columns are ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    parts = pages.select(
        F.col(id_column), F.col(url_column),
        url_host(F.col(url_column)).alias("host"), url_path(F.col(url_column)).alias("path"))
    intervals = cut_lineage(rule_intervals(rules))
    depth = intervals.select(
        F.coalesce(F.max(F.size(F.split(F.regexp_extract("key", "^[^/]*", 0), r"\.")) - 1),
                   F.lit(0))).first()[0]
    if depth == 0:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    labels = F.slice("labels", 1, F.lit(depth))
    probes = (
        parts.select("host", "path").where("host != ''").distinct()
        .withColumn("labels", reversed_labels(F.col("host"))).withColumn("labels", labels)
        .select("host", "path", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("labels")),
            lambda n: _host_key(F.slice("labels", F.lit(1), n)))).alias("host_key"))
        .select(F.concat("host_key", "path").alias("key"), F.lit(1).alias("kind"), "host", "path"))
    starts = intervals.select("key", F.lit(0).alias("kind"), "stack")
    events = cut_lineage(
        starts.unionByName(probes, allowMissingColumns=True)
        .repartitionByRange(shuffle_partitions(spark), "key", "kind", "host", "path")
        .withColumn("slice", F.spark_partition_id()))

    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        events.groupBy("slice")
        .agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("left_open"))
        .select("slice", F.last("left_open", ignorenulls=True).over(earlier).alias("carried")))
    sweep = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    swept = (
        events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("kind = 1").join(carried, "slice", "left")
        .withColumn("open", F.coalesce("open", "carried"))
        .withColumn("fits", F.filter("open", lambda r: F.col("key").startswith(r["key"])))
        .where(F.size("fits") > 0))
    best = (swept.groupBy("host", "path").agg(F.max(F.array_max("fits")).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"),
                    F.col("best.verdict").alias("verdict")))
    return (parts.join(best, ["host", "path"], "left")
            .select(id_column, url_column, "host", "path", "rule",
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))
