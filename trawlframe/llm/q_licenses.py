"""The license scan over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlframe.llm.common import table
from trawlframe.llm.license_scan import scan_licenses
from trawlframe.llm.registry import query


def _labels(*arrays):
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[
        F.transform(a, lambda d: d["label"]) for a in arrays]))), ",")


@query("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    base, found = F.col("base"), F.col("detections")
    firsts = F.transform(base, lambda d: d["first"].cast("long"))
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(base, found).alias("labels"),
        F.coalesce(F.array_max(F.transform(found, lambda d: d["confidence"])), F.lit(0.0)).alias("score"))
