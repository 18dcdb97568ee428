"""Personal data in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlframe.llm.common import table
from trawlframe.llm.pii import BASE_KINDS, find_pii, learn_spans
from trawlframe.llm.registry import query


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op4_weak_supervision_pii")
def op4_weak_supervision_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])

    def number(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_pii(docs, learn_spans(docs)).select(
        "doc_id", *map(number, BASE_KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"))
