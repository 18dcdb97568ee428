"""Quality scores of all documents, and the pipeline's stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.common import table
from trawlframe.llm.quality import (
    document_statistics, fit_discriminant, score_statistics, settled_labels,
)
from trawlframe.llm.registry import query
from trawlframe.session import cut_lineage

GOOD = 0.7


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from rows not held out.

    Statistics are written once and serve both learning and scoring. A null doc_id is
    not held out and has no label. Repeated rows are scored alike.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    statistics = cut_lineage(document_statistics(docs))
    examples = statistics.where(fold != 2).join(settled_labels(labels, "quality"), "doc_id")
    scored = score_statistics(statistics, fit_discriminant(examples))
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query("op5_quality_discriminant")
def op5_quality_discriminant(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
