"""Language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlframe.llm.common import table
from trawlframe.llm.registry import query
from trawlframe.llm.suffix_tree import score_documents


@query("op9_suffix_tree_scores")
def op9_suffix_tree_scores(spark, sf_dir):
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    return score_documents(table(spark, sf_dir, "documents"), training)
