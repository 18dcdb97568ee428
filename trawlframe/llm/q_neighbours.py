"""Nearest neighbours of every fiftieth embedding among all."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlframe.llm.common import table
from trawlframe.llm.permutation_index import nearest_neighbours
from trawlframe.llm.registry import query


@query("op8_permutation_index")
def op8_permutation_index(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))
