"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.common import written


def _ranked(column: str) -> Column:
    return F.struct(F.xxhash64(column).alias("rank"), F.col(column).alias("id"))


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node it reaches, of every node in ``links`` (a, b: long).

    In each round every label moves to the first of its neighbours' labels, in the order
    of a hash, and the links are rewritten to the new labels; those within one label go,
    and when none is left, what shares a label is a component. A label moves unless it
    is the first around, so chains shrink by a share each round whatever their ids. All
    state stays in tables; a crowded node is a key of a join, which adaptive execution
    splits.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct())
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while not both.isEmpty():
        first = both.groupBy("a").agg(F.min(_ranked("b")).alias("m"))
        moves = written(first.select(
            F.col("a").alias("label"), F.least(_ranked("a"), F.col("m"))["id"].alias("to")))
        labels = written(labels.join(moves, "label", "left")
                         .select("node", F.coalesce("to", "label").alias("label")))
        sides = [moves.select(F.col("label").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"]
        both = written(both.join(sides[0], "a").join(sides[1], "b")
                       .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
                       .where("a != b").distinct())
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return labels.join(least, "label").select("node", F.col("least").alias("label"))
