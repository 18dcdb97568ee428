"""What lies on disk while an operator runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlframe.llm import suffix_tree
from trawlframe.llm.common import written


def shuffle_files(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle_")}


def test_a_table_once_written_needs_no_shuffles(spark):
    before = shuffle_files(spark)
    table = written(spark.range(20_000).groupBy((F.col("id") % 700).alias("k")).count().repartition(3, "count"))
    assert table.count() == 700
    left = {name.split("_")[1] for name in shuffle_files(spark) - before}
    assert len(left) <= 1  # that of the count above


@pytest.fixture
def texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{w}" for w in rng.zipf(1.4, 60) if w < 500)) for i in range(120)]
    return spark.createDataFrame([*rows, (None, rows[0][1]), (7, None)], "doc_id long, text string")


def scores(texts):
    rows = suffix_tree.score_documents(texts, F.coalesce(F.col("doc_id") % 5 > 0, F.lit(True))).collect()
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)


def test_texts_scored_in_parts_leave_fewer_shuffles_and_the_same_scores(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_tree, "COMMON_WORDS", 64)
    before = shuffle_files(spark)
    want = scores(texts)
    left = {name.split("_")[1] for name in shuffle_files(spark) - before}
    assert len(want) == 122 and len(left) <= 2  # sums of few rows that were only collected
    monkeypatch.setattr(suffix_tree, "TEXT_SLICES", 1)
    assert scores(texts) == want


def test_words_outside_the_table_of_common_words_keep_their_hashes():
    words = suffix_tree.Words(np.array([3, 9, 2**63 + 1], np.uint64), np.array([5, 4, 4]), np.zeros(3, int), 13, 3)
    hashes = np.array([9, 0, 7, 2**63 + 1, 2**64 - 1, 3], np.uint64)
    codes, others = suffix_tree._coded(words, hashes, [0, 3], [3, 6])
    back = suffix_tree._decoded(words, np.frombuffer(b"".join(codes), np.uint32), np.frombuffer(b"".join(others), np.uint64))
    assert back.tolist() == hashes.tolist() and len(b"".join(others)) == 24
