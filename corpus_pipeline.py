"""From raw documents to packed sequences, in stages that each read what the last one wrote."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm.bin_slack import pack_documents
from trawlframe.llm.common import delete_folder, table, unused_name
from trawlframe.llm.ngram_join import one_of_each
from trawlframe.llm.pii import find_pii, learn_spans, mask_spans
from trawlframe.llm.q_quality import GOOD
from trawlframe.llm.quality import document_statistics, fit_discriminant, keep_good, settled_labels
from trawlframe.session import scratch_folder

# The stages learn from the data and split words into tokens, which SQL cannot express.
ORACLE_SQL = None


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant does not reject; learns from the labelled ones left."""
    labels = settled_labels(table(spark, sf_dir, "labels"), "quality")
    examples = document_statistics(docs).join(labels, "doc_id")
    return keep_good(docs, fit_discriminant(examples), GOOD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.75 or more."""
    return one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars, where there is one, follows the text."""
    spans = unused_name(docs, "spans")
    masked = find_pii(docs, learn_spans(docs), out=spans).withColumn("text", mask_spans(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.drop(spans)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good_documents),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each but the last is written to the shared folder.

    Columns that no stage knows stay as they are up to the last stage. Rows with null or
    repeated ids are documents like any others; an empty table gives no pieces. A stage's
    table is deleted once the next one is written; the last stays, as the result reads it.
    """
    folder = f"{scratch_folder(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
