"""Packing and byte-level BPE over all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from trawlframe.llm.bin_slack import pack_documents
from trawlframe.llm.bpe_codec import decode_ids, encode_texts
from trawlframe.llm.common import table
from trawlframe.llm.registry import query


@query("op6_bin_slack_packing")
def op6_bin_slack_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), ranks), ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
