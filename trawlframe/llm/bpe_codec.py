"""Encoding and decoding whole tables of texts with byte-level BPE."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.byte_bpe import encoder, tiktoken_ranks
from trawlframe.llm.common import slices


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id",
                 text_column: str = "text", load=tiktoken_ranks) -> DataFrame:
    """id and ``ids`` (array of int): the tokens of every whole text.

    ``path`` is a rank file that every executor can read, ``load`` reads it. A null
    text counts as empty and has no ids; ids repeat if rows do; other columns are
    ignored, so their names cannot clash. Narrow: no shuffle, and a worker holds one
    batch, about a million characters of arrays (or one text), and bounded words.
    """
    source = docs.select(F.col(id_column), F.coalesce(text_column, F.lit("")).alias("_text"))
    id_type = source.schema[0].dataType.simpleString()

    def work(batches):
        words = encoder(load, path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts]):
                flat, counts = words.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), ids], [id_column, "ids"])

    return source.mapInArrow(work, f"`{id_column}` {id_type}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_column: str = "doc_id",
               ids_column: str = "ids", load=tiktoken_ranks) -> DataFrame:
    """id, ids and ``decoded`` (binary): the bytes the ids stand for; null ids decode to nothing."""
    source = encoded.select(
        F.col(id_column), F.coalesce(ids_column, F.array().cast("array<int>")).alias(ids_column))
    id_type = source.schema[0].dataType.simpleString()

    def work(batches):
        words = encoder(load, path)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            for a, b in slices(np.diff(offsets).tolist()):
                out = [words.decode(flat[x:y].tolist())
                       for x, y in zip(offsets[a:b], offsets[a + 1:b + 1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), lists.slice(a, b - a),
                     pa.array(out, pa.binary())], [id_column, ids_column, "decoded"])

    return source.mapInArrow(
        work, f"`{id_column}` {id_type}, `{ids_column}` array<int>, decoded binary")
