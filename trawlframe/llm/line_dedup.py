"""Lines that many documents share are dropped from all of them but the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.common import lower_ascii
from trawlframe.session import BROADCAST_BYTES, cut_lineage

LEAST_CHARS, LEAST_DOCS = 20, 3
BLANKS = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
# Bytes of a broadcast row: a common line, a document with dropped places, one place.
COMMON_BYTES, DROPPED_BYTES, PLACE_BYTES = 64, 96, 4


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    stripped = F.btrim(line, F.lit(BLANKS))
    # In text of one byte a character the built-in lower case is the same and much quicker.
    return F.when(F.octet_length(stripped) == F.char_length(stripped), F.lower(stripped)).otherwise(
        lower_ascii(stripped))


def hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """_id, _hash, place and 128 bits of hash (h1, h2) of each line whose key is long enough."""
    return (docs.select("_id", "_hash", F.posexplode(F.split("_text", "\n", -1)).alias("place", "line"))
            # A key is no longer than its line, so most short lines need no key.
            .where(F.char_length("line") >= least_chars)
            .withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
            .select("_id", "_hash", "place", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit(1), "key").alias("h2")))


def common_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """h1, h2 and the last id of the lines found in at least ``least_docs`` different documents.

    Repeats within a document go first, by (line, id), so that a line of a third of
    all documents is spread over the tasks; then lines are counted map-side.
    """
    once = lines.select("h1", "h2", "_id").where(F.col("_id").isNotNull()).distinct()
    return (once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("_id").alias("last"))
            .where(F.col("n") >= least_docs).select("h1", "h2", "last"))


def drop_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document without the lines that ``least_docs`` or more documents share.

    A text is split at line feeds. Two lines are the same if they agree without blanks
    at both ends and with A-Z in lower case; lines of fewer than ``least_chars`` code points
    so far are never dropped. A common line stays in the document with the largest id
    that holds it, with all its repeats there, and goes from all others. What stays keeps
    its order and spelling and is joined by line feeds again.

    Lines are exploded and hashed (128 bits), different ids are counted per hash,
    the places of lines to drop go back to their document, and the text is put together from
    the places that are left. Texts are shuffled at most once, and only if the dropped
    places are too many to broadcast; common lines and places are counted before either
    is broadcast.

    Returns ``id_column``, ``text_column`` (what is left; empty if nothing is), n_lines and
    n_dropped, one row for each row of ``docs``. A null text is one empty line. Rows of one
    id are one document for the counts and are rewritten each on its own. Rows with a null id
    count as no document; they lose the common lines. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # Rows that agree in id and text have the same places, so these two say which row is meant.
    docs = docs.select(F.col(id_column).alias("_id"), text.alias("_text")).withColumn(
        "_hash", F.xxhash64("_text"))
    lines = hashed_lines(docs, least_chars)
    common = cut_lineage(common_lines(lines, least_docs))
    if common.count() * COMMON_BYTES <= BROADCAST_BYTES:
        common = F.broadcast(common)
    dropped = cut_lineage(
        lines.join(common, ["h1", "h2"]).where(~F.col("_id").eqNullSafe(F.col("last")))
        .groupBy("_id", "_hash").agg(F.collect_set("place").alias("places")))
    size = dropped.agg(F.sum(F.size("places") * PLACE_BYTES + DROPPED_BYTES)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        dropped = F.broadcast(dropped)
    dropped = dropped.select(F.col("_id").alias("_of"), F.col("_hash").alias("_of_hash"), "places")
    joined = docs.join(dropped, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_of_hash")),
                       "left")
    split = joined.withColumn("_lines", F.split("_text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "places")
    return split.select(
        F.col("_id").alias(id_column),
        F.when(F.col("places").isNull(), F.col("_text")).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")).alias(text_column),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
