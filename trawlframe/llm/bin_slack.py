"""Packing pieces of documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlframe.llm.byte_bpe import encoder, json_ranks
from trawlframe.llm.common import slices
from trawlframe.session import cut_lineage

RANK_BITS = 44


def cut_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2,
               id_column: str = "doc_id", text_column: str = "text", load=json_ranks) -> DataFrame:
    """The pieces of every document: its ids, then ``end_id``, cut from the end.

    Only documents longer than ``capacity`` are cut: whole pieces of that length,
    before them a first one of what remains. ``part`` and ``place`` number the pieces
    of one length within a task, so that they can be ranked without a sort.
    A null text counts as empty: its only id is ``end_id``.
    """
    source = docs.select(F.col(id_column), F.coalesce(text_column, F.lit("")).alias("_text"))
    id_type = source.schema[0].dataType.simpleString()
    names = [id_column, "piece", "start", "length", "ids_crc32", "part", "place"]

    def work(batches):
        words = encoder(load, path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts]):
                flat, counts = words.encode(texts[a:b])
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id).astype("<u4")
                counts = counts + 1
                ends = np.cumsum(counts)
                n_pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(b - a), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                first = counts - (n_pieces - 1) * capacity
                start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[doc])
                at = (ends - counts)[doc] + start
                check = [zlib.crc32(flat[x:y]) for x, y in zip(at.tolist(), (at + length).tolist())]
                # Running number of each length: its place among equals here, after those before.
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(a + doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array(np.array(check, np.int64)),
                     pa.array(np.full(len(doc), part, np.int32)), pa.array(place)], names)

    return source.mapInArrow(work, f"`{id_column}` {id_type}, piece int, start long, length long, "
                                   "ids_crc32 long, part int, place long")


def fullest_combination(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths, and how often each, of the fullest bin that holds the longest length left.

    Subset sums are the bits of one integer; each length is added in powers of two
    of its copies, longest first, until the bin can be filled exactly. Reading the
    steps backwards gives the combination.
    """
    longest = int(np.flatnonzero(counts)[-1])
    room = capacity - longest
    chosen = {longest: 1}
    bits, full, steps = 1, 1 << room, []
    lengths = np.flatnonzero(counts[:room + 1])[::-1].tolist()
    for length in lengths:
        left = min(int(counts[length]) - (length == longest), room // length)
        copies = 1
        while left > 0 and not bits & full:
            take = min(copies, left)
            grown = (bits | bits << (take * length)) & (2 * full - 1)
            if grown != bits:
                steps.append((bits, length, take))
                bits = grown
            left -= take
            copies *= 2
        if bits & full:
            break
    total = bits.bit_length() - 1
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, combination) until no length is left.

    A combination found is used as often as its lengths last, so the work depends on
    the distinct lengths, at most ``capacity``, and not on the number of pieces.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    while counts.any():
        chosen = fullest_combination(counts, capacity)
        bins = min(int(counts[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= bins * n
        plan.append((bins, chosen))
    return plan


def allocations(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their rank: sorted (length, first rank) keys."""
    rows, used, sequence = [], {}, 0
    for bins, chosen in plan:
        offset = 0
        for length, n in chosen.items():
            first = used.get(length, 0)
            rows.append((length << RANK_BITS | first, first, n, sequence, offset))
            used[length] = first + bins * n
            offset += n * length
        sequence += bins
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("key", "first", "copies", "sequence", "offset"), columns))


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with length, part and place (see ``cut_pieces``).

    The driver sees the histogram of lengths alone, at most ``capacity`` rows. A
    piece's rank among its length is its place in its task plus the pieces of that
    length in earlier tasks: one row for each length and task is shuffled for that,
    so a length that a third of all pieces share needs no group. Rank and length
    give sequence and offset by arithmetic on the plan.

    An empty table gives an empty result. Equal rows are packed one by one.
    """
    pieces = cut_lineage(pieces)
    sizes = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = allocations(plan_bins(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(ranks, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))

    @F.pandas_udf("sequence_id long, offset long")
    def assign(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = np.searchsorted(where["key"], length << RANK_BITS | rank, side="right") - 1
        at = rank - where["first"][row]
        copies = where["copies"][row]
        return pd.DataFrame({"sequence_id": where["sequence"][row] + at // copies,
                             "offset": where["offset"][row] + at % copies * length})

    return (ranked.withColumn("_to", assign("length", "rank"))
            .select(*[c for c in pieces.columns if c not in ("part", "place")],
                    "_to.sequence_id", "_to.offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset; see the two parts."""
    return pack_pieces(cut_pieces(docs, path, capacity, end_id, id_column, text_column), capacity)
