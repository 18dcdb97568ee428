"""Scores of texts by a probabilistic suffix tree over words.

Words, and contexts of one and two words, are counted exactly, wherever they occur.
Contexts are kept where the words after them are distributed unlike those after the
shorter context. A word's probability comes from the longest kept context it follows,
smoothed towards the shorter ones and, at last, towards the counts of all words. What
is frequent is looked up from memory, all else in tables bucketed by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.common import discard, shuffle_partitions, written
from trawlframe.llm.words import mixed, text_bytes, word_hashes
from trawlframe.session import cut_lineage

# The hash that stands for the end of a text, counted as a word.
END = np.uint64(0x5DEECE66D1234567)
# A word is looked up from memory if it makes up this part of all, so at most so many are.
COMMON_WORDS = 1 << 20
# What is looked up from memory: a symbol, or a context of symbols, makes up this part of
# all words; a successor this part.
SYMBOLS, CONTEXTS, SUCCESSORS = 1 << 16, 1 << 16, 1 << 20
# Bits of the filter that tells most items without an entry in the tables.
FILTER_BITS = 1 << 27
# Divergence, times the context's count, from which a context is kept; taken off each count;
# occurrences from which a context or a successor counts, in a corpus of any size.
DIVERGENCE, DISCOUNT, LEAST_COUNT = 20.0, 0.75, 2
# Distinct items a task gathers before it hands them on.
BUFFER = 1_000_000
BUCKETS_PER_PARTITION = 4
# Stands for a word that is not in the table of common words, which has COMMON_WORDS at most.
UNCOMMON = (1 << 32) - 1
# Parts of the texts that are scored one after the other.
TEXT_SLICES = 4
_SYMBOL_BITS = np.int64(17)
# Tell the keys of contexts and of the words after them apart.
_PAIR, _SHORTER, _LONGER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class _Gatherer:
    """Counts of 64-bit items, handed on in buckets when there are many."""

    def __init__(self, buckets: int, bucket_of):
        self.buckets, self.bucket_of = buckets, bucket_of
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray):
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > BUFFER:
            self.parts = [_summed(*map(np.concatenate, zip(*self.parts)))]
            self.size = len(self.parts[0][0])
            if self.size > BUFFER // 2:
                yield from self.flush()

    def flush(self):
        if not self.parts:
            return
        keys, counts = _summed(*map(np.concatenate, zip(*self.parts)))
        self.parts, self.size = [], 0
        bucket = (self.bucket_of(keys) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, counts = bucket[order], keys[order], counts[order].astype(np.int32)
        if len(keys):
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[edges[:-1]]),
                 *(pa.array([c[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])], pa.binary())
                   for c in (keys, counts))], ["bucket", "keys", "counts"])


def _tokens(texts: pa.Array):
    """(first row, number of rows, hashes, row of each) with an end after every text."""
    for a, b, data, bounds in text_bytes(texts):
        words, _, rows = word_hashes(data, bounds)
        ends = np.searchsorted(rows, np.arange(b - a), side="right")
        yield a, b - a, np.insert(words, ends, END), np.insert(rows, ends, np.arange(b - a))


PACKED = "bucket int, keys binary, counts binary"


def _count_words(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, keys, counts, n, v: exact counts of all words, packed by bucket of the hash."""
    def gather(batches):
        found = _Gatherer(buckets, lambda keys: keys >> np.uint64(20))
        for batch in batches:
            for _, _, words, _ in _tokens(batch.column(0)):
                yield from found.add(words)
        yield from found.flush()

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _summed(np.frombuffer(b"".join(rows["keys"]), np.uint64),
                               np.frombuffer(b"".join(rows["counts"]), np.int32).astype(np.int64))
        return pd.DataFrame({"bucket": [key[0]], "keys": [keys.tobytes()], "counts": [counts.tobytes()],
                             "n": [int(counts.sum())], "v": [len(keys)]})

    return (texts.mapInArrow(gather, PACKED).groupBy("bucket")
            .applyInPandas(merge, PACKED + ", n long, v long"))


@dataclass
class Words:
    """Counts of the common words, and which of them are symbols (numbered from 1)."""

    keys: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    total: int
    distinct: int

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it common, its place) of each word."""
        if not len(self.keys):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return self.keys[at] == words, at

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Probability of a word with so many occurrences, from the counts of all words."""
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))


def _common_words(counted: DataFrame, total: int, distinct: int) -> Words:
    """Words from total / COMMON_WORDS occurrences on: at most COMMON_WORDS of them."""
    least = max(1, -(-total // COMMON_WORDS))

    def chosen(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                often = counts >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[often].tobytes()], pa.binary()) for c in (keys, counts)], ["keys", "counts"])

    rows = counted.select("keys", "counts").mapInArrow(chosen, "keys binary, counts binary").collect()
    keys = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint64)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    often = counts >= max(LEAST_COUNT, -(-total // SYMBOLS))
    return Words(keys, counts, np.where(often, np.cumsum(often), 0), total, distinct)


def _states(words: Words, hashes: np.ndarray, rows: np.ndarray):
    """(symbol of each token, 0 if none; symbol before it; symbol before that) within a text."""
    common, at = words.find(hashes)
    symbols = np.where(common, words.symbols[at] if len(words.symbols) else 0, 0).astype(np.int64)

    def before(k):
        out = np.zeros(len(symbols), np.int64)
        out[k:] = np.where(rows[k:] == rows[:-k], symbols[:-k], 0)
        return out

    first = before(1) if len(symbols) > 1 else np.zeros(len(symbols), np.int64)
    second = np.where(first > 0, before(2), 0) if len(symbols) > 2 else np.zeros(len(symbols), np.int64)
    return common, at, symbols, first, second


def _context_key(second: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of a context of two symbols, or of one if ``second`` is 0."""
    return second << _SYMBOL_BITS | first


def _before(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word before each token, word before that) within a text, 0 if there is none."""
    def before(k):
        out = np.zeros(len(hashes), np.uint64)
        if len(hashes) > k:
            out[k:] = np.where(rows[k:] == rows[:-k], hashes[:-k], np.uint64(0))
        return out

    return before(1), before(2)


def _pair_key(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(first + _PAIR) + word)


def _item_keys(second: np.ndarray, first: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Keys of the contexts of one and two words, and of the word after each."""
    longer = mixed(_pair_key(second, first) + _LONGER)
    return [mixed(first + _SHORTER), _pair_key(first, word), longer, mixed(longer + word)]


def _summed_items(seconds, firsts, words, counts):
    """Distinct (second, first, word), ascending by pair, their counts, and where pairs begin."""
    pairs = _pair_key(firsts, words)
    order = np.lexsort((seconds, pairs))
    seconds, firsts, words, counts, pairs = (c[order] for c in (seconds, firsts, words, counts, pairs))
    new_pair = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    at = np.flatnonzero(new_pair | np.concatenate([[True], seconds[1:] != seconds[:-1]]))
    return seconds[at], firsts[at], words[at], np.add.reduceat(counts, at), np.flatnonzero(new_pair[at])


def _coded(words: Words, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list, list]:
    """Places of the common words in their table, and the hashes of all others, of each range."""
    common, at = words.find(hashes)
    codes = np.where(common, at, UNCOMMON).astype(np.uint32)
    return ([codes[x:y].tobytes() for x, y in zip(starts, ends)],
            [hashes[x:y][~common[x:y]].tobytes() for x, y in zip(starts, ends)])


def _decoded(words: Words, codes: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    common = codes != UNCOMMON
    out[common] = words.keys[codes[common]]
    out[~common] = others
    return out


def _count_contexts(texts: DataFrame, words_of: Broadcast, buckets: int) -> DataFrame:
    """second, first, word, n: words after one (second is 0) and two words, from LEAST_COUNT on.

    A pair of words and all triples ending in it are in one bucket, so triples alone are
    shuffled, each task's distinct ones once, and a common word by its place in their table.
    """
    names = ["bucket", "firsts", "other_firsts", "words", "other_words", "seconds", "other_seconds", "runs", "counts"]

    def packed(parts):
        seconds, firsts, words, counts, starts = _summed_items(
            *(np.concatenate(c) for c in zip(*parts)))
        bucket = (_pair_key(firsts[starts], words[starts]) >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        runs = np.diff(starts, append=len(seconds))
        items = np.argsort(np.repeat(bucket, runs), kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        ends = np.concatenate([[0], np.cumsum(runs[order])])[edges]
        columns = []
        for hashes, e in ((firsts[starts][order], edges), (words[starts][order], edges), (seconds[items], ends)):
            columns += _coded(words_of.value, hashes, e[:-1], e[1:])
        for numbers, e in ((runs[order], edges), (counts[items], ends)):
            columns.append([numbers[x:y].astype(np.uint32).tobytes() for x, y in zip(e[:-1], e[1:])])
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[order][edges[:-1]].astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names)

    def gather(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, hashes, rows in _tokens(batch.column(0)):
                first, second = _before(hashes, rows)
                known = first > 0
                parts.append((second[known], first[known], hashes[known], np.ones(known.sum(), np.int64)))
                size += len(parts[-1][0])
                if size > BUFFER:
                    yield packed(parts)
                    parts, size = [], 0
        if size:
            yield packed(parts)

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        def column(name, kind):
            return np.frombuffer(b"".join(rows[name]), kind)

        def decoded(name):
            return _decoded(words_of.value, column(name, np.uint32), column(f"other_{name}", np.uint64))

        runs = column("runs", np.uint32)
        seconds, firsts, words, counts, starts = _summed_items(
            decoded("seconds"), np.repeat(decoded("firsts"), runs),
            np.repeat(decoded("words"), runs), column("counts", np.uint32).astype(np.int64))
        sums = np.add.reduceat(counts, starts)
        pair, triple = starts[sums >= LEAST_COUNT], (counts >= LEAST_COUNT) & (seconds > 0)
        return pd.DataFrame({
            "second": np.concatenate([np.zeros(len(pair), np.uint64), seconds[triple]]).view(np.int64),
            "first": np.concatenate([firsts[pair], firsts[triple]]).view(np.int64),
            "word": np.concatenate([words[pair], words[triple]]).view(np.int64),
            "n": np.concatenate([sums[sums >= LEAST_COUNT], counts[triple]])})

    return (texts.mapInArrow(gather, "bucket int, " + ", ".join(f"{name} binary" for name in names[1:]))
            .groupBy("bucket").applyInPandas(merge, "second long, first long, word long, n long"))


def _kept_contexts(items: DataFrame, by: list[str]) -> DataFrame:
    """by, total, weight: contexts whose divergence from their suffix counts.

    ``items`` has n, total and predicted, the probability by the suffix, of each
    successor. What these leave over is compared as one.
    """
    own = F.col("n") / F.col("total")
    sums = items.groupBy(*by).agg(
        F.first("total").alias("total"), F.sum(own * F.log(own / F.col("predicted"))).alias("gain"),
        F.greatest(1 - F.sum("n") / F.first("total"), F.lit(1e-12)).alias("rest"),
        F.greatest(1 - F.sum("predicted"), F.lit(1e-12)).alias("rest_predicted"),
        (1 - F.sum(F.col("n") - DISCOUNT) / F.first("total")).alias("weight"))
    divergence = F.col("gain") + F.col("rest") * F.log(F.col("rest") / F.col("rest_predicted"))
    return sums.where(F.col("total") * divergence >= DIVERGENCE).select(*by, "total", "weight")


def _model(counted: DataFrame, items: DataFrame, total: int, distinct: int) -> DataFrame:
    """second, first, word, total, n, own, gain: kept contexts (word null) and their successors.

    second is 0 for contexts of one word. ``own`` is the weight of a context's suffix, or
    a successor's part; ``gain`` what the row adds to the log10 probability of a text for
    each time it is met, so that a successor's row comes on top of its context's.
    """
    def often(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                enough = counts >= LEAST_COUNT
                yield pa.RecordBatch.from_arrays([pa.array(c[enough]) for c in (keys, counts)], ["hash", "count"])

    words = counted.select("keys", "counts").mapInArrow(often, "hash long, count long")
    base = (F.col("count") + 0.5) / (total + 0.5 * (distinct + 1))
    part = (F.col("n") - DISCOUNT) / F.col("total")
    # A word is followed as often as it occurs, a pair of words too.
    pairs = (items.where("second = 0").drop("second")
             .join(words.select(F.col("hash").alias("word"), base.alias("predicted")), "word")
             .join(words.select(F.col("hash").alias("first"), F.col("count").alias("total")), "first"))
    pairs = written(pairs)
    short = written(_kept_contexts(pairs, ["first"]))
    smoothed = F.col("weight") * F.col("predicted") + part
    unsmoothed, pairs = pairs, written(pairs.join(short.drop("total"), "first", "left").withColumn(
        "smoothed", F.coalesce(smoothed, "predicted")))
    discard(unsmoothed)
    triples = (items.where("second <> 0")
               .join(pairs.select("first", "word", F.col("smoothed").alias("predicted")), ["first", "word"])
               .join(pairs.select(F.col("first").alias("second"), F.col("word").alias("first"),
                                  F.col("n").alias("total")), ["second", "first"]))
    followed = triples = written(triples)
    long = written(_kept_contexts(triples, ["second", "first"]))
    triples = triples.join(long.drop("total"), ["second", "first"]).withColumn("smoothed", smoothed)

    def contexts(kept):
        return kept.withColumns({"word": F.lit(None).cast("long"), "n": F.col("total"), "own": F.col("weight"),
                                 "gain": F.log10("weight")})

    def successors(kept):
        return kept.withColumns({"own": part, "gain": F.log10(F.col("smoothed") / F.col("predicted") / F.col("weight"))})

    none = F.lit(0).cast("long")
    parts = (contexts(short).withColumn("second", none), contexts(long),
             successors(pairs.where("weight is not null")).withColumn("second", none), successors(triples))
    names = ["second", "first", "word", "total", "n", "own", "gain"]
    one, *others = (p.select(*names) for p in parts)
    for other in others:
        one = one.unionByName(other)
    model = written(one)
    for table in (pairs, short, followed, long):
        discard(table)
    return model


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The batch of a model, and which rows are contexts; their word is 0."""
    out = {name: batch.column(name).fill_null(0).to_numpy(zero_copy_only=False) for name in batch.schema.names}
    out |= {name: out[name].view(np.uint64) for name in ("second", "first", "word")}
    return out | {"context": batch.column("word").is_null().to_numpy(zero_copy_only=False)}


def _in_memory(words: Words, rows: dict[str, np.ndarray]):
    """(is it frequent enough to be looked up from memory, number of the context, symbol) of each row.

    If a context, or a successor, is, then so is that of its suffix, if kept.
    """
    symbols = {}
    for name in ("second", "first", "word"):
        common, at = words.find(rows[name])
        symbols[name] = np.where(common, words.symbols[at] if len(words.symbols) else 0, 0).astype(np.int64)
    known = (symbols["first"] > 0) & ((symbols["second"] > 0) | (rows["second"] == 0))
    known &= rows["total"] >= max(LEAST_COUNT, -(-words.total // CONTEXTS))
    known &= rows["context"] | ((symbols["word"] > 0) & (
        rows["n"] >= max(LEAST_COUNT, -(-words.total // SUCCESSORS))))
    return known, _context_key(symbols["second"], symbols["first"]), symbols["word"]


def _pack_gains(model: DataFrame, words: Broadcast, buckets: int) -> DataFrame:
    """bucket, keys, gains, bits: rows of the model that are not in memory, by bucket of their key.

    ``bits`` is the bucket's share of the filter.
    """
    size = max(8, FILTER_BITS // buckets // 8 * 8)

    def pack(batches):
        for batch in batches:
            rows = _columns(batch)
            known, _, _ = _in_memory(words.value, rows)
            keys = _item_keys(rows["second"], rows["first"], rows["word"])
            keys = np.where(rows["second"] == 0, np.where(rows["context"], keys[0], keys[1]),
                            np.where(rows["context"], keys[2], keys[3]))[~known]
            if len(keys):
                gains = rows["gain"][~known]
                bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order][edges[:-1]]),
                     *(pa.array([c[order][x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])], pa.binary())
                       for c in (keys, gains))], ["bucket", "keys", "gains"])

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(rows["keys"]), np.uint64)
        gains = np.frombuffer(b"".join(rows["gains"]), np.float64)
        order = np.argsort(keys)
        bits = np.zeros(size, bool)
        bits[mixed(keys) % np.uint64(size)] = True
        return pd.DataFrame({"bucket": [key[0]], "keys": [keys[order].tobytes()],
                             "gains": [gains[order].tobytes()], "bits": [np.packbits(bits).tobytes()]})

    return (model.mapInArrow(pack, "bucket int, keys binary, gains binary").groupBy("bucket")
            .applyInPandas(merge, "bucket int, keys binary, gains binary, bits binary"))


@dataclass
class Filter:
    """Whether a key may have an entry in the tables: no entry is missed."""

    bits: np.ndarray

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        size = np.uint64(self.bits.shape[1] * 8)
        bit = mixed(keys) % size
        bucket = (keys >> np.uint64(20)) % np.uint64(len(self.bits))
        return (self.bits[bucket, bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _filter(gains: DataFrame, buckets: int) -> Filter:
    bits = np.zeros((buckets, max(8, FILTER_BITS // buckets // 8 * 8) // 8), np.uint8)
    for row in gains.select("bucket", "bits").toLocalIterator():
        bits[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits)


@dataclass
class SuffixTree:
    """Kept contexts with the weight of their suffix; kept successors with their own part."""

    contexts: np.ndarray
    weights: np.ndarray
    keys: np.ndarray
    parts: np.ndarray

    def smooth(self, contexts: np.ndarray, symbols: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities after contexts, given those after their suffixes.

        A context that is not kept, as 0, leaves the probability as it is.
        """
        if not len(self.contexts):
            return shorter
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        kept = self.contexts[at] == contexts
        out = np.where(kept, self.weights[at] * shorter, shorter)
        if len(self.keys):
            keys = contexts << _SYMBOL_BITS | symbols
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = out + np.where(kept & (symbols > 0) & (self.keys[at] == keys), self.parts[at], 0)
        return out


def _tree(counted: DataFrame, words: Words) -> SuffixTree:
    """The part of the model that is looked up from memory.

    The driver sees at most 2 * CONTEXTS contexts and 2 * SUCCESSORS successors.
    """
    shared = counted.sparkSession.sparkContext.broadcast(words)

    def chosen(batches):
        for batch in batches:
            rows = _columns(batch)
            known, contexts, symbols = _in_memory(shared.value, rows)
            short, after = known & rows["context"], known & ~rows["context"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.tobytes()], pa.binary()) for c in (
                    contexts[short], rows["own"][short],
                    (contexts << _SYMBOL_BITS | symbols)[after], rows["own"][after])],
                ["contexts", "weights", "keys", "parts"])

    rows = counted.mapInArrow(chosen, "contexts binary, weights binary, keys binary, parts binary").collect()
    contexts, weights, keys, parts = (
        np.frombuffer(b"".join(r[name] for r in rows), kind)
        for name, kind in (("contexts", np.int64), ("weights", float), ("keys", np.int64), ("parts", float)))
    order, key_order = np.argsort(contexts), np.argsort(keys)
    return SuffixTree(contexts[order], weights[order], keys[key_order], parts[key_order])


def _score_known(docs: DataFrame, model: Broadcast, buckets: int) -> DataFrame:
    """A row for each text with sums over what is in memory; packed rows of all else.

    Texts: part, place, id, held_out, n_tokens, known, base, score, where the other words
    count as if their base probability were 1. Others: part, bucket, and for each
    distinct word or item of a text its key, the text's place and how often; items are in
    the buckets after those of the words.
    """
    id_type = docs.schema[0].dataType.simpleString()
    names = ["part", "place", "id", "held_out", "n_tokens", "known", "base", "score",
             "bucket", "keys", "places", "counts"]
    types = [pa.int32(), pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
             pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def batch_of(n, **columns):
        return pa.RecordBatch.from_arrays(
            [columns.get(name, None) if name in columns else pa.nulls(n, columns["id_type"] if t is None else t)
             for name, t in zip(names, types)], names)

    def packed(part, rare, kind, first_bucket):
        keys, places, counts = (np.concatenate(c) for c in zip(*rare))
        bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32) + first_bucket
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        cut = {name: pa.array([c[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])], pa.binary())
               for name, c in (("keys", keys[order]), ("places", places[order].astype(np.uint32)),
                               ("counts", counts[order].astype(np.uint32)))}
        n = len(edges) - 1
        return batch_of(n, id_type=kind, part=pa.array(np.full(n, part, np.int32)),
                        bucket=pa.array(bucket[edges[:-1]]), **cut)

    def gather(found, keys, rows, place):
        order = np.lexsort((keys, rows))
        key, row = keys[order], rows[order]
        if len(key):
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
            found.append((key[new], place + row[new], np.diff(new, append=len(key))))

    def work(batches):
        words, tree, listed = model.value
        part, place, rare, items, kind = TaskContext.get().partitionId(), 0, [], [], pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for a, n, hashes, rows in _tokens(batch.column(2)):
                common, at, symbols, first, second = _states(words, hashes, rows)
                counts = np.where(common, words.counts[at] if len(words.counts) else 0, 0)
                base = np.where(common, words.base(counts), 1.0)
                p = tree.smooth(first, symbols, base)
                p = tree.smooth(np.where(second > 0, _context_key(second, first), 0), symbols, p)
                sums = {name: np.bincount(rows, np.log10(x), minlength=n) for name, x in (("base", base), ("score", p))}
                yield batch_of(
                    n, id_type=kind, part=pa.array(np.full(n, part, np.int32)),
                    place=pa.array(place + np.arange(n)), id=batch.column(0).slice(a, n),
                    held_out=batch.column(1).slice(a, n),
                    n_tokens=pa.array(np.bincount(rows, minlength=n)),
                    known=pa.array(np.bincount(rows, common, minlength=n).astype(np.int64)),
                    **{name: pa.array(x) for name, x in sums.items()})
                gather(rare, hashes[~common], rows[~common], place)
                before, before_that = _before(hashes, rows)
                for keys, known in zip(_item_keys(before_that, before, hashes), [before > 0] * 2 + [before_that > 0] * 2):
                    known = known & listed(keys)
                    gather(items, keys[known], rows[known], place)
                place += n
                for found, first_bucket in ((rare, 0), (items, buckets)):
                    if sum(len(x[0]) for x in found) > BUFFER:
                        yield packed(part, found, kind, first_bucket)
                        found.clear()
        for found, first_bucket in ((rare, 0), (items, buckets)):
            if found:
                yield packed(part, found, kind, first_bucket)

    return docs.mapInArrow(
        work, f"part int, place long, id {id_type}, held_out boolean, n_tokens long, known long, "
              "base double, score double, bucket int, keys binary, places binary, counts binary")


def _score_rare(rare: DataFrame, counted: DataFrame, gains: DataFrame, model: Broadcast, buckets: int) -> DataFrame:
    """part, places, known, sums: what the other words and items of each text add, for one bucket and task."""
    def work(key, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        words, are_words = model.value[0], key[0] < buckets
        keys = np.frombuffer(b"".join(known["keys"]), np.uint64)
        values = np.frombuffer(b"".join(known["numbers"]), np.int64 if are_words else np.float64)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = []
        for part, k, places, times in zip(asked["part"], asked["keys"], asked["places"], asked["counts"]):
            k, places, times = np.frombuffer(k, np.uint64), np.frombuffer(places, np.uint32), np.frombuffer(times, np.uint32)
            seen = np.zeros(len(k), values.dtype)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                seen = np.where(keys[at] == k, values[at], 0)
            texts, slot = np.unique(places, return_inverse=True)
            more = np.where(seen > 0, times, 0) if are_words else np.zeros(len(k))
            out.append((part, texts.tobytes(), np.bincount(slot, more).astype(np.int64).tobytes(),
                        np.bincount(slot, np.log10(words.base(seen)) * times if are_words else np.zeros(len(k))).tobytes(),
                        np.bincount(slot, np.log10(words.base(seen)) * times if are_words else seen * times).tobytes()))
        return pd.DataFrame(out, columns=["part", "places", "known", "bases", "sums"])

    tables = counted.select("bucket", "keys", F.col("counts").alias("numbers")).unionByName(
        gains.select((F.col("bucket") + buckets).alias("bucket"), "keys", F.col("gains").alias("numbers")))
    return (rare.groupBy("bucket").cogroup(tables.groupBy("bucket"))
            .applyInPandas(work, "part int, places binary, known binary, bases binary, sums binary"))


def _add_up(rare: DataFrame) -> DataFrame:
    """part, place, known, base, sum: one row for each text with other words or items."""
    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        places = np.frombuffer(b"".join(rows["places"]), np.uint32)
        texts, slot = np.unique(places, return_inverse=True)
        known = np.frombuffer(b"".join(rows["known"]), np.int64)
        bases, sums = (np.frombuffer(b"".join(rows[name]), np.float64) for name in ("bases", "sums"))
        return pd.DataFrame({"part": key[0], "place": texts.astype(np.int64),
                             "more_known": np.bincount(slot, known).astype(np.int64),
                             "more_base": np.bincount(slot, bases), "more": np.bincount(slot, sums)})

    return rare.groupBy("part").applyInPandas(
        work, "part int, place long, more_known long, more_base double, more double")


def score_documents(docs: DataFrame, training: Column, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """log10 probabilities of every whole text, learnt from the rows where ``training`` holds.

    Words are runs without blanks and control white space, A-Z lower-cased; an end
    counts as one more word. Returns id, held_out, n_tokens, n_known (words that occur
    in training), train_tokens, base_score (words alone) and score (suffix tree).

    A null text counts as empty: it has the end alone. A null ``training`` counts as
    true. Repeated rows are learnt from, and scored, one by one; other columns are
    ignored; an empty table gives an empty result. Words are told apart by 64-bit hashes.

    Exact counts of words and of triples of words are found, and shuffled, in proportion
    to the distinct ones of a task. Contexts and successors count from LEAST_COUNT
    occurrences on. Those that make up a fixed part of all words are broadcast, which
    bounds that. All others are met by bucket of the hash: a text's entries are packed,
    and come back as sums.
    """
    spark = docs.sparkSession
    trains = F.coalesce(training, F.lit(True))
    buckets = BUCKETS_PER_PARTITION * shuffle_partitions(spark)
    source = docs.select(F.col(id_column).alias("id"), (~trains).alias("held_out"),
                         F.coalesce(text_column, F.lit("")).alias("text"))
    learnt = source.where("not held_out").select("text")
    counted = written(_count_words(learnt, buckets))
    total, distinct = counted.select(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    words = _common_words(counted, total, distinct)
    shared = spark.sparkContext.broadcast(words)
    items = written(_count_contexts(learnt, shared, buckets))
    found = _model(counted, items, total, distinct)
    discard(items)
    tree = _tree(found, words)
    gains = written(_pack_gains(found, shared, buckets))
    discard(found)
    model = spark.sparkContext.broadcast((words, tree, _filter(gains, buckets)))
    # Texts are scored on their own, so a part of them at a time holds the disk their items take.
    own = F.pmod(F.xxhash64("id", "held_out", "text"), F.lit(TEXT_SLICES))
    parts = [_scored(source.where(own == i), counted, gains, model, buckets) for i in range(TEXT_SLICES)]
    discard(counted)
    discard(gains)
    one, *others = parts
    for other in others:
        one = one.unionByName(other)
    whole = cut_lineage(one)
    for part in parts:
        discard(part)
    return whole.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known",
                        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _scored(source: DataFrame, counted: DataFrame, gains: DataFrame, model: Broadcast, buckets: int) -> DataFrame:
    """id, held_out, n_tokens, n_known, base_score, score of the texts, in a table."""
    scored = written(_score_known(source, model, buckets))
    texts = scored.where("bucket is null").select(
        "part", "place", "id", "held_out", "n_tokens", "known", "base", "score")
    rare = scored.where("bucket is not null").select("part", "bucket", "keys", "places", "counts")
    added = _add_up(_score_rare(rare, counted, gains, model, buckets))
    whole = written(texts.join(added, ["part", "place"], "left").select(
        "id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")))
    discard(scored)
    return whole
