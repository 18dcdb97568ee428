"""Near-duplicate documents by a Jaccard join of word 5-gram sets.

Prefix-filtered inverted lists whose entries carry set size and position. Blocks of a
list are skipped by size and position; sets that only share passages are told apart
by how many prefix entries they share; in long lists, sets are compared with one
pivot first, and what is still apart meets in parcels of sets much like each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from trawlframe.llm.common import shuffle_partitions, unused_name
from trawlframe.llm.components import components
from trawlframe.llm.words import mixed, per_row, text_bytes, word_hashes
from trawlframe.session import BROADCAST_BYTES, cut_lineage

SHINGLE = 5
# Counters of the summary that finds frequent shingles, and those worth putting last.
COUNTERS, FREQUENT = 1 << 17, 16
# Lists up to this length are met pair by pair; longer ones through pivots.
SHORT_LIST = 64
# Classes of a parcel, and classes asking for it, that meet in one group.
BLOCK = 256
# Entries a task holds before it hands them on.
BUFFER = 1_000_000
BUCKETS_PER_PARTITION = 4
# Entries of one frequent shingle that should lie in one bucket at most.
BUCKET_ENTRIES = 1 << 16
_FACTORS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_SIGN = np.uint64(1 << 63)


def _as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct 64-bit shingles, hash of the set) of every text with words.

    A shingle is five neighbouring words; a text with fewer words has one, all of them.
    """
    for a, b, data, bounds in text_bytes(texts):
        words, _, rows = word_hashes(data, bounds)
        n = len(words)
        sums = mixed(reduce(np.add, [words[k:max(n - SHINGLE + 1 + k, 0)] * f for k, f in enumerate(_FACTORS)]))
        cuts = per_row(rows, b - a).tolist()
        for i in range(b - a):
            x, y = cuts[i], cuts[i + 1]
            if y - x >= SHINGLE:
                found = np.unique(sums[x:y - SHINGLE + 1])
            elif y > x:
                short = (words[x:y] * _FACTORS[:y - x]).sum(dtype=np.uint64) + np.uint64(y - x)
                found = mixed(np.array([short], np.uint64) ^ _SIGN)
            else:
                continue
            key = int(mixed(found).sum(dtype=np.uint64))
            yield a + i, found, key - (1 << 64) if key >> 63 else key


class FrequentItems:
    """Misra-Gries summary: every item seen more than total / COUNTERS times is in it.

    Counts are lower bounds. Summaries of parts add up to one of the whole.
    """

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.waiting.append((keys, np.ones(len(keys), np.int64) if counts is None else counts))
        self.size += len(keys)
        if self.size > 2 * BUFFER:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        keys = keys[first]
        counts = np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > COUNTERS:
            counts = counts - np.partition(counts, len(counts) - COUNTERS - 1)[len(counts) - COUNTERS - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts, self.waiting, self.size = keys, counts, [], 0


def _describe(docs: DataFrame) -> DataFrame:
    """A row for each document (id, n, class) and one for each task (its summary)."""
    id_type = docs.schema[0].dataType.simpleString()

    def work(batches):
        seen, known = FrequentItems(), set()
        for batch in batches:
            n, classes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, found, key in shingle_sets(batch.column(1)):
                n[row], classes[row] = len(found), key
                if key not in known:
                    known.add(key)
                    seen.add(found)
            empty = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(classes, mask=n == 0),
                 pa.nulls(batch.num_rows, pa.int32()), empty, empty],
                ["id", "n", "class", "part", "keys", "counts"])
        seen.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, docs_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
             pa.array([TaskContext.get().partitionId()], pa.int32()),
             pa.array([seen.keys.tobytes()], pa.binary()), pa.array([seen.counts.tobytes()], pa.binary())],
            ["id", "n", "class", "part", "keys", "counts"])

    docs_type = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    return docs.mapInArrow(
        work, f"id {id_type}, n long, class long, part int, keys binary, counts binary")


def _frequent(summaries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The summaries of all tasks, sixteen at a time, into one of at most COUNTERS items."""
    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        total = FrequentItems()
        for keys, counts in zip(rows["keys"], rows["counts"]):
            total.add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64))
        total.settle()
        return pd.DataFrame({"part": [key[0]], "keys": [total.keys.tobytes()],
                             "counts": [total.counts.tobytes()]})

    most = summaries.select(F.max("part")).first()[0]
    while True:
        summaries = (summaries.groupBy((F.col("part") / 16).cast("int").alias("part"))
                     .applyInPandas(merge, "part int, keys binary, counts binary"))
        if most is None or most < 16:
            break
        most //= 16
    row = summaries.first()
    if row is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, counts = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64)
    return keys[counts >= FREQUENT], counts[counts >= FREQUENT]


def _prefix_entries(docs: DataFrame, keys: np.ndarray, counts: np.ndarray, buckets: int) -> DataFrame:
    """Inverted-list entries of the prefixes, packed by bucket of the shingle.

    Shingles are ordered by their count if frequent, else first, and by hash; two sets with a Jaccard similarity of
    0.75 share one among the first n - ceil(0.75 n) + 1 of each. A set that the task
    has seen is not entered again. A frequent shingle's entries spread over several
    buckets by set, and are marked, if it has many.
    """
    shares = -(-(counts + 1) // BUCKET_ENTRIES)

    def packed(parts):
        shingle, cls, size, place, part = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(part, kind="stable")
        part = part[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        columns = [c[order] for c in (shingle, cls, size, place)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[edges[:-1]].astype(np.int32)),
             *(pa.array([c[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])], pa.binary())
               for c in columns)], ["bucket", "shingles", "classes", "sizes", "places"])

    def work(batches):
        known, parts, waiting = set(), [], 0
        for batch in batches:
            for _, found, key in shingle_sets(batch.column(0)):
                if key in known:
                    continue
                known.add(key)
                n = len(found)
                spread = np.ones(n, np.int64)
                times = np.zeros(n, np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    often = keys[at] == found
                    times, spread = np.where(often, counts[at], 0), np.where(often, shares[at], 1)
                order = np.argsort(times, kind="stable")[:n - (3 * n + 3) // 4 + 1]
                shingle, spread = found[order], spread[order]
                # The sign of the size marks entries of a shingle that lie in several buckets.
                bucket = (mixed(shingle) >> np.uint64(32)).astype(np.int64)
                bucket = (bucket + (key % (1 << 31)) % spread) % buckets
                parts.append((shingle, np.full(len(order), key, np.int64),
                              np.where(spread > 1, -n, n).astype(np.int32),
                              np.arange(len(order), dtype=np.int32), bucket))
                waiting += len(order)
                if waiting > BUFFER:
                    yield from packed(parts)
                    parts, waiting = [], 0
        if parts:
            yield from packed(parts)

    return docs.mapInArrow(
        work, "bucket int, shingles binary, classes binary, sizes binary, places binary")


PAIR, ENTRY = 0, 1


def _meet(entries: DataFrame) -> DataFrame:
    """Pairs of classes that share entries of short lists, and the entries of long lists.

    PAIR rows: a, b, sizes, number of short lists shared in this bucket. ENTRY rows:
    a shingle, b class, size, place. Lists are sorted by size; a pair is skipped where
    sizes differ too much, or positions so much that the rest cannot suffice.
    """
    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        shingle, cls, size, place = (
            np.frombuffer(b"".join(rows[name]), kind) for name, kind in
            (("shingles", np.uint64), ("classes", np.int64), ("sizes", np.int32), ("places", np.int32)))
        order = np.lexsort((cls, np.abs(size), shingle))
        shingle, cls, size, place = shingle[order], cls[order], size[order].astype(np.int64), place[order]
        fresh = np.ones(len(cls), bool)  # copies entered by several tasks
        fresh[1:] = (shingle[1:] != shingle[:-1]) | (cls[1:] != cls[:-1])
        shingle, cls, size, place = shingle[fresh], cls[fresh], size[fresh], place[fresh].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        lengths = np.diff(starts, append=len(shingle))
        length = np.repeat(lengths, lengths)
        long_list = (length > SHORT_LIST) | (size < 0)
        size = np.abs(size)
        out = [pd.DataFrame({"kind": ENTRY, "a": _as_long(shingle[long_list]), "b": cls[long_list],
                             "size_a": size[long_list], "size_b": place[long_list], "shared": 1})]
        keep = ~long_list & (length > 1)
        shingle, cls, size, place = shingle[keep], cls[keep], size[keep], place[keep]
        pairs = []
        for step in range(1, SHORT_LIST):
            left = np.flatnonzero(shingle[:-step] == shingle[step:]) if step < len(shingle) else []
            if not len(left):
                break
            right = left + step
            small, large = size[left], size[right]
            most = (np.minimum(place[left], place[right]) + 1
                    + np.minimum(small - place[left], large - place[right]) - 1)
            near = (4 * small >= 3 * large) & (7 * most >= 3 * (small + large))
            pairs.append((cls[left[near]], cls[right[near]], small[near], large[near]))
        if pairs:
            a, b, size_a, size_b = (np.concatenate(c) for c in zip(*pairs))
            turn = a > b
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            size_a, size_b = np.where(turn, size_b, size_a), np.where(turn, size_a, size_b)
            order = np.lexsort((b, a))
            a, b, size_a, size_b = a[order], b[order], size_a[order], size_b[order]
            if len(a):
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                out.append(pd.DataFrame({
                    "kind": PAIR, "a": a[first], "b": b[first], "size_a": size_a[first],
                    "size_b": size_b[first], "shared": np.diff(first, append=len(a))}))
        return pd.concat(out)

    return entries.groupBy("bucket").applyInPandas(
        work, "kind int, a long, b long, size_a long, size_b long, shared long")


def _ceil(numerator: Column, denominator: int) -> Column:
    return F.ceil(numerator / F.lit(denominator))


def _needed(size_a: Column, size_b: Column) -> Column:
    """Prefix entries that two linked sets share at least.

    Beyond the prefix that ends first, a set has ceil(0.75 n) - 1 shingles; the
    overlap must reach 3/7 of both sizes.
    """
    return (_ceil(3 * (size_a + size_b), 7) - F.greatest(_ceil(3 * size_a, 4), _ceil(3 * size_b, 4)) + 1)


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """With a broadcast hint if the counted rows are within the size bound."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, shingles (sorted, packed) of the wanted classes, laid out by class."""
    def work(batches):
        known = set()
        for batch in batches:
            classes, sets = [], []
            for _, found, key in shingle_sets(batch.column(0)):
                if key not in known:
                    known.add(key)
                    classes.append(key)
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "shingles"])

    wanted = cut_lineage(wanted.distinct())
    sets = docs.mapInArrow(work, "class long, shingles binary").join(_small(wanted, 16), "class", "left_semi")
    n = shuffle_partitions(docs.sparkSession)
    return cut_lineage(sets.repartition(n, "class").dropDuplicates(["class"]))


@F.pandas_udf(LongType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64),
                                         assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def _linked(overlap: Column, size_a: Column, size_b: Column) -> Column:
    return 100 * overlap >= 75 * (size_a + size_b - overlap)


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, size_a, size_b and the overlap of their whole sets."""
    sides = [sets.select(F.col("class").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab"]
    pairs = cut_lineage(pairs.select("a", "b").distinct())
    # Only sets that some pair names travel to it.
    named = sides[1].join(_small(cut_lineage(pairs.select("b").distinct()), 16), "b", "left_semi")
    joined = sides[0].join(_small(pairs, 32), "a").join(named, "b")
    return cut_lineage(joined.select(
        "a", "b", (F.octet_length("set_a") / 8).cast("long").alias("size_a"),
        (F.octet_length("set_b") / 8).cast("long").alias("size_b"), _overlap("set_a", "set_b").alias("overlap")))


def _links(compared: DataFrame) -> DataFrame:
    return compared.where(_linked(F.col("overlap"), F.col("size_a"), F.col("size_b"))).select("a", "b")


def _crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends have different labels; a class without links is its own."""
    sides = [labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab"]
    joined = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left")
    return (joined.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
            .drop("label_a", "label_b"))


def _pivots(entries: DataFrame) -> DataFrame:
    """Each class of a long list with the list's first class of like size, how often, and a size.

    Classes fall in bands of size a factor 4/3 wide; first classes of neighbouring
    bands are paired too, so whatever can link is joined by a path of pairs.
    """
    banded = entries.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(4 / 3)))))
    firsts = banded.groupBy("shingle", "band").agg(F.min("class").alias("pivot"), F.min("size").alias("least"))
    own = banded.join(firsts, ["shingle", "band"]).select("class", "pivot", "size")
    above = firsts.select("shingle", (F.col("band") - 1).alias("band"), F.col("pivot").alias("class"),
                          F.col("least").alias("size"))
    between = firsts.join(above, ["shingle", "band"]).select("class", "pivot", "size")
    return (own.union(between).where("class != pivot")
            .groupBy(F.col("class").alias("a"), F.col("pivot").alias("b"))
            .agg(F.count(F.lit(1)).alias("times"), F.min("size").alias("size")))


def _hub_pairs(pairs: DataFrame) -> DataFrame:
    """Of each class's pairs the one with the class that has most of them, as (class, hub)."""
    both = cut_lineage(pairs.select("a", "b").union(pairs.select("b", "a")))
    degrees = both.groupBy(F.col("b")).agg(F.count(F.lit(1)).alias("degree"))
    picked = both.join(degrees, "b").groupBy("a").agg(F.max_by("b", F.struct("degree", "b")).alias("b"))
    # Two classes may have picked each other.
    return (picked.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
            .agg(F.min(F.struct("a", "b")).alias("k")).select("k.a", "k.b"))


def _parcels(labels: DataFrame, hubs: DataFrame) -> DataFrame:
    """label, parcel: components of few classes put together, some BLOCK classes to a parcel.

    ``labels`` has class and label, ``hubs`` the pivot a class meets most often. Components
    around one pivot lie together, as they stand in the same lists; one of more than
    BLOCK / 2 classes is a parcel of its own.
    """
    around = (labels.join(hubs, "class", "left").groupBy("label")
              .agg(F.count(F.lit(1)).alias("crowd"), F.min(F.coalesce("hub", "class")).alias("hub")))
    few = around.where(F.col("crowd") <= BLOCK // 2)
    blocks = few.groupBy("hub").agg(_ceil(F.sum("crowd"), BLOCK).alias("blocks"))
    number = F.pmod(F.xxhash64("label"), F.col("blocks"))
    return (few.join(blocks, "hub").select("label", F.xxhash64("hub", number).alias("parcel"))
            .union(around.where(F.col("crowd") > BLOCK // 2).select("label", F.xxhash64("label").alias("parcel"))))


def _open_questions(labelled: DataFrame) -> DataFrame:
    """class, label, target: classes that may link to a member of a parcel with another label.

    ``labelled`` has the entries of lists that hold more than one label, with the parcel of
    each label and the number of its classes; the smaller parcel asks. A parcel stands in
    a list once, with its range of sizes, so a class meets a crowd of others as one. It must
    share as many lists with the parcel as its least demanding member could need.
    """
    heads = labelled.groupBy("shingle", F.col("parcel").alias("target"), F.col("crowd").alias("target_crowd")).agg(
        F.min("size").alias("low"), F.max("size").alias("high"),
        F.min("label").alias("first"), F.max("label").alias("last"))
    size = F.col("size")
    asks = F.struct("crowd", "parcel") <= F.struct("target_crowd", "target")
    others = (F.col("first") != F.col("label")) | (F.col("last") != F.col("label"))
    met = (labelled.join(heads, "shingle")
           .where(asks & others & (4 * F.col("high") >= 3 * size) & (4 * size >= 3 * F.col("low")))
           .groupBy("class", "label", "size", "target")
           .agg(F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"), F.max("high").alias("high")))
    low = F.greatest("low", _ceil(3 * size, 4))
    high = F.least("high", F.floor(4 * size / 3))
    # Between its ends the need is not lower, but for one by rounding.
    return met.where(F.col("shared") >= F.least(_needed(size, low), _needed(size, high)) - 1).select(
        "class", "label", "target")


def _block_links(key, members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
    """One link of each asking class to each other component in a block of members, if it has any.

    The members' shingles are one sorted list, with who holds each; a look into it counts what
    an asking class shares with all of them.
    """
    out = []
    if not len(members) or not len(asking):
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    sets = [np.frombuffer(x, np.uint64) for x in members["shingles"]]
    classes, labels = members["cls"].to_numpy(), members["label"].to_numpy()
    sizes = np.array([len(x) for x in sets], np.int64)
    shingles, holders = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, holders = shingles[order], holders[order]
    for row in asking.itertuples(index=False):
        own = np.frombuffer(row.shingles, np.uint64)
        start = np.searchsorted(shingles, own, "left")
        times = np.searchsorted(shingles, own, "right") - start
        at = np.repeat(start - (np.cumsum(times) - times), times) + np.arange(times.sum())
        common = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero((100 * common >= 75 * (sizes + len(own) - common)) & (labels != row.label))
        near = near[np.unique(labels[near], return_index=True)[1]]
        out.extend((row.cls, int(other)) for other in classes[near])
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _links_across(entries: DataFrame, labels: DataFrame, hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) through long lists between components, at least one of each two that link.

    Members of the target and the classes that ask meet in blocks of both, so sets
    travel once for each block and not once for each pair, and no component or crowd of
    questions meets in one task.
    """
    labelled = (entries.select("shingle", "class", "size")
                .join(labels.select(F.col("node").alias("class"), "label"), "class", "left")
                .withColumn("label", F.coalesce("label", "class")))
    mixed_lists = (labelled.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y"))
                   .where("x != y").select("shingle"))
    labelled = cut_lineage(labelled.join(mixed_lists, "shingle", "left_semi"))
    members = labelled.select("class", "label").distinct()
    members = cut_lineage(members.join(_parcels(members, hubs), "label"))
    crowds = members.groupBy("parcel").agg(F.count(F.lit(1)).alias("crowd"))
    asked = cut_lineage(_open_questions(
        labelled.join(members.select("class", "parcel"), "class").join(crowds, "parcel")))
    blocks = cut_lineage(
        asked.groupBy("target").agg(F.count(F.lit(1)).alias("asking")).join(
            crowds.withColumnRenamed("parcel", "target"), "target")
        .select("target", _ceil(F.col("asking"), BLOCK).cast("int").alias("asking_blocks"),
                _ceil(F.col("crowd"), BLOCK).cast("int").alias("member_blocks")))

    keys = ["target", "member_block", "asking_block"]

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        number = F.pmod(F.xxhash64("class"), F.col(f"{own}_blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        placed = cut_lineage(rows.join(blocks, "target").withColumns(
            {f"{own}_block": number, f"{other}_block": every}).select("class", "label", *keys))
        placed = sets.join(_small(placed, 48), "class").withColumnRenamed("class", "cls")
        # New names for the same columns, so that the two sides can be told apart.
        return placed.select(*[F.col(c).alias(c) for c in (*keys, "cls", "label", "shingles")])

    everyone = members.select("class", "label", F.col("parcel").alias("target"))
    return (side(everyone, "member", "asking").groupBy(*keys)
            .cogroup(side(asked, "asking", "member").groupBy(*keys))
            .applyInPandas(_block_links, "a long, b long"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id, and all other rows.

    Rows are told apart by their place in the table, so repeated rows and null ids are
    groups like any other (null comes last); ``docs`` must come in the same order each
    time it is read, as files do, and not straight from a shuffle. All columns stay. The rows to leave out are
    broadcast if their number is within the size bound, else joined.
    """
    place = unused_name(docs, "_place")
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    texts = placed.select(F.col(place).alias("_place"), F.col(text_column).alias("_text"))
    found = near_duplicates(texts, "_place", "_text").where("n_shingles > 0")
    grouped = cut_lineage(found.select("_place", F.col("component_id").alias("_group")))
    crowded = grouped.groupBy("_group").count().where("count > 1").select("_group")
    ids = placed.select(F.col(place).alias("_place"), F.col(id_column).alias("_id"))
    members = cut_lineage(grouped.join(crowded, "_group").join(ids, "_place"))
    # Nulls are greater than any id here.
    rank = F.struct(F.col("_id").isNull().alias("unknown"), F.col("_id").alias("id"), F.col("_place").alias("place"))
    stay = members.groupBy("_group").agg(F.min(rank).alias("first")).select(F.col("first.place").alias("_place"))
    leave = cut_lineage(members.select("_place").join(stay, "_place", "left_anti"))
    return placed.join(_small(leave.toDF(place), 16), place, "left_anti").drop(place)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row.

    Words are runs without blanks and control white space, A-Z lower-cased. Two texts
    link when the Jaccard similarity of their sets of five-word shingles is at least
    0.75 (texts with fewer words: one shingle); component_id is the smallest id
    reachable by links. Exact for 64-bit hashes of shingles and sets.

    Equal sets are one class, met once. A null, empty or blank text has no shingles
    and no links: its component is its own id. Rows with a null id take part, but
    name a component only if no other row can (then null). Repeated rows are kept;
    other columns are ignored; an empty table gives an empty result.

    Texts are read three times: for classes and frequent shingles (one bounded summary),
    for prefix entries (packed, shuffled once), and for the sets of classes that may
    link. Only table keys with a checked size are broadcast.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    texts = source.select("text")
    buckets = BUCKETS_PER_PARTITION * shuffle_partitions(spark)

    described = cut_lineage(_describe(source))
    rows = described.where("n is not null").select("id", "n", "class")
    frequent = _frequent(described.where("n is null").select("part", "keys", "counts"))
    met = cut_lineage(_meet(_prefix_entries(texts, *frequent, buckets)))
    entries = met.where(F.col("kind") == ENTRY).select(
        F.col("a").alias("shingle"), F.col("b").alias("class"), F.col("size_a").alias("size"),
        F.col("size_b").alias("place"))
    held = entries.groupBy("class").agg(F.count(F.lit(1)).alias("held"))
    pairs = (met.where(F.col("kind") == PAIR).groupBy("a", "b")
             .agg(F.sum("shared").alias("shared"), F.first("size_a").alias("size_a"),
                  F.first("size_b").alias("size_b")))
    for c in "ab":
        pairs = pairs.join(held.select(F.col("class").alias(c), F.col("held").alias(f"held_{c}")), c, "left")
    in_long_lists = F.least(F.coalesce("held_a", F.lit(0)), F.coalesce("held_b", F.lit(0)))
    needed = _needed(F.col("size_a"), F.col("size_b"))
    pairs = cut_lineage(pairs.where(F.col("shared") + in_long_lists >= needed)
                        .select("a", "b", (F.col("shared") >= needed).alias("enough")))

    sets = _sets_of(texts, pairs.select(F.col("a").alias("class")).union(pairs.select("b"))
                    .union(entries.select("class")))
    stars = cut_lineage(_pivots(entries))
    firsts = stars.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
    # First what is most likely to link; then only pairs whose components still differ.
    compared = _compare(firsts.union(_hub_pairs(pairs.where("enough"))), sets)
    links = _links(compared)
    labels = components(links)
    # Pivots met too seldom to link by that alone are left to the parcels.
    likely = stars.where(F.col("times") >= _needed(F.col("size"), F.col("size")))
    rest = likely.select("a", "b").union(pairs.select("a", "b"))
    seen = compared.select("a", "b").union(compared.select("b", "a"))
    more = _links(_compare(_crossing(rest, labels).join(seen, ["a", "b"], "left_anti"), sets))
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    if not entries.isEmpty():
        hubs = firsts.select(F.col("a").alias("class"), F.col("b").alias("hub"))
        more = cut_lineage(_links_across(entries, labels, hubs, sets))
        if not more.isEmpty():
            labels = components(links.union(more))

    placed = rows.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").select(
        "id", "n", F.coalesce("label", "class").alias("label"))
    least = placed.where("label is not null").groupBy("label").agg(F.min("id").alias("least"))
    return placed.join(least, "label", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
