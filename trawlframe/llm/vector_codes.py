"""Codes of vectors from one small codebook for each part, learnt by member-resident Lloyd rounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.common import discard, shuffle_partitions, written
from trawlframe.session import attach_groups

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Members of an entry are dealt to one more owner for each so many vectors of the whole table.
OWNER_ROWS = 1_000_000
# Rows whose distances to all entries are held at once.
STEP = 4096
MEMBERS = "position int, old int, entry int, salt int, part binary, n long"
NO_ENTRY = -1


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds finite numbers alone."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def common_dimension(vectors: DataFrame, column: str) -> int:
    """The commonest length above 0 (of equally common ones the smallest), or 0 without rows."""
    top = (vectors.groupBy(F.size(column).alias("d")).count().where("d > 0")
           .orderBy(F.desc("count"), "d").first())
    return top["d"] if top else 0


def stacked(column: pa.Array, dimension: int) -> np.ndarray:
    """An Arrow list column without nulls as a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dimension)


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    limit = int(math.sqrt(2.0 ** 62 / max(vectors.shape[1], 1)) / 2)
    return np.clip(np.floor(vectors * scale), -limit, limit).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry, of equally near ones the first; exact."""
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    largest = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    in_doubles = 4.0 * x.shape[1] * float(largest) ** 2 < 2.0 ** 53
    step = STEP if in_doubles else max(1, STEP // max(1, x.shape[1]))
    for a in range(0, len(x), step):
        rows = x[a:a + step]
        if in_doubles:  # whole numbers below 2**53: the product of matrices is exact
            d = np.square(book).sum(1) - 2 * (rows.astype(np.float64) @ book.T.astype(np.float64))
            d = d.astype(np.int64) + np.square(rows).sum(1)[:, None]
        else:
            d = np.square(rows[:, None, :] - book[None]).sum(2)
        index[a:a + step] = d.argmin(1)
        distance[a:a + step] = d.min(1)
    return index, distance


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(),
             "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def _rows_of(part: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(part.to_pylist()), "<i4").reshape(len(part), width).astype(np.int64)


def _first_members(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], cuts: list[int],
                   scale: int) -> Iterator[pa.RecordBatch]:
    """The parts of vectors with their entry; equal parts of one salt become one row with a count."""
    for batch in batches:
        x = whole_numbers(stacked(batch.column("v"), cuts[-1]), scale)
        salt = np.asarray(batch.column("salt"), np.int64)
        for p, book in enumerate(books):
            own = np.column_stack([salt, x[:, cuts[p]:cuts[p + 1]]])
            own, count = np.unique(own, axis=0, return_counts=True)
            entry, _ = nearest(own[:, 1:], book)
            yield _batch(MEMBERS, np.full(len(own), p), np.full(len(own), NO_ENTRY), entry, own[:, 0],
                         [r.tobytes() for r in own[:, 1:].astype("<i4")], count)


def _movers(batches: Iterator[pa.RecordBatch], later: list[list[np.ndarray]],
            cuts: list[int]) -> Iterator[pa.RecordBatch]:
    """Resident members whose nearest entry under the last codebook is another one.

    ``later`` holds the codebooks made since the members came to their owner; a
    member that an earlier one of them sent away is no longer resident.
    """
    for batch in batches:
        position, entry, salt, n = (np.asarray(batch.column(c), np.int64)
                                    for c in ("position", "entry", "salt", "n"))
        for p in np.unique(position):
            rows = np.flatnonzero(position == p)
            x = _rows_of(batch.column("part").take(pa.array(rows)), cuts[p + 1] - cuts[p])
            for books in later[:-1]:
                stay = nearest(x, books[p])[0] == entry[rows]
                rows, x = rows[stay], x[stay]
            new, _ = nearest(x, later[-1][p])
            go = new != entry[rows]
            rows, x, new = rows[go], x[go], new[go]
            if len(rows):
                yield _batch(MEMBERS, np.full(len(rows), p), entry[rows], new, salt[rows],
                             [r.tobytes() for r in x.astype("<i4")], n[rows])


def _owner_sums(batches: Iterator[pa.RecordBatch], cuts: list[int],
                entries: int) -> Iterator[pa.RecordBatch]:
    """What a task's members add to their entry and take from the one they left: count, then sums."""
    widths = np.diff(cuts)
    sums = [np.zeros((entries, w + 1), np.int64) for w in widths]
    for batch in batches:
        position, old, entry, n = (np.asarray(batch.column(c), np.int64)
                                   for c in ("position", "old", "entry", "n"))
        for p in np.unique(position):
            rows = np.flatnonzero(position == p)
            x = _rows_of(batch.column("part").take(pa.array(rows)), widths[p])
            x = np.column_stack([np.ones(len(x), np.int64), x]) * n[rows, None]
            np.add.at(sums[p], entry[rows], x)
            left = old[rows] != NO_ENTRY
            np.subtract.at(sums[p], old[rows][left], x[left])
    for p, s in enumerate(sums):
        used = np.flatnonzero(s.any(1))
        if len(used):
            yield _batch("position int, entry int, sums array<long>", np.full(len(used), p), used,
                         s[used].tolist())


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], cuts: list[int],
           scale: int) -> Iterator[pa.RecordBatch]:
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))
    names = np.array([f"{e:0{digits}x}" for e in range(len(books[0]))], object)
    for batch in batches:
        x = whole_numbers(stacked(batch.column("v"), cuts[-1]), scale)
        code, error = np.full(len(x), "", object), np.zeros(len(x), np.int64)
        for p, book in enumerate(books):
            entry, distance = nearest(x[:, cuts[p]:cuts[p + 1]], book)
            code, error = code + names[entry], error + distance
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)],
            ["id", "label", "code", "error"])


def learn_codebooks(vectors: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES,
                    rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """One array (entries x width) of whole numbers for each part of ``vectors`` (id, v).

    Every part of a vector becomes a member of its nearest entry and is shuffled once to
    the owner (position, entry, salt). Owners keep count and sum of their members. In
    each round they look at their members with the new codebook: those whose entry
    changes are the only ones that are shuffled, to the owner of the new entry, and
    sums move with them. Resident members are never written again; whether one has left in
    an earlier round is told by the codebooks since.

    Equal parts are combined before the first shuffle, and an entry has one owner for each
    OWNER_ROWS vectors of the table, so an entry that holds a third of all parts is
    spread too. The driver holds codebooks and their sums alone (entries x dimension).
    """
    cuts = [0, *np.cumsum([len(a) for a in np.array_split(np.arange(dimension), parts)]).tolist()]
    start = (vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect())
    whole = whole_numbers(np.array([r["v"] for r in start], np.float64).reshape(-1, dimension), scale)
    books = [whole[:, a:b] for a, b in zip(cuts, cuts[1:])]
    owners = 1 + vectors.count() // OWNER_ROWS
    n = shuffle_partitions(vectors.sparkSession)

    def settled(members: DataFrame) -> DataFrame:
        return written(members.repartition(n, "position", "entry", "salt"))

    def gained(members: DataFrame):
        values = (members.mapInArrow(partial(_owner_sums, cuts=cuts, entries=len(whole)),
                                     "position int, entry int, sums array<long>")
                  .select("position", "entry", F.posexplode("sums").alias("i", "s"))
                  .groupBy("position", "entry", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
        return values.collect()

    salted = vectors.select("v", F.pmod(F.xxhash64("id"), F.lit(owners)).cast("int").alias("salt"))
    tables = [settled(salted.mapInArrow(partial(_first_members, books=books, cuts=cuts, scale=scale), MEMBERS))]
    sums = [np.zeros((len(whole), b - a + 1), object) for a, b in zip(cuts, cuts[1:])]
    made = [books]
    for r in range(rounds):
        if r:
            moved = [t.mapInArrow(partial(_movers, later=made[g + 1:], cuts=cuts), MEMBERS)
                     for g, t in enumerate(tables)]
            tables.append(settled(reduce(DataFrame.union, moved)))
        change = gained(tables[-1])
        if not change:  # no member moved, so nothing will
            break
        for row in change:
            sums[row["position"]][row["entry"], row["i"]] += int(row["s"])
        made.append([np.array([[v // s[0] for v in s[1:]] if s[0] else old for s, old in zip(own, book)],
                              np.int64).reshape(book.shape) for own, book in zip(sums, made[-1])])
    for t in tables:
        discard(t)
    return made[-1]


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                 scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding",
                 label_column: str = "label") -> DataFrame:
    """Every vector as the numbers of its nearest codebook entries, one for each part.

    Components are made whole numbers, floor(scale * x), and vectors are cut in
    ``parts`` consecutive parts of equal width (the first ones one wider where it does
    not divide). The codebooks start as the parts of the ``entries`` rows with the smallest ids;
    ``rounds`` times every part goes to its nearest entry (squared Euclidean distance,
    ties to the lower number) and entries become the componentwise floor of their parts'
    mean; an entry without parts stays. Then parts are assigned once more.

    Returns ``id_column``, code (two hexadecimal digits for each part), error (squared
    distances summed over parts), ``label_column``, label_error (error summed over rows of
    equal label, nulls together), codebooks_sha256 (entries as decimal numbers by part,
    entry and place, joined by commas).

    Rows whose vector is null, empty, of another than the commonest length, or holds null
    or non-finite components take no part. Rows with equal ids count each; of those
    the start takes the smaller vectors first, and null ids last. With fewer rows than ``entries``
    there are as many entries as rows. All sums are exact; components are clipped to
    sqrt(2**62 / length) / 2 after scaling (131,072 before, with 64 of them). Other columns are ignored.
    """
    label = F.col(label_column) if label_column in vectors.columns else F.lit(None).cast("string")
    kept = (vectors.select(F.col(id_column).alias("id"), label.alias("label"),
                           F.col(vector_column).cast("array<double>").alias("v"))
            .where(finite(F.col("v"))))
    dimension = common_dimension(kept, "v")
    kept = kept.where(F.size("v") == dimension)
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"id {types['id']}, label {types['label']}, code string, error long"
    if dimension:
        books = learn_codebooks(kept.select("id", "v"), dimension, parts, entries, rounds, scale)
        cuts = [0, *np.cumsum([b.shape[1] for b in books]).tolist()]
        coded = kept.mapInArrow(partial(_codes, books=books, cuts=cuts, scale=scale), schema)
        told = ",".join(str(v) for b in books for v in b.ravel())
    else:
        coded, told = vectors.sparkSession.createDataFrame([], schema), ""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return attach_groups(coded, totals, ["label"]).select(
        F.col("id").alias(id_column), "code", "error", F.col("label").alias(label_column), "label_error",
        F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256"))
