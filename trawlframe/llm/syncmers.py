"""Document fingerprints of closed syncmers, and their likeness."""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.common import shuffle_partitions, slices
from trawlframe.llm.words import mixed

# Code points in an anchor, and in the inner piece whose place decides; one window in
# 2 / (ANCHOR - INNER + 1) is an anchor on average.
ANCHOR, INNER = 40, 9
SLICES_PER_PARTITION = 8
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1) - 1, base, np.uint64)]))


def anchors(texts: list[str], size: int = ANCHOR, inner: int = INNER) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, 32-bit hashes) of the closed syncmers of each text, in order.

    A window of ``size`` code points is an anchor if the smallest hash of its inner
    pieces stands first or last. That depends on the window alone, so equal stretches
    of text have equal anchors wherever they stand. A text with no anchor, as one too
    short, has its own hash at 0; an empty text has none.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n, window = len(points), size - inner + 1
    positions, hashes = np.empty(0, np.int64), np.empty(0, np.uint64)
    if n >= size:
        forward, backward = _powers(_BASE, n), _powers(_INVERSE, n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((points + np.uint64(1)) * forward)])
        pieces = mixed((sums[inner:] - sums[:-inner]) * backward[:n - inner + 1])
        low, width = pieces, 1
        while width < window:
            step = min(width, window - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        chosen = (pieces[:len(low)] == low) | (pieces[window - 1:] == low)
        crossing = np.zeros(n + 1, np.int64)  # windows that reach into the next text
        np.add.at(crossing, np.maximum(ends - lengths, ends - size + 1), 1)
        np.add.at(crossing, ends, -1)
        chosen &= np.cumsum(crossing)[:len(low)] == 0
        positions = np.flatnonzero(chosen)
        hashes = mixed((sums[positions + size] - sums[positions]) * backward[positions]) >> np.uint64(32)
    hashes = hashes.astype(np.uint32)
    cuts = np.searchsorted(positions, np.concatenate([[0], ends]))
    out = []
    for i, text in enumerate(texts):
        at, found = positions[cuts[i]:cuts[i + 1]] - (ends[i] - lengths[i]), hashes[cuts[i]:cuts[i + 1]]
        if not len(at) and text:
            whole = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
            at, found = np.zeros(1, np.int64), np.frombuffer(whole, np.uint32)
        out.append((at, found))
    return out


def written(hashes: np.ndarray) -> str:
    """The fingerprint: eight hexadecimal digits for each anchor, in order."""
    return hashes.astype(">u4").tobytes().hex()


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Each hash with the number of its equals before it."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    times = np.empty(len(hashes), np.uint64)
    times[order] = np.arange(len(hashes)) - np.searchsorted(ordered, ordered)
    return hashes.astype(np.uint64) << np.uint64(32) | times


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the longest run of anchors that both have in the same order, by all anchors.

    1 for equal fingerprints (two empty ones too), 0 without a common anchor.
    """
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b) or set(a.tolist()).isdisjoint(b.tolist()):
        return 0.0
    _, in_a, in_b = np.intersect1d(_numbered(a), _numbered(b), assume_unique=True, return_indices=True)
    tails: list[int] = []
    for place in in_b[np.argsort(in_a)].tolist():
        at = bisect_left(tails, place)
        tails[at:at + 1] = [place]
    return 2 * len(tails) / (len(a) + len(b))


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, positions and hashes of the anchors, and the fingerprint of every whole text.

    One narrow pass. A null text counts as empty; repeated rows and null ids are kept;
    other columns are ignored.
    """
    source = docs.select(F.col(id_column), F.coalesce(text_column, F.lit("")).alias("_text"))
    id_type = source.schema[0].dataType.simpleString()

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts]):
                found = anchors(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([p for p, _ in found], pa.list_(pa.int64())),
                     pa.array([h.astype(np.int64) for _, h in found], pa.list_(pa.int64())),
                     pa.array([written(h) for _, h in found])],
                    [id_column, "positions", "hashes", "fingerprint"])

    return source.mapInArrow(
        work, f"`{id_column}` {id_type}, positions array<long>, hashes array<long>, fingerprint string")


def _in_order(source: DataFrame) -> DataFrame:
    """Rows in ascending (id, text), in slices that end with the row that follows them.

    About SLICES_PER_PARTITION slices for each shuffle partition begin at ids chosen by
    a hash, which the driver sees. The first row of a slice also goes to the slice
    before it as its ``tail``, that of the whole table to the last slice, so the text
    is shuffled once and no task needs another's rows.
    """
    spark = source.sparkSession
    n = shuffle_partitions(spark)
    ids = source.select("_id")
    total, least, nulls = ids.select(F.count(F.lit(1)), F.min("_id"), F.count_if(F.col("_id").isNull())).first()
    every = max(1, total // (SLICES_PER_PARTITION * n))
    starts = np.array(sorted(r[0] for r in ids.where("_id is not null").where(
        F.pmod(F.xxhash64("_id"), F.lit(every)) == 0).distinct().collect()), np.int64)

    @F.pandas_udf("array<int>")
    def slices_of(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        number = values.fillna(0).to_numpy(np.int64)
        own = np.where(known, np.searchsorted(starts, number, side="right"), 0)
        begins = known & np.isin(number, starts)
        leads = ~known if nulls else known & (number == least)
        return pd.Series([[int(s)] + [int(s) - 1] * bool(x) + [len(starts)] * bool(y)
                          for s, x, y in zip(own, begins, leads)], dtype=object)

    # A null id must reach the function as a null, not as a float.
    placed = source.select("*", F.posexplode(slices_of(F.col("_id").cast("long"))).alias("_tail", "_slice"))
    return (placed.repartition(n, "_slice")
            .sortWithinPartitions("_slice", F.col("_tail") > 0, F.col("_id").asc_nulls_first(), "_text"))


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    The edited text has the last floor(n / 2) code points replaced by the first as
    many, or all, of the next document in ascending (id, text), nulls first; after the
    last comes the first, and a single document follows itself. ``id_column`` holds whole numbers.
    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text counts as empty; equal rows follow each other and are
    returned one by one; other columns are ignored.
    """
    source = docs.select(F.col(id_column).alias("_id"), F.coalesce(text_column, F.lit("")).alias("_text"))
    id_type = source.schema[0].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finished(pairs):
        edited = [text[:len(text) - len(text) // 2] + after[:len(text) // 2]
                  for _, text, _, after, _ in pairs]
        rows = []
        for (key, text, own, _, following), new, (_, new_hashes) in zip(pairs, edited, anchors(edited)):
            rows.append((key, len(text), sha256(new.encode("utf-8")).hexdigest(), written(own),
                         written(new_hashes), likeness(own, new_hashes), likeness(own, following)))
        return pa.RecordBatch.from_arrays([
            pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else None,
             pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(batches):
        last = None  # the row that still waits for the next: slice, is it a tail, id, text, hashes
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            texts = columns[1]
            for a, b in slices([len(t) for t in texts]):
                pairs = []
                found = anchors(texts[a:b])
                for i in range(a, b):
                    row = (columns[3][i], columns[2][i] > 0, columns[0][i], texts[i], found[i - a][1])
                    if last is not None and not last[1] and last[0] == row[0]:
                        pairs.append((last[2], last[3], last[4], row[3], row[4]))
                    last = row
                if pairs:
                    yield finished(pairs)

    out = _in_order(source).mapInArrow(
        work, f"id {id_type}, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_column)
