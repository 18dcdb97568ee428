"""Squares of positions split by content, and pairs of them without a list of pairs of positions.

Positions of a group fall in squares as wide as the largest distance asked for; a
square with more than ``TILE_POSITIONS`` positions is quartered again and again until no
part has more. Only a square and its four forward neighbours can hold a pair. Pairs of squares are
opened level by level: one that lies too far apart is dropped, one that can be summed from
its moments is, and only what is left at the leaves meets position by position.

Everything here is a table: a crowded square is many small leaves, never one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlframe.session import attach_groups, cut_lineage, same_keys_join

# A leaf holds at most so many positions (unless they lie within width / 2**DEPTH of each other).
TILE_POSITIONS = 256
DEPTH, STEP = 30, 3
# Pairs of positions a task holds at once (or those of one pair of leaves).
PAIRS_AT_ONCE = 500_000

PLACE = ["_tx", "_ty", "_k", "_cx", "_cy"]
FORWARD = ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))

# Distances of two squares are summed by a Taylor polynomial of this order where the
# squares' radii are at most this share of the distance of their centres: 1e-10 of the sum.
ORDER, NEAR_SHARE = 12, 0.2
POWERS = [(i, j) for i in range(ORDER + 1) for j in range(ORDER + 1 - i)]


def _shifted(column: str, level) -> Column:
    return F.call_function("shiftrightunsigned", F.col(column), level if isinstance(level, Column) else F.lit(level))


def split_positions(spots: DataFrame, by: list[str], width: float,
                    most: int = TILE_POSITIONS) -> tuple[DataFrame, int]:
    """(spots with the leaf they fall in, levels of the deepest square that was quartered).

    ``spots`` has distinct positions (x, y). A leaf is told by the square (_tx, _ty),
    its level _k and its column and row (_cx, _cy) among 2**_k x 2**_k. Squares are
    counted STEP levels at a time, and only the positions of full ones are counted again.
    """
    last = F.lit(2 ** DEPTH - 1)
    fine = [F.least(F.floor((F.col(c) / width - F.floor(F.col(c) / width)) * 2.0 ** DEPTH), last).alias(f)
            for c, f in (("x", "_fx"), ("y", "_fy"))]
    rows = spots.select("*", F.floor(F.col("x") / width).alias("_tx"), F.floor(F.col("y") / width).alias("_ty"),
                        *fine).withColumn("_k", F.lit(0))
    counts = rows.groupBy(*by, "_tx", "_ty").agg(F.count(F.lit(1)).alias("_n"))
    full = cut_lineage(counts.where(F.col("_n") > most).select(
        *by, "_tx", "_ty", F.lit(0).cast("bigint").alias("_cx"), F.lit(0).cast("bigint").alias("_cy")))
    level, deepest = 0, 0
    while level < DEPTH and not full.isEmpty():
        step = min(STEP, DEPTH - level)
        bottom = level + step
        node = [*by, "_tx", "_ty", "_cx", "_cy"]
        live = rows.withColumns({"_cx": _shifted("_fx", DEPTH - level), "_cy": _shifted("_fy", DEPTH - level)})
        live = attach_groups(live, full.withColumn("_full", F.lit(True)), node).where("_full")
        cells = live.withColumns({"_cx": _shifted("_fx", DEPTH - bottom), "_cy": _shifted("_fy", DEPTH - bottom)}
                                 ).groupBy(*node).agg(F.count(F.lit(1)).alias("_n"))
        # A quarter has at most 4**step cells: windows of bounded size.
        leaf = F.lit(None).cast("int")
        for up in range(step):
            inside = Window.partitionBy(*by, "_tx", "_ty", _shifted("_cx", up), _shifted("_cy", up))
            leaf = F.when(F.sum("_n").over(inside) <= most, F.lit(bottom - up)).otherwise(leaf)
        cells = cut_lineage(cells.withColumn("_leaf", leaf))
        full = cells.where(F.col("_leaf").isNull()).select(*node)
        at_bottom = rows.withColumns({"_cx": _shifted("_fx", DEPTH - bottom), "_cy": _shifted("_fy", DEPTH - bottom)})
        settled = cells.select(*node, F.coalesce("_leaf", F.lit(bottom)).alias("_leaf"))
        rows = attach_groups(at_bottom, settled, node).withColumn("_k", F.coalesce("_leaf", "_k")).drop(
            "_leaf", "_cx", "_cy")
        deepest, level = bottom, bottom
    left = F.lit(DEPTH) - F.col("_k")
    return rows.withColumns({"_cx": _shifted("_fx", left), "_cy": _shifted("_fy", left)}).drop("_fx", "_fy"), deepest


def _key(by: list[str]) -> Column:
    return F.struct(*by, *PLACE)


def _root(by: list[str], tx, ty) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(*by, tx.alias("_tx"), ty.alias("_ty"), F.lit(0).alias("_k"), zero.alias("_cx"), zero.alias("_cy"))


def _parent(at: str, by: list[str]) -> Column:
    up = [F.col(f"{at}.{c}") for c in (*by, "_tx", "_ty")]
    return F.struct(*up, (F.col(f"{at}._k") - 1).alias("_k"), _shifted(f"{at}._cx", 1).alias("_cx"),
                    _shifted(f"{at}._cy", 1).alias("_cy"))


# -- summaries of squares ---------------------------------------------------------------

SUMMARY = "n double, m double, ss double, x0 double, x1 double, y0 double, y1 double, mu array<double>"


def _quarter_maps() -> np.ndarray:
    """Moments of a quarter, in its own half widths, as its share of the whole's: one matrix for each."""
    maps = np.zeros((4, len(POWERS), len(POWERS)))
    for q in range(4):
        sx, sy = 2 * (q & 1) - 1, 2 * (q >> 1) - 1
        for r, (i, j) in enumerate(POWERS):
            for c, (a, b) in enumerate(POWERS):
                if a <= i and b <= j:
                    maps[q, r, c] = comb(i, a) * comb(j, b) * sx ** (i - a) * sy ** (j - b) / 2.0 ** (i + j)
    return maps


def _fields(array: pa.Array) -> dict[str, np.ndarray]:
    return {f.name: np.asarray(array.field(i)) for i, f in enumerate(array.type)}


def _merged(start: np.ndarray, n, m, ss) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sum of squares about it of runs of rows that begin at ``start``."""
    size = np.diff(np.append(start, len(n)))
    total = np.add.reduceat(n, start)
    mean = np.add.reduceat(n * m, start) / total
    return total, mean, np.add.reduceat(ss + n * np.square(m - np.repeat(mean, size)), start)


def _summary_batch(batch: pa.RecordBatch, columns: list[np.ndarray], moments: np.ndarray) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in SUMMARY.split(", ")]
    return pa.RecordBatch.from_arrays(
        [batch.column("at"), *[pa.array(c) for c in columns], pa.array(moments.tolist(), pa.list_(pa.float64()))],
        ["at", *names])


def _leaf_summaries(batches: Iterator[pa.RecordBatch], width: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("points")
        if not len(lists):
            continue
        at, p = _fields(batch.column("at")), _fields(lists.flatten())
        size = np.asarray(lists.value_lengths(), np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        side = width / 2.0 ** at["_k"]
        scaled = [(p[c] - np.repeat((at[t] + (at[s] + 0.5) / 2.0 ** at["_k"]) * width, size)) / np.repeat(side / 2, size)
                  for c, t, s in (("x", "_tx", "_cx"), ("y", "_ty", "_cy"))]
        moments = np.stack([np.add.reduceat(p["n"] * scaled[0] ** i * scaled[1] ** j, start) for i, j in POWERS], 1)
        box = [f.reduceat(p[c], start) for c in "xy" for f in (np.minimum, np.maximum)]
        yield _summary_batch(batch, [*_merged(start, p["n"], p["m"], p["ss"]), *box], moments)


def _parent_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maps = _quarter_maps()
    for batch in batches:
        lists = batch.column("parts")
        if not len(lists):
            continue
        parts = lists.flatten()
        p = {f.name: parts.field(i) for i, f in enumerate(parts.type)}
        n, m, ss, x0, x1, y0, y1, quarter = (np.asarray(p[c]) for c in ("n", "m", "ss", "x0", "x1", "y0", "y1", "quarter"))
        start = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))[:-1]])
        moments = np.asarray(p["mu"].flatten()).reshape(len(n), len(POWERS))
        moments = np.einsum("nrc,nc->nr", maps[quarter], moments)
        box = [f.reduceat(c, start) for f, c in
               ((np.minimum, x0), (np.maximum, x1), (np.minimum, y0), (np.maximum, y1))]
        yield _summary_batch(batch, [*_merged(start, n, m, ss), *box], np.add.reduceat(moments, start, axis=0))


def tile_tree(leaves: DataFrame, by: list[str], width: float, deepest: int) -> DataFrame:
    """(at, is_leaf, summary of count, values, box and moments of place) of every leaf and square above."""
    kind = leaves.schema["at"].dataType.simpleString()
    nodes = leaves.select("at", "points").mapInArrow(partial(_leaf_summaries, width=width), f"at {kind}, {SUMMARY}")
    nodes = cut_lineage(nodes.withColumn("is_leaf", F.lit(True)))
    names = [c.split(" ")[0] for c in SUMMARY.split(", ")]
    for level in range(deepest, 0, -1):
        quarter = (F.col("at._cx") % 2 + 2 * (F.col("at._cy") % 2)).cast("int").alias("quarter")
        above = (nodes.where(F.col("at._k") == level)
                 .groupBy(_parent("at", by).alias("parent")).agg(F.collect_list(F.struct(*names, quarter)).alias("parts"))
                 .withColumnRenamed("parent", "at").mapInArrow(_parent_summaries, f"at {kind}, {SUMMARY}"))
        nodes = cut_lineage(nodes.unionByName(above.withColumn("is_leaf", F.lit(False))))
    return nodes


# -- pairs of squares ---------------------------------------------------------------------

def _sum_of_distances(dx, dy, half_a, half_b, mu_a, mu_b) -> np.ndarray:
    """Sum over all pairs of |b - a| from the moments of both squares: a Taylor polynomial.

    With D between the centres and t the rest, |D + t| is the root of
    |D|^2 + 2 D.t + |t|^2; its terms of each degree follow from those below.
    """
    far = np.hypot(dx, dy)
    root = [np.stack([far], 1)]
    for k in range(1, ORDER + 1):
        term = np.zeros((len(far), k + 1))  # the place j holds tx^(k-j) ty^j
        if k == 1:
            term[:, 0], term[:, 1] = 2 * dx, 2 * dy
        if k == 2:
            term[:, 0] = term[:, 2] = 1.0
        for low in range(1, k):
            for i in range(low + 1):
                term[:, i:i + k - low + 1] -= root[low][:, i:i + 1] * root[k - low]
        root.append(term / (2 * far)[:, None])
    index = {p: c for c, p in enumerate(POWERS)}
    out = np.zeros(len(far))
    for i, j in POWERS:
        moment = np.zeros(len(far))
        for a in range(i + 1):
            for b in range(j + 1):
                moment += (comb(i, a) * comb(j, b) * (-half_a) ** (a + b) * half_b ** (i + j - a - b)
                           * mu_a[:, index[a, b]] * mu_b[:, index[i - a, j - b]])
        out += root[i + j][:, j] * moment
    return out


def bin_of(distance: np.ndarray, bin_width: float) -> np.ndarray:
    return np.maximum(np.ceil(np.round(distance / bin_width, 9)), 1).astype(np.int64)


def _judged(batches: Iterator[pa.RecordBatch], width: float, max_dist: float,
            bin_width: float | None) -> Iterator[pa.RecordBatch]:
    """What becomes of a pair of squares: 'sum' with its sums, 'open', 'meet', or dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [_fields(batch.column(c)) for c in "ab"]
        side = [batch.column(c) for c in ("sa", "sb")]
        s = [{f.name: side[k].field(i) for i, f in enumerate(side[k].type)} for k in (0, 1)]
        box = [{c: np.asarray(s[k][c]) for c in ("x0", "x1", "y0", "y1")} for k in (0, 1)]
        gap = [np.maximum.reduce([box[0][f"{c}0"] - box[1][f"{c}1"], box[1][f"{c}0"] - box[0][f"{c}1"],
                                  np.zeros(batch.num_rows)]) for c in "xy"]
        reach = [np.maximum(box[0][f"{c}1"], box[1][f"{c}1"]) - np.minimum(box[0][f"{c}0"], box[1][f"{c}0"]) for c in "xy"]
        nearest, farthest = np.hypot(*gap) * (1 - 1e-12), np.hypot(*reach) * (1 + 1e-12)
        own = np.asarray(batch.column("own"))
        near = nearest <= max_dist
        leaf = [np.asarray(s[k]["is_leaf"]) for k in (0, 1)]
        n, m, ss = ([np.asarray(s[k][c]) for k in (0, 1)] for c in ("n", "m", "ss"))
        half = [width / 2.0 ** key[k]["_k"] / 2 for k in (0, 1)]
        centre = [[(key[k][t] + (key[k][c] + 0.5) / 2.0 ** key[k]["_k"]) * width for k in (0, 1)]
                  for t, c in (("_tx", "_cx"), ("_ty", "_cy"))]
        dx, dy = centre[0][1] - centre[0][0], centre[1][1] - centre[1][0]
        closed = np.zeros(batch.num_rows, bool)
        sums = np.zeros((batch.num_rows, 3))
        bins = np.zeros(batch.num_rows, np.int64)
        if bin_width is not None:
            bins = bin_of(nearest, bin_width)
            closed = (near & ~own & (farthest <= max_dist) & (bins == bin_of(farthest, bin_width))
                      & (np.sqrt(2) * (half[0] + half[1]) <= NEAR_SHARE * np.hypot(dx, dy)))
            at = np.flatnonzero(closed)
            if len(at):
                mu = [np.asarray(s[k]["mu"].take(pa.array(at)).flatten()).reshape(len(at), len(POWERS)) for k in (0, 1)]
                sums[at, 0] = n[0][at] * n[1][at]
                sums[at, 1] = _sum_of_distances(dx[at], dy[at], half[0][at], half[1][at], *mu)
                sums[at, 2] = ((n[1] * ss[0] + n[0] * ss[1] + n[0] * n[1] * np.square(m[0] - m[1])) / 2)[at]
        what = np.where(closed, "sum", np.where(leaf[0] & leaf[1], "meet", "open"))
        keep = pa.array(np.flatnonzero(near))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").take(keep), batch.column("b").take(keep), pa.array(what).take(keep),
             pa.array(bins.astype(np.int32)).take(keep), *[pa.array(sums[:, c]).take(keep) for c in range(3)]],
            ["a", "b", "what", "bin", "pairs", "distances", "halves"])


class PairedTiles:
    """Pairs of leaves that meet and what was summed before.

    ``rows``: (group, own, left points, right points), own for a leaf with itself;
    ``sums``: (at, bin, pairs, distances, halves) of pairs of squares that lie whole within
    one distance class, or None.
    """

    def __init__(self, rows: DataFrame, sums: DataFrame | None, by: list[str]):
        self.rows, self.sums, self.by = rows, sums, by


def _ahead(squares: DataFrame, by: list[str], *more: str) -> DataFrame:
    """Each square once for itself and for each of the four behind it, whose place it is given."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in FORWARD]))
    return squares.withColumn("o", around).select(
        *by, (F.col("_tx") - F.col("o.i")).alias("_tx"), (F.col("_ty") - F.col("o.j")).alias("_ty"),
        ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"), F.col("_tx").alias("_bx"),
        F.col("_ty").alias("_by"), *more)


def paired_tiles(spots: DataFrame, by: list[str], max_dist: float, bin_width: float | None = None,
                 most: int = TILE_POSITIONS) -> PairedTiles:
    """Pairs of leaves that may hold positions up to ``max_dist`` apart.

    ``spots``: group columns, x, y and the n, m, ss of the rows there. With
    ``bin_width`` a pair of squares that lies whole in one class is summed at once.
    """
    spots = cut_lineage(spots)
    placed, deepest = split_positions(spots, by, max_dist, most)
    leaves = cut_lineage(placed.groupBy(_key(by).alias("at")).agg(
        F.collect_list(F.struct("x", "y", "n", "m", "ss")).alias("points")))
    place = [F.col(f"at.{c}").alias(c) for c in (*by, "_tx", "_ty")]
    if not deepest:  # no square was quartered: every one is a leaf and meets those ahead
        whole = leaves.select(*place, "points")
        others = _ahead(whole, by, "points").withColumnRenamed("points", "right")
        met = same_keys_join(whole.withColumnRenamed("points", "left"), others, [*by, "_tx", "_ty"], "inner")
        return PairedTiles(met.select(*by, "own", "left", "right"), None, by)
    roots = leaves.select(*place).distinct()
    frontier = same_keys_join(roots, _ahead(roots, by), [*by, "_tx", "_ty"], "inner").select(
        _root(by, F.col("_tx"), F.col("_ty")).alias("a"), _root(by, F.col("_bx"), F.col("_by")).alias("b"))
    nodes = tile_tree(leaves, by, max_dist, deepest)
    kind = nodes.schema["at"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, what string, bin int, pairs double, distances double, halves double"
    summary = F.struct("is_leaf", *[c.split(" ")[0] for c in SUMMARY.split(", ")])
    # A leaf stands for itself where its partner is opened.
    below = nodes.where(F.col("at._k") > 0).select(_parent("at", by).alias("up"), F.col("at").alias("down")).unionByName(
        nodes.where("is_leaf").select(F.col("at").alias("up"), F.col("at").alias("down")))
    meets, sums = [], []
    while True:
        judged = cut_lineage(
            frontier.join(nodes.select(F.col("at").alias("a"), summary.alias("sa")), "a")
            .join(nodes.select(F.col("at").alias("b"), summary.alias("sb")), "b")
            .withColumn("own", F.col("a") == F.col("b"))
            .mapInArrow(partial(_judged, width=max_dist, max_dist=max_dist, bin_width=bin_width), schema))
        meets.append(judged.where("what = 'meet'").select("a", "b"))
        sums.append(judged.where("what = 'sum'").select(F.col("a").alias("at"), "bin", "pairs", "distances", "halves"))
        opened = judged.where("what = 'open'").select("a", "b")
        if opened.isEmpty():
            break
        frontier = (opened.join(below.select(F.col("up").alias("a"), F.col("down").alias("da")), "a")
                    .join(below.select(F.col("up").alias("b"), F.col("down").alias("db")), "b")
                    .where((F.col("a") != F.col("b")) | (F.col("da") <= F.col("db")))
                    .select(F.col("da").alias("a"), F.col("db").alias("b")))
    meet, total = meets[0], sums[0]
    for m, s in zip(meets[1:], sums[1:]):
        meet, total = meet.unionByName(m), total.unionByName(s)
    left = leaves.select(F.col("at").alias("a"), F.col("points").alias("left"))
    right = leaves.select(F.col("at").alias("b"), F.col("points").alias("right"))
    rows = meet.join(left, "a").join(right, "b").select(
        *[F.col(f"a.{c}").alias(c) for c in by], (F.col("a") == F.col("b")).alias("own"), "left", "right")
    return PairedTiles(rows, total if bin_width is not None else None, by)


def _chunks(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of rows whose sizes add up to about ``limit``."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield slice(start, stop)
        start = stop


def _side(lists: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The fields of all points of a batch, where each row's begin, and how many they are."""
    size = np.asarray(lists.value_lengths(), np.int64)
    return _fields(lists.flatten()), np.cumsum(size) - size, size


def _binned(batches: Iterator[pa.RecordBatch], by: list[str], max_dist: float,
            bin_width: float) -> Iterator[pa.RecordBatch]:
    """Sums of a task by group and distance class over the pairs of leaves that meet."""
    codes: dict[tuple, int] = {}
    classes = int(bin_of(np.array([max_dist]), bin_width)[0]) + 1
    sums, kinds = np.zeros((3, 0)), None

    def add(code: np.ndarray, bins: np.ndarray, *values: np.ndarray) -> None:
        at = code * classes + bins
        for k, v in enumerate(values):
            sums[k] += np.bincount(at, v, sums.shape[1])

    for batch in batches:
        kinds = [batch.schema.field(c).type for c in by]
        if not batch.num_rows:
            continue
        names = zip(*[batch.column(c).to_pylist() for c in by]) if by else [()] * batch.num_rows
        code = np.array([codes.setdefault(name, len(codes)) for name in names])
        sums = np.pad(sums, ((0, 0), (0, len(codes) * classes - sums.shape[1])))
        own = np.asarray(batch.column("own"))
        (l, from_l, len_l), (r, from_r, len_r) = _side(batch.column("left")), _side(batch.column("right"))
        for rows in _chunks(len_l * len_r, PAIRS_AT_ONCE):
            size = len_l[rows] * len_r[rows]
            row = np.repeat(np.arange(rows.start, rows.stop), size)
            k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            i, j = np.divmod(k, len_r[row])
            use = ~own[row] | (i < j)
            row, i, j = row[use], from_l[row[use]] + i[use], from_r[row[use]] + j[use]
            d = np.sqrt(np.square(r["x"][j] - l["x"][i]) + np.square(r["y"][j] - l["y"][i]))
            near = d <= max_dist
            d, i, j, row = d[near], i[near], j[near], row[near]
            w = l["n"][i] * r["n"][j]
            h = (r["n"][j] * l["ss"][i] + l["n"][i] * r["ss"][j] + w * np.square(r["m"][j] - l["m"][i])) / 2.0
            add(code[row], bin_of(d, bin_width), w, w * d, h)
        # Rows at one position: distance 0, the first class.
        at_home = np.repeat(own, len_l)
        n, ss = l["n"][at_home], l["ss"][at_home]
        add(np.repeat(code, len_l)[at_home], np.ones(len(n), np.int64), n * (n - 1) / 2, 0.0 * n, n * ss / 2)
    filled = np.flatnonzero(sums[0])
    if len(filled):
        names = list(codes)
        columns = [pa.array([names[c // classes][j] for c in filled], kinds[j]) for j in range(len(by))]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array((filled % classes).astype(np.int32)), *[pa.array(s[filled]) for s in sums]],
            [*by, "bin", "pairs", "distances", "halves"])


def binned_sums(tiles: PairedTiles, max_dist: float, bin_width: float) -> DataFrame:
    """Group, bin, and the number, distances and half squared differences of its row pairs."""
    by = tiles.by
    rows = tiles.rows
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    met = rows.mapInArrow(partial(_binned, by=by, max_dist=max_dist, bin_width=bin_width),
                          f"{kinds}bin int, pairs double, distances double, halves double")
    if tiles.sums is not None:
        met = met.unionByName(tiles.sums.select(
            *[F.col(f"at.{c}").alias(c) for c in by], "bin", "pairs", "distances", "halves"))
    return met.groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in ("pairs", "distances", "halves")])
