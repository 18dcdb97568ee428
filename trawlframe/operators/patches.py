"""Spatial patches: points gathered around the richest ones.

By definition the positive points are taken one after the other, richest
first, because each moves the centre of the patch it joins. Three things keep
that from being one big task for each group:

* blocks of a group, the connected components of its occupied tiles, lie farther
  apart than the limit and are worked on their own. A centre can leave the tiles of
  its block (that of a bent patch lies in the bend), so it is looked up afterwards
  whether any centre came within the limit of another block's tiles; such blocks are
  put together and worked again. If none did, no point met a centre of another block
  that it could have joined, and the result is that of the whole group in order;
* a block is streamed in sorted order and only the centres are held in
  memory, so its size does not matter to the worker;
* points without density move no centre. They are the bulk of a survey, and
  are placed afterwards by a join with the final centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.functions import safe_div, strict_sum
from trawlframe.session import ROW_BYTES, attach_groups, cut_lineage, same_keys_join, spread


def _components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node it is connected with, of all ends of edges (a, b).

    Alternates two steps until nothing changes: neighbours above a node are tied to its
    smallest neighbour, then those below it and itself are. The number of rounds grows
    with the logarithm of the nodes, not with the length of a chain. Adaptive execution
    broadcasts the small sides of its joins and splits a node with very many neighbours.
    """
    edges, mark = cut_lineage(edges.select("a", "b").filter("a <> b").distinct()), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m"))
        large = both.join(least, "a").filter("b > a").select(
            F.col("b").alias("a"), F.least("a", "_m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("_m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        edges = cut_lineage(small.union(least.select("a", "_m")).filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                edges.select("b", "b").distinct())
        mark = now


def _relabelled(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Tiles with the blocks that edges connect put together."""
    labels = _components(edges).withColumnRenamed("node", "_block")
    return cut_lineage(tiles.join(labels, "_block", "left").withColumn(
        "_block", F.coalesce("label", "_block")).drop("label"))


def _tile_blocks(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Tiles with ``_block``, the same for tiles connected by sides or corners.

    Tiles are as wide as the limit, so points of different blocks lie farther apart.
    Rows of neighbouring tiles are numbered first; only these are nodes.
    """
    line = Window.partitionBy(*by, "_ty").orderBy("_tx")
    opens = F.when(F.col("_tx") - F.lag("_tx").over(line) == 1, 0).otherwise(1)
    runs = tiles.withColumn("_open", opens).withColumn("_run", F.sum("_open").over(line)).drop("_open")
    nodes = cut_lineage(runs.select(*by, "_ty", "_run").distinct().withColumn(
        "_block", F.monotonically_increasing_id()))
    numbered = cut_lineage(same_keys_join(runs, nodes, [*by, "_ty", "_run"]).drop("_run"))
    above = numbered.select(
        *by, F.explode(F.array(*[F.col("_tx") + i for i in (-1, 0, 1)])).alias("_tx"),
        (F.col("_ty") + 1).alias("_ty"), F.col("_block").alias("b"))
    meet = same_keys_join(numbered, above, [*by, "_tx", "_ty"], "inner")
    return _relabelled(numbered, meet.select(F.col("_block").alias("a"), "b"))


def _met_blocks(grown: DataFrame, tiles: DataFrame, by: list[str], limit: float) -> DataFrame:
    """Pairs of blocks (a, b) where a centre of a came within the limit of a tile of b."""
    boxes = grown.groupBy(*by, "_block", "_local").agg(
        *[f(c).alias(f"{n}{c}") for c in ("_cx", "_cy") for n, f in (("lo", F.min), ("hi", F.max))])

    def reached(c):
        return F.explode(F.sequence(F.floor(F.col(f"lo{c}") / limit) - 1, F.floor(F.col(f"hi{c}") / limit) + 1))

    near = boxes.withColumn("_tx", reached("_cx")).withColumn("_ty", reached("_cy")).select(
        *by, "_tx", "_ty", F.col("_block").alias("a")).distinct()
    return cut_lineage(same_keys_join(near, tiles, [*by, "_tx", "_ty"], "inner").select(
        "a", F.col("_block").alias("b")).filter("a <> b").distinct())


def spatial_patches(df: DataFrame, x: str, y: str, z: str, w: str, by: list[str],
                    limit: float = 100.0, station: str = "station",
                    merge_single_null_patch: bool = True) -> DataFrame:
    """Patch number of every point (0: without density and near no patch).

    Rows with anything missing are left out; every other row is returned, equal
    ones too. Equal densities go by station. Points with a density but no area
    weigh nothing, so they move no centre and are placed last, like those
    without density. A block (see above) is worked in order by one task, since each
    point depends on those before it.
    """
    points = cut_lineage(df.select(
        *by, station, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        F.col(z).cast("double").alias("z"), F.col(w).cast("double").alias("w"),
    ).dropna(subset=["x", "y", "z", "w"]).withColumns({
        "_tx": F.floor(F.col("x") / limit), "_ty": F.floor(F.col("y") / limit),
        "_row": F.monotonically_increasing_id(),
    }))
    positive = points.filter(F.col("z") * F.col("w") > 0)
    null = points.filter(F.col("z") * F.col("w") <= 0)

    tiles = _tile_blocks(positive.select(*by, "_tx", "_ty").distinct(), by)
    while True:
        blocked = attach_groups(positive, tiles, [*by, "_tx", "_ty"])
        # One block is one task's work, so blocks are not merged into fewer tasks.
        ordered = spread(blocked, "_block").sortWithinPartitions(
            "_block", F.col("z").desc(), F.col(station))
        schema = T.StructType([
            *ordered.schema.fields, T.StructField("_local", T.IntegerType()),
            *[T.StructField(c, T.DoubleType()) for c in ("_cx", "_cy")]])
        # The numbering below and the result must see the same run.
        grown = cut_lineage(ordered.mapInPandas(_grower(["_block"], limit), schema))
        met = _met_blocks(grown, tiles, by, limit)
        if met.isEmpty():
            break
        tiles = _relabelled(tiles, met)

    local = [*by, "_block", "_local"]
    q = F.col("z") * F.col("w")
    centres = grown.groupBy(*local).agg(
        safe_div(F.sum(q * F.col("x")), F.sum(q)).alias("cx"),
        safe_div(F.sum(q * F.col("y")), F.sum(q)).alias("cy"),
        F.min(F.struct(-F.col("z"), F.col(station))).alias("_seed"),
    )
    # Patches are numbered in the order their first points come up. A patch
    # takes room, so a group has few of them.
    opened = Window.partitionBy(*by).orderBy("_seed")
    centres = centres.withColumn("patch", F.row_number().over(opened))
    numbered = attach_groups(grown, centres.select(*local, "patch"), local)
    return numbered.select(*by, station, "x", "y", "z", "w", "patch").unionByName(
        _place_null(null, centres, by, station, limit, merge_single_null_patch))


def _place_null(null, centres, by, station, limit, merge_single) -> DataFrame:
    near = centres.select(
        *by, "patch", "cx", "cy",
        F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_i"),
        F.floor(F.col("cx") / limit).alias("_cx"), F.floor(F.col("cy") / limit).alias("_cy"),
    ).withColumn("_j", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select(
        *by, "patch", "cx", "cy",
        (F.col("_cx") + F.col("_i")).alias("_tx"), (F.col("_cy") + F.col("_j")).alias("_ty"),
    )
    # The centres around a tile are one row, so every point finds its nearest by itself.
    near = near.groupBy(*by, "_tx", "_ty").agg(F.collect_list(F.struct("cx", "cy", "patch")).alias("_near"))
    pairs = attach_groups(null, near, [*by, "_tx", "_ty"], row_bytes=8 * ROW_BYTES)
    distances = F.transform("_near", lambda c: F.struct(
        F.sqrt(F.pow(F.col("x") - c["cx"], 2) + F.pow(F.col("y") - c["cy"], 2)).alias("d"),
        c["patch"].alias("patch")))
    best = F.array_min(F.filter(distances, lambda c: c["d"] < limit))
    placed = pairs.select(*by, station, "x", "y", "z", "w", F.coalesce(best["patch"], F.lit(0)).alias("patch"))
    if merge_single:
        return placed
    alone = placed.groupBy(*by).agg(F.count_if(F.col("patch") == 0).alias("_alone"))
    last = centres.groupBy(*by).agg(F.max("patch").alias("_last"))
    placed = attach_groups(placed, same_keys_join(alone, last, by), by)
    single = (F.col("patch") == 0) & (F.col("_alone") == 1)
    return placed.withColumn(
        "patch", F.when(single, F.coalesce("_last", F.lit(0)) + 1).otherwise(F.col("patch"))
    ).drop("_alone", "_last")


def _grower(keys: list[str], limit: float):
    """Assign sorted points to patches, keeping the centres of one block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sums, n = None, np.zeros((16, 3)), 0
        for batch in batches:
            labels, centres = np.zeros(len(batch), dtype=np.int32), np.zeros((len(batch), 2))
            marks = list(zip(*[batch[k].tolist() for k in keys]))
            xs, ys = batch["x"].to_numpy(), batch["y"].to_numpy()
            qs = batch["z"].to_numpy() * batch["w"].to_numpy()
            for i, mark in enumerate(marks):
                if mark != current:
                    current, n = mark, 0
                chosen = n
                if n:
                    q = sums[:n, 0]
                    d = np.hypot(sums[:n, 1] / q - xs[i], sums[:n, 2] / q - ys[i])
                    nearest = int(d.argmin())
                    if d[nearest] < limit:
                        chosen = nearest
                if chosen == n:
                    if n == len(sums):
                        sums = np.vstack([sums, np.zeros_like(sums)])
                    sums[n] = 0.0
                    n += 1
                sums[chosen] += (qs[i], qs[i] * xs[i], qs[i] * ys[i])
                labels[i] = chosen + 1
                centres[i] = sums[chosen, 1:] / sums[chosen, 0]
            yield batch.assign(_local=labels, _cx=centres[:, 0], _cy=centres[:, 1])

    return run


def patch_summary(patches: DataFrame, by: list[str], min_share: float = 10.0,
                  digits: int = 2) -> DataFrame:
    """Centre, share of abundance (%) and of area of each patch.

    ``n_patches_over`` counts the patches holding ``min_share`` % or more,
    ``max_patch_over`` is the highest number among them.
    """
    q = F.col("z") * F.col("w")
    # One row for each patch, read by both totals and by the result.
    each = cut_lineage(patches.groupBy(*by, "patch").agg(
        safe_div(F.sum(q * F.col("x")), F.sum(q)).alias("xg"),
        safe_div(F.sum(q * F.col("y")), F.sum(q)).alias("yg"),
        F.sum(q).alias("_q"), F.sum("w").alias("_w"),
    ))
    totals = each.groupBy(*by).agg(strict_sum("_q").alias("_tq"), strict_sum("_w").alias("_tw"))
    each = attach_groups(each, totals, by).withColumns({
        "_share": safe_div("_q", "_tq") * 100.0, "parea": safe_div("_w", "_tw"),
    })
    over = (F.col("_share") >= min_share) & (F.col("patch") > 0)
    counts = each.groupBy(*by).agg(
        F.count_if(over).alias("n_patches_over"),
        F.max(F.when(over, F.col("patch"))).alias("max_patch_over"),
    )
    return attach_groups(each, counts, by).select(
        *by, "patch", "xg", "yg", F.round("_share", digits).alias("pabun"), "parea",
        "n_patches_over", "max_patch_over")
