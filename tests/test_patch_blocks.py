"""Blocks of the patch search: connected tiles, put together where a centre leaves its own."""

import math
import random

import pytest
from pyspark.sql import functions as F

from test_brute_force import COLS, greedy_patches
from trawlframe.operators import patches


def found(spark, rows, limit):
    got = patches.spatial_patches(spark.createDataFrame(rows, COLS), "x", "y", "z", "w", ["g"], limit)
    return {(r.g, r.station): r.patch for r in got.collect()}


def wanted(rows, limit):
    out = {}
    for g in {r[0] for r in rows}:
        own = greedy_patches([r for r in rows if r[0] == g], limit)
        out |= {(g, s): p for s, p in own.items()}
    return out


# The centre of the first four moves out of their tiles to within the limit of the fifth.
BENT = [(1, 1, -1.05, -1.05, 5.0, 1.0), (1, 2, -1.05, -0.15, 4.99, 1.0), (1, 3, -0.2, -1.05, 4.98, 1.0),
        (1, 4, -0.05, -1.01, 4.97, 3.0), (1, 5, 0.01, 0.01, 4.9, 1.0), (1, 6, 9.0, 9.0, 4.0, 1.0)]


def test_a_centre_that_leaves_its_tiles_joins_the_blocks(spark):
    points = spark.createDataFrame(BENT, COLS).select(
        "g", *[F.floor(c).alias(f"_t{c}") for c in "xy"])
    blocks = patches._tile_blocks(points.distinct(), ["g"])
    assert blocks.select("_block").distinct().count() == 3
    got = found(spark, BENT, 1.0)
    assert got == wanted(BENT, 1.0)
    assert got[1, 5] == got[1, 4] != got[1, 6]


def test_rings_and_diagonals_split_and_equal_the_rule(spark):
    rnd = random.Random(21)
    rows = []
    for k in range(90):  # two rings, one inside the other, in the first group; diagonals in the second
        at, radius = rnd.uniform(0, 2 * math.pi), 8.0 if k % 3 else 3.0
        rows.append((1, k, radius * math.cos(at), radius * math.sin(at), rnd.uniform(1, 9), 1.0))
        step, shift = rnd.uniform(0, 12), 6.0 * (k % 2)
        rows.append((2, k, step + shift, step - shift, rnd.uniform(1, 9), 1.0))
    tiles = spark.createDataFrame(rows, COLS).select(
        "g", *[F.floor(c).alias(f"_t{c}") for c in "xy"]).distinct()
    # No empty row or column of tiles parts them, yet each group has several blocks.
    n = {r.g: r.n for r in patches._tile_blocks(tiles, ["g"]).groupBy("g").agg(
        F.count_distinct("_block").alias("n")).collect()}
    assert min(n.values()) >= 2
    assert found(spark, rows, 1.0) == wanted(rows, 1.0)


@pytest.mark.parametrize("length", [1, 2, 37])
def test_components_of_chains_and_stars(spark, length):
    rnd = random.Random(length)
    names = list(range(2 * length + 2))
    rnd.shuffle(names)
    chain, star = names[:length + 1], names[length + 1:]
    edges = list(zip(chain, chain[1:])) + [(star[0], other) for other in star[1:]]
    edges += [(b, a) for a, b in edges[::2]] + [(chain[0], chain[0])]
    got = dict(patches._components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: min(chain) for i in chain}
    if len(star) > 1:
        want |= {i: min(star) for i in star}
    assert got == want
