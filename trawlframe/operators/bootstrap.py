"""Bootstrap limits: stations resampled within (year, district, class).

``method='index'`` is the plain bootstrap: n draws with replacement from the n
stations of a group, for each replicate, looked up by position.
``method='multinomial'`` has the same distribution without a lookup: a group's rows
lie in slices of bounded size, the n draws are split over the slices by binomials down a
binary tree, and each slice draws its share from its own rows. Only sums are
shuffled, so this is the form for very large groups. ``method='poisson'`` gives each
station an independent Poisson(1) count in each replicate instead; it is not
the same resampling (the number of draws varies), but needs no order of the rows.

All draws follow from hashes, so a rerun, a lost executor or another partitioning
gives the same ones. In the plain and the Poisson form a row has two md5 numbers a and b; its
draw in replicate r is (a + r b) mod p. The rows' numbers are independent, so each replicate is
a plain resample, and any two replicates are independent too; md5 is taken
once for a row, not once for a draw.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.functions import region_from_district, safe_div, strict_avg, strict_sum
from trawlframe.operators.ordered import running_totals
from trawlframe.session import attach_groups, cut_lineage

GROUP = ["year", "district", "size_sex"]
# Rows of three numbers that are broadcast, after counting: tens of MB.
BROADCAST_VALUES = 1_000_000
# A prime below 2**52, so that r b stays within a bigint for r below 1024.
PRIME = 2**52 - 47
ROUND = 1024


def hash_numbers(*parts) -> tuple[Column, Column]:
    """Two whole numbers below PRIME from the md5 of the parts joined by '|'."""
    digest = F.md5(F.concat_ws("|", *[
        p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return tuple(
        F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint") % PRIME for start in (1, 14)
    )


def _hashed(rows: DataFrame, reps: int, seed: int, by: list[str], row: str) -> DataFrame:
    """Each row once for every ROUND replicates (``_round``), with its numbers ``_a`` and ``_b``."""
    last = (reps - 1) // ROUND
    many = rows.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(last))))
    a, b = hash_numbers(seed, *[F.col(c) for c in by], F.col(row), F.col("_round"))
    return many.withColumns({"_a": a, "_b": b})


def _replicated(rows: DataFrame, reps: int, seed: int, by: list[str], row: str) -> DataFrame:
    """Each row once for every replicate, with its random number ``_x``."""
    many = _hashed(rows, reps, seed, by, row).withColumn(
        "_r", F.explode(F.sequence(F.lit(0), F.least(F.lit(ROUND), reps - F.col("_round") * ROUND) - 1)))
    return many.withColumns({
        "rep": (F.col("_round") * ROUND + F.col("_r") + 1).cast("int"),
        "_x": (F.col("_a") + F.col("_r") * F.col("_b")) % PRIME,
    }).drop("_round", "_r", "_a", "_b")


def resampled_means(cpue: DataFrame, reps: int = 1000, seed: int = 1, by=GROUP,
                    method: str = "index", station: str = "station") -> DataFrame:
    """Mean CPUE and mean area of every resample: one row for (group, replicate).

    ``method='poisson'`` weights rows where they lie. A Poisson replicate in which a
    group draws no row at all (e to the minus n of them for n stations) is NULL, and
    the limits are those of the group's other replicates.
    """
    by = list(by)
    rows = cpue.select(*by, station, "cpue", "total_area")
    if method == "poisson":
        sums = _hashed(rows, reps, seed, by, station).select(*by, "_round", "_a", "_b", "cpue", "total_area").mapInArrow(
            partial(_poisson_sums, by=by, reps=reps), _sums_schema(rows, by, "start int, "))
        totals = _total(sums.select(*by, "start", F.posexplode(F.arrays_zip("k", "cpue", "area")).alias("i", "s"),
                                    "cpues", "areas"), by)
        # A mean is NULL where all values of the group are.
        return totals.select(
            *by, "rep", F.when(F.col("cpues") > 0, safe_div("cpue", "k")).alias("mean_cpue"),
            F.when(F.col("areas") > 0, safe_div("area", "k")).alias("mean_area"))
    if method == "multinomial":
        order = [F.col(station), F.col("cpue"), F.col("total_area")]
        placed = running_totals(rows, by, order, {"_pos": F.lit(1).cast("bigint")})
        sliced = placed.select(
            *by, F.xxhash64(*by).alias("_g") if by else F.lit(0).cast("bigint").alias("_g"),
            F.expr(f"(_pos - 1) div {SLICE_ROWS}").alias("_slice"), F.col("_pos").alias("_at"),
            F.col("_pos_total").alias("_n"), F.col("cpue").cast("double"), F.col("total_area").cast("double"))
        rows_of_slice = SLICE_ROWS

        def work(own: pd.DataFrame) -> pd.DataFrame:
            return _multinomial_sums(own, by, reps, seed, rows_of_slice)

        sums = sliced.groupBy(*by, "_slice").applyInPandas(work, _sums_schema(rows, by, ""))
        totals = _total(sums.select(*by, F.lit(1).alias("start"), F.posexplode(F.arrays_zip("k", "cpue", "area")).alias("i", "s"),
                                    "cpues", "areas"), by)
        # One missing value among the draws makes the mean missing.
        return totals.select(*by, "rep", *[F.nanvl(safe_div(v, "k"), F.lit(None)).alias(f"mean_{v}")
                                           for v in ("cpue", "area")])
    if method != "index":
        raise ValueError("method is 'index', 'multinomial' or 'poisson'")
    # One position for each row of the table, group after group. A draw is then
    # a single number to look up, and a group is known by its first position.
    order = [*[F.col(c) for c in by], F.col(station), F.col("cpue")]
    placed = cut_lineage(
        running_totals(rows, [], order, {"_pos": F.lit(1).cast("bigint")}).drop("_pos_total"))
    groups = placed.groupBy(*by).agg(
        F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    slots = attach_groups(placed.select(*by, "_pos", "cpue", "total_area"), groups, by).withColumn(
        "_row", F.col("_pos") - F.col("_start"))
    # Beyond what fits in every executor, rows and slots of a group meet in blocks.
    if placed.count() > BROADCAST_VALUES:
        return _means_by_blocks(slots, groups, reps, seed, by)
    # Few rows become ``reps`` times as many, so they are spread first, by position: a task's
    # draws are of few groups, and it hands on one sum for each of their replicates.
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = _replicated(slots.drop("cpue", "total_area").repartitionByRange(n, "_pos").drop("_pos"),
                        reps, seed, by, "_row").select(
        "_start", "rep", (F.col("_start") + F.col("_x") % F.col("_n")).alias("_pos"))
    values = F.broadcast(placed.select("_pos", "cpue", "total_area"))
    means = draws.join(values, "_pos").groupBy("_start", "rep").agg(
        strict_avg("cpue").alias("mean_cpue"), strict_avg("total_area").alias("mean_area"))
    return means.join(groups.select(*by, "_start"), "_start").select(
        *by, "rep", "mean_cpue", "mean_area")


# A Poisson(1) count beyond this has less room than one step of the hash.
MOST = 18
# Draws a task holds at once, and groups whose sums it holds before it hands them on.
DRAWS_AT_ONCE, GROUPS_AT_ONCE = 1_000_000, 2000
# Rows of one slice of a group.
SLICE_ROWS = 8192
# Rows of a group, and slots drawing from them, that meet in one task.
BLOCK_ROWS = 1 << 20
# Slots of a block whose draws are held at once: they stay in a core's cache.
SLOTS_AT_ONCE = 1 << 14
# Of each replicate: draws, sums of the values, missing ones among them, and whether a sum is NaN.
BLOCK_SUMS = ("k", "cpue", "area", "no_cpue", "no_area", "nan_cpue", "nan_area")


def _means_by_blocks(slots: DataFrame, groups: DataFrame, reps: int, seed: int, by: list[str]) -> DataFrame:
    """Means of the plain form where blocks of a group's rows meet blocks of its slots.

    A slot's draws follow from its two numbers, so slots are shuffled, once for each block of
    the group's rows, and no draw is; what leaves a task is a sum for each replicate.
    """
    def blocks(n: Column) -> Column:
        return F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(n) - 1))

    own = F.floor(F.col("_row") / F.lit(BLOCK_ROWS)).cast("int")
    keys = ["_start", "_round", "_slots", "_rows"]
    last = F.lit((reps - 1) // ROUND)
    asking = (_hashed(slots, reps, seed, by, "_row").withColumn("_rows", every(F.col("_n")))
              .select("_start", "_round", own.alias("_slots"), "_rows", "_n", "_a", "_b"))
    values = [c for v in ("cpue", "total_area") for c in (
        F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v), F.col(v).isNull().cast("double").alias(f"no_{v}"))]
    asked = (slots.withColumns({"_slots": every(F.col("_n")), "_rows": own})
             .withColumn("_round", F.explode(F.sequence(F.lit(0), last)))
             # New names for the same columns, so that the two sides can be told apart.
             .select(*[F.col(c).alias(c) for c in (*keys, "_row")], *values))
    size = BLOCK_ROWS

    def work(key, ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _block_sums(key, ask, rows, reps, size)

    sums = asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        work, "_start long, start int, " + ", ".join(f"{c} array<double>" for c in BLOCK_SUMS))
    totals = sums.select("_start", "start", F.posexplode(
        F.arrays_zip(*BLOCK_SUMS)).alias("i", "s")).groupBy(
        "_start", (F.col("start") + F.col("i")).cast("int").alias("rep")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in BLOCK_SUMS])
    # One missing value among the draws makes the mean missing.
    return totals.join(groups.select(*by, "_start"), "_start").select(
        *by, "rep", *[F.when(F.col(f"no_{v}") == 0, F.when(F.col(f"nan_{v}") > 0, F.lit(math.nan)).otherwise(
            safe_div(v, "k"))).alias(f"mean_{v}") for v in ("cpue", "area")])


def _block_sums(key: tuple, ask: pd.DataFrame, rows: pd.DataFrame, reps: int, block: int) -> pd.DataFrame:
    """What the draws of one block of slots from one block of rows sum to in each replicate."""
    start, number, _, part = (int(k) for k in key)
    many, base = min(reps - number * ROUND, ROUND), part * block
    place = rows["_row"].to_numpy(np.int64) - base
    # Two numbers of a row as one: a draw looks up once for both, and only once more if a value is missing.
    pairs = [np.empty(len(rows), complex) for _ in range(2)]
    for pair, names in zip(pairs, (("cpue", "total_area"), ("no_cpue", "no_total_area"))):
        pair.real[place], pair.imag[place] = (rows[c].to_numpy(float) for c in names)
    pairs = pairs if pairs[1].any() else pairs[:1]
    a, b, n = ask["_a"].to_numpy(np.uint64), ask["_b"].to_numpy(np.uint64), np.uint64(ask["_n"].iloc[0])
    prime, whole = np.uint64(PRIME), len(rows) == n
    sums = np.zeros((len(BLOCK_SUMS), many))
    for first in range(0, len(a), SLOTS_AT_ONCE):
        x, step = a[first:first + SLOTS_AT_ONCE].copy(), b[first:first + SLOTS_AT_ONCE]
        less, at = np.empty_like(x), np.empty_like(x)
        for rep in range(many):
            # x modulo n.
            np.floor_divide(x, n, out=at)
            np.multiply(at, n, out=at)
            np.subtract(x, at, out=at)
            there = at
            if not whole:
                # Below the base it wraps to beyond the end.
                np.subtract(at, np.uint64(base), out=at)
                there = at[at < len(rows)]
            there = there.view(np.int64)
            sums[0, rep] += len(there)
            for pair, i in zip(pairs, (1, 3)):
                total = pair.take(there, mode="clip").sum()
                sums[i, rep] += total.real
                sums[i + 1, rep] += total.imag
            # The next replicate's number: less than twice the prime, and wrapped if below 0.
            np.add(x, step, out=x)
            np.subtract(x, prime, out=less)
            np.minimum(x, less, out=x)
    # NaN in a list would come back as NULL.
    sums[5:] = np.isnan(sums[1:3])
    sums[1:3] = np.nan_to_num(sums[1:3], nan=0.0, posinf=np.inf, neginf=-np.inf)
    return pd.DataFrame({"_start": [start], "start": [number * ROUND + 1],
                         **{c: [sums[i]] for i, c in enumerate(BLOCK_SUMS)}})


def _sums_schema(rows: DataFrame, by: list[str], more: str) -> str:
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    return f"{kinds}{more}k array<double>, cpue array<double>, area array<double>, cpues long, areas long"


def _total(sums: DataFrame, by: list[str]) -> DataFrame:
    """The tasks' sums of each replicate added up."""
    return sums.groupBy(*by, (F.col("start") + F.col("i")).cast("int").alias("rep")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("k", "cpue", "area")], F.sum("cpues").alias("cpues"),
        F.sum("areas").alias("areas"))


def _poisson_sums(batches: Iterator[pa.RecordBatch], by: list[str], reps: int) -> Iterator[pa.RecordBatch]:
    """Poisson(1) weights of a task's rows in every replicate, summed by group as arrays.

    A weight is the number of steps of the distribution function at or below the row's
    hash, so it does not depend on where the row lies.
    """
    steps = np.array([sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(MOST)])
    held: dict[tuple, list] = {}

    def told() -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        columns = [pa.array([k[j] for k in keys], kinds[j]) for j in range(len(by))]
        columns += [pa.array([k[-1] * ROUND + 1 for k in keys], pa.int32())]
        columns += [pa.array([v[0][c].tolist() for v in values], pa.list_(pa.float64())) for c in range(3)]
        columns += [pa.array([v[c] for v in values], pa.int64()) for c in (1, 2)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, [*by, "start", "k", "cpue", "area", "cpues", "areas"])

    for batch in batches:
        kinds = [batch.schema.field(c).type for c in by]
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(c).to_pylist() for c in (*by, "_round")]))
        known: dict[tuple, int] = {}
        code = np.array([known.setdefault(k, len(known)) for k in keys])
        order = np.argsort(code, kind="stable")
        names = list(known)
        a, b = (np.asarray(batch.column(c), np.int64)[order] for c in ("_a", "_b"))
        values = [np.asarray(batch.column(c).cast(pa.float64()).fill_null(0.0))[order] for c in ("cpue", "total_area")]
        there = [~np.asarray(batch.column(c).is_null())[order] for c in ("cpue", "total_area")]
        code = code[order]
        for first in range(0, len(code), max(1, DRAWS_AT_ONCE // min(reps, ROUND))):
            rows = slice(first, first + max(1, DRAWS_AT_ONCE // min(reps, ROUND)))
            x = (a[rows, None] + np.arange(min(reps, ROUND)) * b[rows, None]) % PRIME
            k = np.searchsorted(steps, x / float(PRIME), side="right").astype(float)
            starts = np.flatnonzero(np.diff(code[rows], prepend=-1))
            parts = [np.add.reduceat(w, starts, axis=0) for w in
                     (k, k * values[0][rows, None], k * values[1][rows, None])]
            found = [np.add.reduceat(t[rows].astype(np.int64), starts) for t in there]
            for i, c in enumerate(code[rows][starts]):
                own = held.setdefault(names[c], [np.zeros((3, min(reps - names[c][-1] * ROUND, ROUND))), 0, 0])
                own[0] += [p[i, :own[0].shape[1]] for p in parts]
                own[1] += int(found[0][i])
                own[2] += int(found[1][i])
        if len(held) > GROUPS_AT_ONCE:
            yield told()
    if held:
        yield told()


def _share_of_draws(n: int, own: int, reps: int, seeds: list[int], slice_rows: int) -> np.ndarray:
    """How many of a group's n draws fall in slice ``own`` in each replicate.

    Slices are the leaves of a binary tree. At every node from the top to the leaf the draws
    are split by a binomial seeded by the node, so all slices of a node see the same split.
    """
    low, high = 0, -(-n // slice_rows)
    draws = np.full(reps, n, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, rows = (middle - low) * slice_rows, min(high * slice_rows, n) - low * slice_rows
        split = np.random.Generator(np.random.PCG64([*seeds, low, high])).binomial(draws, left / rows)
        low, high, draws = (low, middle, split) if own < middle else (middle, high, draws - split)
    return draws


def _multinomial_sums(rows: pd.DataFrame, by: list[str], reps: int, seed: int, slice_rows: int) -> pd.DataFrame:
    """One slice's draws of every replicate, summed."""
    rows = rows.sort_values("_at")
    own, n = int(rows["_slice"].iloc[0]), int(rows["_n"].iloc[0])
    seeds = [seed, int(rows["_g"].iloc[0]) % 2 ** 63]
    draws = _share_of_draws(n, own, reps, seeds, slice_rows)
    cpue, area = rows["cpue"].to_numpy(float), rows["total_area"].to_numpy(float)
    generator = np.random.Generator(np.random.PCG64([*seeds, own, own + 1, 1]))
    sums = np.zeros((2, reps))
    step = max(1, DRAWS_AT_ONCE // len(rows))
    for first in range(0, reps, step):
        part = draws[first:first + step]
        pick = generator.integers(0, len(rows), part.sum())
        rep = np.repeat(np.arange(len(part)), part)
        for s, values in zip(sums, (cpue, area)):
            s[first:first + step] = np.bincount(rep, values[pick], len(part))
    return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in by}, "k": [draws.astype(float)], "cpue": [sums[0]],
                         "area": [sums[1]], "cpues": [len(rows)], "areas": [len(rows)]})


def _limits(means: DataFrame, value: Column, by) -> DataFrame:
    # A group has one value for each replicate, so the exact percentile is bounded.
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*by).agg(ends.alias("_ends")).select(
        *by, F.col("_ends")[0].alias("_lwr"), F.col("_ends")[1].alias("_upp"),
        region_from_district().alias("region"),
    )


def abundance_bootstrap(cpue: DataFrame, point: DataFrame, reps: int = 1000, seed: int = 1,
                        method: str = "index") -> DataFrame:
    """Bootstrap limits summed over districts, beside the point estimate ``point``."""
    means = resampled_means(cpue, reps, seed, GROUP, method)
    value = F.col("mean_cpue") * F.col("mean_area") / 1_000_000.0
    region = _limits(means, value, GROUP).groupBy("year", "region", "size_sex").agg(
        strict_sum("_lwr").alias("lwr_95"), strict_sum("_upp").alias("upp_95"),
    )
    return _beside(region, point, "abundance_mil")


def cpue_bootstrap(cpue: DataFrame, point: DataFrame, reps: int = 1000, seed: int = 1,
                   method: str = "index") -> DataFrame:
    """Bootstrap limits averaged over districts, beside the point estimate ``point``."""
    means = resampled_means(cpue, reps, seed, GROUP, method)
    region = _limits(means, F.col("mean_cpue"), GROUP).groupBy("year", "region", "size_sex").agg(
        strict_avg("_lwr").alias("lwr_95"), strict_avg("_upp").alias("upp_95"),
    )
    return _beside(region, point, "cpue")


def _beside(region: DataFrame, point: DataFrame, estimate: str) -> DataFrame:
    keys = ["year", "region", "size_sex"]
    return region.join(point.select(*keys, estimate), keys, "full").select(
        *keys, estimate, "lwr_95", "upp_95"
    )
