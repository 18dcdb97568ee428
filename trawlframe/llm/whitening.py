"""Whitened principal components by Chebyshev-filtered subspace iteration over distributed products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.common import discard, written
from trawlframe.llm.vector_codes import common_dimension, finite, stacked

COMPONENTS, SCALE = 32, 64
# Further vectors of the block, degree of a filter at most, and what a filter may stretch by.
GUARDS, DEGREE, STRETCH = 16, 14, 1e8
# Residuals up to this share of the largest eigenvalue are certified; rounds at most.
CERTIFIED, ROUNDS = 1e-13, 60
# Components with less than this share of the largest eigenvalue cannot be whitened.
NO_VARIANCE = 1e-12
# Vectors and steps of the search for the lower end of the spectrum.
PROBES, PROBE_STEPS = 4, 6
BLOCK_BYTES = 4 * 1024 * 1024
LIMIT = 2 ** 30


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors * scale), -LIMIT, LIMIT).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], dimension: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Whole numbers of many vectors in one cell."""
    step = max(1, BLOCK_BYTES // (4 * dimension))
    for batch in batches:
        x = whole_numbers(stacked(batch.column("v"), dimension), scale).astype("<i4")
        blocks = [x[a:a + step].tobytes() for a in range(0, len(x), step)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for cell in batch.column("block"):
            yield np.frombuffer(cell.as_buffer(), "<i4").reshape(-1, dimension).astype(np.int64)


def _column_sums(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    """The number of vectors of a task, then the sum of each component; exact."""
    sums = np.zeros(dimension + 1, np.int64)
    for x in _blocks(batches, dimension):
        sums += [len(x), *x.sum(0)]
    yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.int64()))], ["v"])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean; whole numbers first, so that no digits are lost to a large mean."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s - n * int(w)) / n for s, w in zip(sums, whole)])


def _products(batches: Iterator[pa.RecordBatch], q: np.ndarray, n: int,
              sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's share of X'XQ by rows, and of the trace of X'X as the first value of row -1."""
    out, trace = np.zeros(q.shape), 0.0
    for x in _blocks(batches, len(q)):
        x = _centred(x, n, sums)
        out += x.T @ (x @ q)
        trace += np.square(x).sum()
    rows = [[trace], *out.tolist()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(-1, len(q)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["i", "v"])


def _moments(batches: Iterator[pa.RecordBatch], q: np.ndarray, n: int,
             sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums (row -1) and sums of products of the vectors projected on q."""
    first, second = np.zeros(q.shape[1]), np.zeros((q.shape[1], q.shape[1]))
    for x in _blocks(batches, len(q)):
        z = _centred(x, n, sums) @ q
        first += z.sum(0)
        second += z.T @ z
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(-1, len(second)), pa.int32()),
         pa.array([first.tolist(), *second.tolist()], pa.list_(pa.float64()))], ["i", "v"])


def _summed(blocks: DataFrame, function, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row -1 and the rows 0.. of a matrix whose shares the tasks of ``function`` give."""
    cells = (blocks.mapInArrow(function, "i int, v array<double>")
             .select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")))
    out = np.zeros((shape[0] + 1, shape[1]))
    for row in cells.collect():
        out[row["i"] + 1, row["j"]] = row["v"]
    return out[0], out[1:]


def _orthonormal(x: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    for _ in range(2):  # once more, against what rounding left
        if against is not None:
            x = x - against @ (against.T @ x)
        x = np.linalg.qr(x)[0]
    return x


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors within span(q), and the norms of their residuals."""
    small = q.T @ vq
    values, u = np.linalg.eigh((small + small.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    return values, q @ u, np.linalg.norm(vq @ u - (q @ u) * values, axis=0)


def lower_end(product: Callable[[np.ndarray], np.ndarray], dimension: int) -> float:
    """About the smallest eigenvalue, from a short block Krylov space of random probes."""
    x = _orthonormal(np.random.default_rng(1).normal(size=(dimension, min(PROBES, dimension))))
    basis, images = x, product(x)
    for _ in range(PROBE_STEPS - 1):
        if basis.shape[1] + x.shape[1] > dimension // 2:
            break
        x = _orthonormal(images[:, -x.shape[1]:], basis)
        basis, images = np.hstack([basis, x]), np.hstack([images, product(x)])
    values, _, residual = _ritz(basis, images)
    return max(0.0, values[-1] - residual[-1])


def chebyshev_filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, cut: float,
                       top: float, degree: int, locked: np.ndarray) -> np.ndarray:
    """A Chebyshev polynomial of the matrix times q: small on [low, cut], one at ``top``, growing to it."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    first = sigma = half / (top - middle)
    before, now = q, (product(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        now = now - locked @ (locked.T @ now)
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * (after / half) * (product(now) - middle * now) - sigma * after * before
        sigma = after
    return now


def leading_components(product: Callable[[np.ndarray], np.ndarray], dimension: int,
                       components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, falling, unit eigenvectors and residuals of a symmetric non-negative matrix.

    ``product`` gives the matrix times a block of vectors and is all that is known of it.
    A block of ``components`` + GUARDS vectors is filtered by a Chebyshev polynomial
    that stays small on the unwanted part of the spectrum, from its lower end to
    the block's smallest Ritz value, and grows beyond; then come QR and Rayleigh-Ritz.
    The degree is the largest up to DEGREE by which the filter stretches no direction
    more than STRETCH times, so that smaller ones survive beside it. Leading vectors whose
    residual is at most CERTIFIED times the largest eigenvalue are locked; the others
    go on without them until all are.
    """
    block = min(dimension, components + GUARDS)
    wanted = min(dimension, components)
    if block == dimension:
        q = np.eye(dimension)
        values, q, residual = _ritz(q, product(q))
        return values[:wanted], q[:, :wanted], residual[:wanted]
    low = lower_end(product, dimension)
    locked, q = np.zeros((dimension, 0)), _orthonormal(np.random.default_rng(0).normal(size=(dimension, block)))
    largest = 0.0
    for _ in range(ROUNDS):
        values, q, residual = _ritz(q, product(q))
        largest = max(largest, values[0])
        done = residual <= CERTIFIED * largest
        new = len(done) if done.all() else int(done.argmin())
        locked, q, values = np.hstack([locked, q[:, :new]]), q[:, new:], values[new:]
        if locked.shape[1] >= wanted:
            break
        top, cut = values[0], values[-1]
        from_low = min(low, cut / 2)
        if cut <= 0 or top <= cut:  # nothing to tell apart: a plain product
            q = _orthonormal(product(q), locked)
            continue
        reach = np.arccosh((2 * top - cut - from_low) / (cut - from_low))
        degree = int(np.clip(np.log(STRETCH) // reach, 1, DEGREE))
        q = _orthonormal(chebyshev_filtered(product, q, from_low, cut, top, degree, locked), locked)
    q = _orthonormal(np.hstack([locked, q]))
    values, q, residual = _ritz(q, product(q))
    return values[:wanted], q[:, :wanted], residual[:wanted]


def _whitened(batches: Iterator[pa.RecordBatch], q: np.ndarray, n: int, sums: np.ndarray,
              scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = whole_numbers(stacked(batch.column("v"), len(q)), scale)
        far = n * max(int(np.abs(x).max(initial=0)), 1) + max(abs(s) for s in sums)
        exact = n * (x if len(q) * far ** 2 < 2 ** 63 else x.astype(object)) - sums.astype(
            np.int64 if len(q) * far ** 2 < 2 ** 63 else object)
        deviation = [d if d < 2 ** 63 else None for d in (exact * exact).sum(1).tolist()]
        z = _centred(x, n, sums) @ q
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(deviation, pa.int64()), pa.array(z.tolist(), pa.list_(pa.float64()))],
            ["id", "deviation", "z"])


def whitened_components(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE,
                        id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Every vector on the leading principal components of all vectors, scaled to variance one.

    Components of a vector are made whole numbers, floor(scale * c), clipped at 2**30; a number
    added to all of them would cancel, exactly, in everything returned. Count and
    sums are exact; covariances are taken about the mean (divisor n, centred before they
    are multiplied). The covariance itself is never formed: vectors are packed once in
    blocks, and each product of it with a block of at most ``components`` + GUARDS vectors
    is one pass over them, summed cell by cell (``leading_components``). The driver holds
    dimension x (``components`` + GUARDS) numbers.

    Returns for each row and component: ``id_column``, component (from 1 by falling eigenvalue),
    n, deviation (the sum over dimensions of (n * x - S)**2, exact; null if it needs
    more than 64 bits), whitened, explained (eigenvalue / trace), identity_error (one
    value: the largest absolute entry of the covariance of ``whitened`` less the identity)
    and residual (|Vq - eq| / largest eigenvalue, at most CERTIFIED where certified). The sign of a
    component is that of its entry of largest size, made positive.

    Rows whose vector is null, empty, of another than the commonest length, or holds null or
    non-finite numbers take no part. Rows count each, with equal or null ids too.
    Components without variance cannot be whitened and are left out: with n rows there are at most
    n - 1, with equal rows alone none, and then no row is returned. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = (vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
            .where(finite(F.col("v"))))
    kind = kept.schema["id"].dataType.simpleString()
    nothing = spark.createDataFrame(
        [], f"{id_column} {kind}, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double, residual double")
    dimension = common_dimension(kept, "v")
    if not dimension:
        return nothing
    kept = kept.where(F.size("v") == dimension)
    blocks = written(kept.select("v").mapInArrow(partial(_packed, dimension=dimension, scale=scale), "block binary"))
    totals = (blocks.mapInArrow(partial(_column_sums, dimension=dimension), "v array<long>")
              .select(F.posexplode("v").alias("i", "v")).groupBy("i")
              .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("i").collect())
    n, sums = int(totals[0]["v"]), np.array([int(r["v"]) for r in totals[1:]], object)
    trace = 0.0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal trace
        first, rows = _summed(blocks, partial(_products, q=q, n=n, sums=sums), q.shape)
        trace = first[0] / n
        return rows / n

    values, q, residual = leading_components(product, dimension, components)
    usable = values > NO_VARIANCE * max(values[0], 0.0)
    values, q, residual = values[usable], q[:, usable], residual[usable]
    if not len(values):
        discard(blocks)
        return nothing
    q = q * np.where(q[np.abs(q).argmax(0), range(q.shape[1])] < 0, -1.0, 1.0)
    scaled = q / np.sqrt(values)
    first, second = _summed(blocks, partial(_moments, q=scaled, n=n, sums=sums), (len(values), len(values)))
    error = np.abs(second / n - np.outer(first / n, first / n) - np.eye(len(values))).max()
    discard(blocks)

    def of_component(numbers: np.ndarray):
        return F.element_at(F.array(*[F.lit(float(v)) for v in numbers]), F.col("component"))

    return (kept.mapInArrow(partial(_whitened, q=scaled, n=n, sums=sums, scale=scale),
                            f"id {kind}, deviation long, z array<double>")
            .select(F.col("id").alias(id_column), "deviation", F.posexplode("z").alias("place", "whitened"))
            .withColumn("component", F.col("place") + 1)
            .select(id_column, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    of_component(values / trace).alias("explained"),
                    F.lit(float(error)).alias("identity_error"),
                    of_component(residual / values[0]).alias("residual")))
