from fractions import Fraction

import numpy as np
import pytest

from trawlframe.llm import whitening as w
from trawlframe.llm.q_whitening import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, v int, z string, n string, component int, deviation string"


def table_of(spark, rows):
    return spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "z", "n", 0, "d")
         for i, v in rows], SCHEMA)


def brute(x, k):
    """Whole numbers x: deviations, eigenvalues, vectors, shares by numpy and fractions."""
    n, sums = len(x), [sum(c) for c in zip(*x.tolist())]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x.tolist()])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return deviation, values, centred @ vectors / np.sqrt(values), values / (np.square(centred).sum() / n)


def check(got, ids, x, k=32, tolerance=1e-9):
    deviation, values, white, share = brute(x, k)
    found = {(r.vec_id, r.component): r for r in got}
    assert len(found) == len(got) == len(ids) * len(values)
    for c in range(len(values)):
        mine = np.array([found[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ white[:, c])
        assert np.abs(mine - sign * white[:, c]).max() < tolerance
        assert all(abs(found[i, c + 1].explained / share[c] - 1) < 1e-9 for i in ids)
    assert all((r.n, r.deviation) == (len(ids), deviation[ids.index(r.vec_id)]) for r in got)
    assert all(r.identity_error < 1e-9 and r.residual <= w.CERTIFIED for r in got)


def fast_falling(n, d, seed):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * 0.8 ** np.arange(d)) @ np.linalg.qr(r.normal(size=(d, d)))[0] + r.normal(size=d) * 50


def whole(v):
    return np.floor(64 * np.float32(v).astype(float)).astype(np.int64) + 1_000_000


@pytest.mark.parametrize("data", ["flat", "falling", "copies"])
def test_equals_numpy(spark, data):
    r = np.random.default_rng(3)
    v = r.normal(size=(600, 60)) if data == "flat" else fast_falling(600, 60, 1)
    if data == "copies":
        v[200:400] = v[0]
    got = w.whitened_components(table_of(spark, list(enumerate(v))), components=8).collect()
    check(got, list(range(600)), whole(v), 8)


def test_the_query_equals_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], np.float32)
    check(op13_embedding_whitening(spark, sf).collect(), [r.vec_id for r in rows], whole(v))


@pytest.mark.parametrize("d", [1, 3, 40])
def test_blocks_as_wide_as_the_vectors(spark, d):
    v = np.random.default_rng(d).normal(size=(100, d)) + 7
    check(w.whitened_components(table_of(spark, list(enumerate(v)))).collect(), list(range(100)), whole(v), min(d, 32))


def test_fewer_rows_than_dimensions(spark):
    v = np.random.default_rng(0).normal(size=(6, 70))
    got = w.whitened_components(table_of(spark, list(enumerate(v)))).collect()
    check(got, list(range(6)), whole(v), 5)


def test_without_variance_there_is_nothing_to_return(spark):
    for rows in ([], [(1, [1, 2])], [(1, [1, 2]), (2, [1, 2])], [(1, None)], [(1, [])]):
        got = w.whitened_components(table_of(spark, rows))
        assert got.count() == 0 and got.columns[:3] == ["vec_id", "component", "n"]


def test_unusable_vectors_take_no_part(spark):
    v = np.random.default_rng(0).normal(size=(50, 4))
    bad = [(60, None), (61, [1, 2, None, 4]), (62, [float("nan")] * 4), (63, [float("-inf")] * 4), (64, [1, 2]), (65, [])]
    check(w.whitened_components(table_of(spark, [*enumerate(v), *bad])).collect(), list(range(50)), whole(v), 4)


def test_repeats_and_null_ids_count_each(spark):
    v = np.random.default_rng(0).normal(size=(30, 3))
    rows = [*enumerate(v), (0, v[0]), (None, v[1])]
    got = w.whitened_components(table_of(spark, rows)).collect()
    assert len(got) == 32 * 3 and {r.n for r in got} == {32} and sum(r.vec_id is None for r in got) == 3


def test_huge_numbers_are_clipped_and_deviations_beyond_64_bits_null(spark):
    rows = [(i, [3e30 * (-1) ** i, float(i)]) for i in range(20)]
    got = w.whitened_components(table_of(spark, rows)).collect()
    # The other component has less than NO_VARIANCE of the first.
    assert {r.deviation for r in got} == {None} and len(got) == 20 and got[0].identity_error < 1e-6


@pytest.mark.parametrize("spectrum", ["flat", "geometric", "pairs", "deficient"])
def test_eigenpairs_by_products_alone(spectrum):
    d, k = 200, 20
    r = np.random.default_rng(5)
    values = {"flat": 1 + 0.1 * r.random(d), "geometric": 0.9 ** np.arange(d),
              "pairs": np.repeat(1 + np.arange(d // 2) / 10, 2), "deficient": np.where(np.arange(d) < 25, 2.0, 0) + 1e-3 * (np.arange(d) < 25) * np.arange(d)}[spectrum]
    basis = np.linalg.qr(r.normal(size=(d, d)))[0]
    matrix, calls = (basis * values) @ basis.T, []

    def product(q):
        calls.append(q.shape[1])
        return matrix @ q

    found, q, residual = w.leading_components(product, d, k)
    assert np.allclose(found, np.sort(values)[::-1][:k], rtol=1e-11)
    assert residual.max() <= w.CERTIFIED * found[0] and np.abs(q.T @ q - np.eye(k)).max() < 1e-13
    assert max(calls) <= k + w.GUARDS and len(calls) < 400
