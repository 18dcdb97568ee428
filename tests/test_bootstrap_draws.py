"""Draws of the bootstrap: split over slices, independent of partitions, missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlframe.operators import bootstrap

SCHEMA = "year int, district string, size_sex string, station long, cpue double, total_area double"
BY = ["year", "district", "size_sex"]


def groups(n, cpue=lambda i: float(i % 17), name="a", year=1):
    return [(year, name, "m", i, cpue(i), 2.0 + i % 3) for i in range(n)]


def close(got, expected):
    return all(a == b if a is None or b is None else a == pytest.approx(b, rel=1e-12) for a, b in zip(got, expected))


def means_of(df, **options):
    return {(r.year, r.district, r.rep): (r.mean_cpue, r.mean_area)
            for r in bootstrap.resampled_means(df, by=BY, **options).collect()}


@pytest.mark.parametrize("n, slice_rows", [(10, 100), (100, 100), (1001, 100), (7, 1)])
def test_the_slices_share_all_draws_in_proportion_to_their_rows(n, slice_rows):
    slices = -(-n // slice_rows)
    share = np.array([bootstrap._share_of_draws(n, s, 4000, [3, 5], slice_rows) for s in range(slices)])
    assert (share.sum(0) == n).all() and (share >= 0).all()
    rows = np.array([min(slice_rows, n - s * slice_rows) for s in range(slices)])
    spread = np.sqrt(np.maximum(rows * (1 - rows / n), 1e-9) / 4000)
    assert (np.abs(share.mean(1) - rows) <= 5 * spread).all()
    if slices > 1:  # a multinomial's variance
        assert np.allclose(share.var(1), rows * (1 - rows / n), rtol=0.2)


@pytest.mark.parametrize("slice_rows", [10_000, 16])
def test_multinomial_draws_have_the_distribution_of_the_plain_form(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(bootstrap, "SLICE_ROWS", slice_rows)
    rows = groups(200) + groups(50, lambda i: float(i * i), "b", None)
    df = spark.createDataFrame(rows, SCHEMA)
    drawn = {m: means_of(df, reps=1500, method=m) for m in ("index", "multinomial")}
    assert set(drawn["index"]) == set(drawn["multinomial"])
    for name in ("a", "b"):
        values = np.array([r[4] for r in rows if r[1] == name])
        error = values.std() / np.sqrt(len(values))
        for m, means in drawn.items():
            own = np.array([v[0] for k, v in means.items() if k[1] == name])
            assert abs(own.mean() - values.mean()) < 5 * error / np.sqrt(1500), m
            assert abs(own.std() / error - 1) < 0.12, m
            assert len(set(own.round(9))) > 200  # sums of whole numbers repeat


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_draws_do_not_depend_on_partitions(spark, monkeypatch, method):
    monkeypatch.setattr(bootstrap, "SLICE_ROWS", 16)
    df = spark.createDataFrame(groups(100) + groups(3, name="b"), SCHEMA)
    one, other = (means_of(df.repartition(n), reps=30, method=method) for n in (1, 7))
    assert set(one) == set(other) and len(one) == 60
    assert all(close(one[k], other[k]) for k in one)


def test_another_seed_draws_otherwise(spark):
    df = spark.createDataFrame(groups(100), SCHEMA)
    one, other = (means_of(df, reps=20, seed=s, method="multinomial") for s in (1, 2))
    assert sum(one[k] == other[k] for k in one) < 3


def test_a_missing_value_among_the_draws_is_missing(spark):
    df = spark.createDataFrame([(1, "a", "m", i, None if i == 0 else 1.0, 2.0) for i in range(3)], SCHEMA)
    for method in ("index", "multinomial"):
        means = means_of(df, reps=200, method=method)
        missing = sum(v[0] is None for v in means.values())
        assert 100 < missing < 180 and {v[0] for v in means.values()} == {None, 1.0}  # 1 - (2/3)^3 = 0.70
        assert {v[1] for v in means.values()} == {2.0}


def test_poisson_weights_equal_those_written_as_columns(spark):
    rows = groups(40) + groups(1, name="b") + [(1, "c", "m", 1, None, None), (1, "c", "m", 2, None, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    reps = 1030  # more than one round of hashes
    got = means_of(df, reps=reps, method="poisson")
    many = bootstrap._replicated(df, reps, 1, BY, "station")
    u = F.col("_x").cast("double") / float(bootstrap.PRIME)
    steps = [sum(np.exp(-1) / float(np.prod(np.arange(1, j + 1))) for j in range(k + 1)) for k in range(bootstrap.MOST)]
    weight = sum(((u >= float(s)).cast("int") for s in steps), F.lit(0))
    expected = many.withColumn("w", weight).groupBy(*BY, "rep").agg(
        F.try_divide(F.sum(F.col("w") * F.col("cpue")), F.sum("w")).alias("c"),
        F.try_divide(F.sum(F.col("w") * F.col("total_area")), F.sum("w")).alias("a")).collect()
    assert len(expected) == len(got) == 3 * reps
    assert all(close(got[r.year, r.district, r.rep], (r.c, r.a)) for r in expected)


def test_blocks_of_rows_and_slots_give_the_draws_of_the_plain_form(spark, monkeypatch):
    rows = groups(100) + groups(40, lambda i: None if i == 7 else float(i * i), "b", None) + groups(1, name="c")
    rows += groups(20, lambda i: float("nan") if i == 3 else 1.0, "d")
    df = spark.createDataFrame(rows, SCHEMA)
    plain = means_of(df, reps=1030)  # more than one round of hashes
    monkeypatch.setattr(bootstrap, "BROADCAST_VALUES", 0)
    monkeypatch.setattr(bootstrap, "BLOCK_ROWS", 16)
    blocks = means_of(df, reps=1030)
    assert set(plain) == set(blocks) and len(blocks) == 4 * 1030
    assert all(got == pytest.approx(want, rel=1e-12, nan_ok=True)
               for k in plain for got, want in zip(blocks[k], plain[k]) if want is not None)
    assert {k for k, v in plain.items() if v[0] is None} == {k for k, v in blocks.items() if v[0] is None}


def test_draws_of_the_plain_form_leave_their_tasks_as_sums(spark):
    df = spark.createDataFrame([r for i in range(40) for r in groups(20, name=f"g{i}")], SCHEMA).repartition(8)
    means = bootstrap.resampled_means(df, reps=100, by=BY)
    plan = means._jdf.queryExecution().executedPlan().toString()
    # Slots lie by position, so that no group's draws are over all tasks.
    assert "rangepartitioning(_pos" in plan
    assert means.count() == 4000
