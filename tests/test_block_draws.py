"""Sums of one block of draws against the formula of a draw."""

import time

import numpy as np
import pandas as pd
import pytest

from trawlframe.operators import bootstrap as b


def block(n, first, many, seed=0):
    rng = np.random.default_rng(seed)
    ask = pd.DataFrame({"_a": rng.integers(0, b.PRIME, many), "_b": rng.integers(0, b.PRIME, many), "_n": n})
    ask.loc[0, ["_a", "_b"]] = b.PRIME - 1
    at = rng.permutation(np.arange(first, min(n, first + 500)))
    rows = pd.DataFrame({"_row": at, "cpue": rng.random(len(at)), "total_area": 401.0 * at,
                         "no_cpue": 0.0, "no_total_area": 0.0})
    return ask, rows


def plain(ask, rows, reps, number):
    rows = rows.sort_values("_row")
    base, many = rows["_row"].min(), min(reps - number * b.ROUND, b.ROUND)
    out = np.zeros((5, many))
    for rep in range(many):
        at = (ask["_a"].to_numpy() + rep * ask["_b"].to_numpy()) % b.PRIME % ask["_n"].iloc[0] - base
        at = at[(at >= 0) & (at < len(rows))]
        out[:, rep] = [len(at), *(rows[c].to_numpy()[at].sum() for c in ("cpue", "total_area", "no_cpue", "no_total_area"))]
    return out


@pytest.mark.parametrize("n, part, missing", [(500, 0, False), (1700, 0, True), (1700, 1, False), (1700, 3, True), (1, 0, False)])
def test_sums_of_a_block_are_those_of_its_draws(monkeypatch, n, part, missing):
    monkeypatch.setattr(b, "SLOTS_AT_ONCE", 700, raising=False)
    ask, rows = block(n, 500 * part, 3000)
    if missing:
        rows.loc[[0, 3], ["cpue", "no_cpue"]] = [0.0, 1.0]
        rows.loc[5, "total_area"] = np.nan
    got = b._block_sums((1, 1, 0, part), ask, rows, b.ROUND + 90, 500)
    want = plain(ask, rows, b.ROUND + 90, 1)
    assert got["start"][0] == b.ROUND + 1
    assert np.array_equal(got["nan_area"][0], np.isnan(want[2]))
    for name, values in zip(b.BLOCK_SUMS, np.nan_to_num(want)):
        assert np.allclose(got[name][0], values, rtol=1e-12), name


def test_a_draw_costs_much_less_than_its_plain_formula():
    ask, rows = block(500, 0, 200_000)
    times = []
    for run in (lambda: plain(ask, rows, 40, 0), lambda: b._block_sums((1, 0, 0, 0), ask, rows, 40, b.BLOCK_ROWS)):
        spent = []
        for _ in range(3):
            start = time.perf_counter()
            run()
            spent.append(time.perf_counter() - start)
        times.append(min(spent))
    assert times[1] < 0.6 * times[0], times
