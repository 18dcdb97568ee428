import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlframe.llm import permutation_index
from trawlframe.llm.permutation_index import far_pivots, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, v int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v],
                                   0, "s", 1, 2) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    known = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for q in queries:
        scores = [(-(known[q] * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((known[q] ** 2).sum())), i)
                  for i, v in known.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("blocks", [(2048, 2048), (40, 3)])
def test_recall_and_scores(spark, monkeypatch, blocks):
    monkeypatch.setattr(permutation_index, "LIST_BLOCK", blocks[0])
    monkeypatch.setattr(permutation_index, "QUERY_BLOCK", blocks[1])
    r = np.random.default_rng(2)
    middle = r.normal(size=24)
    rows = [(i, r.normal(size=24)) for i in range(1500)] + [(2000 + i, middle) for i in range(500)]  # many copies
    rows += [(3000 + i, middle + 0.1 * r.normal(size=24)) for i in range(300)]
    queries = [i for i, _ in rows if i % 50 == 0]
    df = table_of(spark, rows)
    got = {}
    for row in nearest_neighbours(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    expected = brute(rows, queries, 5)
    assert set(got) == set(queries) and all(len(g) == 5 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in queries)
    assert hits >= 0.95 * 5 * len(queries)
    scores = {q: dict(brute(rows, [q], len(rows))[q]) for q in queries[:5]}
    for q, own in scores.items():
        assert all(abs(own[i] - s) < 1e-12 for i, s in got[q])
    assert [i for i, _ in got[2000]] == [2001, 2002, 2003, 2004, 2005]  # ties: the smaller ids


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_few_vectors_are_all_found(spark, n):
    rows = [(i, np.random.default_rng(i).normal(size=4)) for i in range(n)]
    df = table_of(spark, rows)
    got = nearest_neighbours(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in got] == [(i, k + 1) for k, (i, _) in enumerate(brute(rows, [0], 5)[0])]


def test_unusable_vectors_take_no_part(spark):
    good = [(i, np.random.default_rng(i).normal(size=3)) for i in range(1, 6)]
    bad = [(0, None), (50, []), (100, [0, 0, 0]), (150, [1, None, 2]), (200, [1, float("nan"), 1]),
           (250, [float("inf"), 1, 1]), (300, [1, 2]), (None, [1, 2, 3])]
    df = table_of(spark, good + bad + good[:2])
    got = nearest_neighbours(df, df).collect()
    assert {r.query_id for r in got} == {1, 2, 3, 4, 5}
    assert all(len({r.vec_id for r in got if r.query_id == q}) == 4 for q in range(1, 6)) and len(got) == 20
    only_bad = df.where(F.col("vec_id") == 0)
    assert nearest_neighbours(only_bad, only_bad).count() == 0
    assert nearest_neighbours(df.limit(0), df).count() == 0
    assert nearest_neighbours(df, df.limit(0)).count() == 0


def test_pivots_lie_far_apart():
    r = np.random.default_rng(0)
    sample = np.concatenate([np.repeat(r.normal(size=(1, 8)), 500, axis=0), r.normal(size=(100, 8))])
    pivots = far_pivots(sample, 20)
    assert len(np.unique(pivots.round(9), axis=0)) == 20
