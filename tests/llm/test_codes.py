import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlframe.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, v int, code string, position int, salt string"


def table_of(spark, rows):
    """rows: (id, vector or None, label)."""
    return spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "c", 2, "s")
         for i, v, label in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain Lloyd rounds over Python whole numbers."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) for c in v] for _, v, _ in rows]
    cuts = [a.tolist() for a in np.array_split(np.arange(len(x[0])), parts)]
    order = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, [float(c) for c in rows[j][1]]))
    books = [[[x[j][c] for c in cut] for j in order[:entries]] for cut in cuts]

    def nearest(own, book):
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, cut in enumerate(cuts):
            members = {}
            for row in x:
                own = [row[c] for c in cut]
                members.setdefault(nearest(own, books[p])[1], []).append(own)
            for k, own in members.items():
                books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    told = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), row in zip(rows, x):
        near = [nearest([row[c] for c in cut], books[p]) for p, cut in enumerate(cuts)]
        error = sum(d for d, _ in near)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in near), error, label))
    return [(*row, by_label[row[3]], told) for row in out]


def check(spark, rows, more=(), **options):
    got = vc.vector_codes(table_of(spark, list(rows) + list(more)), **options)
    assert got.columns == ["vec_id", "code", "error", "label", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows, **options)))


def some_rows(n, d, seed, spread=0.1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d))
    return [(i, centres[r.integers(6)] + spread * r.normal(size=d), int(r.integers(3)) or None) for i in range(n)]


@pytest.mark.parametrize("owner_rows", [1_000_000, 7])
def test_equals_plain_lloyd(spark, monkeypatch, owner_rows):
    monkeypatch.setattr(vc, "OWNER_ROWS", owner_rows)
    rows = some_rows(300, 8, 1)
    same = rows[5][1]
    check(spark, rows + [(1000 + i, same, 7) for i in range(150)], entries=20)  # a third are copies


@pytest.mark.parametrize("n", [1, 2, 30])
def test_fewer_rows_than_entries(spark, n):
    check(spark, some_rows(n, 8, n))


def test_parts_of_unequal_width_and_ties(spark):
    check(spark, [(i, [i % 3, 0, 0, -(i % 3), 1, 0.5][:d], None) for d in (6,) for i in range(40)], entries=5)
    check(spark, [(i, [float(i % 2), 1.0], 1) for i in range(9)], entries=4)  # narrower than the parts


def test_unusable_vectors_null_ids_and_repeats(spark):
    rows = some_rows(40, 8, 3)
    rows += rows[:3] + [(3, rows[0][1], 9), (None, rows[4][1], None)]
    bad = [(50, None, 1), (51, [1.0] * 7 + [None], 1), (52, [float("nan")] * 8, 1), (53, [float("inf")] * 8, 1),
           (54, [], 1), (55, [1.0] * 5, 1)]
    check(spark, rows, bad, entries=10)


def test_no_rows(spark):
    bad = table_of(spark, [(1, None, 1), (2, [], 1)])
    assert vc.vector_codes(bad).count() == 0
    assert vc.vector_codes(bad.limit(0)).count() == 0
    assert vc.vector_codes(bad.limit(0).drop("label")).columns[3] == "label"


def test_large_numbers_stay_exact():
    r = np.random.default_rng(0)
    x, book = r.integers(-2 ** 27, 2 ** 27, (50, 16)), r.integers(-2 ** 27, 2 ** 27, (9, 16))
    index, distance = vc.nearest(x, book)
    for row, i, d in zip(x.tolist(), index, distance):
        assert (d, i) == min((sum((a - b) ** 2 for a, b in zip(row, e)), k) for k, e in enumerate(book.tolist()))
    assert vc.whole_numbers(np.array([[1e300] * 64, [-1e300] * 64]), 1024).tolist() == [[2 ** 27] * 64, [-2 ** 27] * 64]


def test_only_parts_that_change_entry_are_shuffled(spark, monkeypatch):
    """The tables written are the members once, then movers alone."""
    tables = []

    def kept(df):
        tables.append(df.sparkSession.createDataFrame(df.collect(), df.schema))
        return tables[-1]

    monkeypatch.setattr(vc, "written", kept)
    monkeypatch.setattr(vc, "discard", lambda df: None)
    rows = table_of(spark, some_rows(400, 8, 5, spread=0.4)).select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    vc.learn_codebooks(rows, 8, entries=12)
    counts = [t.agg(F.sum("n")).first()[0] or 0 for t in tables]
    assert counts[0] == 4 * 400 and 0 < counts[1] < 800 and counts[-1] < counts[1]
    assert all(t.where("old = entry").isEmpty() for t in tables)
