import re

import pytest

import corpus_pipeline
from test_copies import expected
from test_pii import base_spans


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The documents, labels, and the output of every stage, each written and read again."""
    source = "/root/testdata/sf0.001"
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{source}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], source).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_stage_columns(written):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]
    for stage in written[1:-1]:
        assert stage.columns == written[0].columns


def test_quality_keeps_the_good(spark, written):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id for r in written[1].select("doc_id").collect()}
    good = {i for i, q in labels.items() if q == 1}
    assert len(good - kept) <= 0.02 * len(good)
    bad = {i for i, q in labels.items() if q == 0}
    assert len(bad & kept) <= 0.05 * len(bad) + 1


def test_one_document_of_each_group(written):
    rows = [(r.doc_id, r.text) for r in written[1].collect()]
    kept = {r.doc_id for r in written[2].collect()}
    assert kept == {component for _, _, component in expected(rows)}


def test_personal_data_is_gone(written):
    before = {r.doc_id: r.text for r in written[2].collect()}
    after = written[3].collect()
    assert {r.doc_id for r in after} == set(before)
    for row in after:
        found = base_spans(before[row.doc_id])
        assert row.n_chars == len(row.text)
        if not found and "token" not in before[row.doc_id]:
            assert row.text == before[row.doc_id] or re.search(r"\[[A-Z_]+\]", row.text)
        for kind, start, end in found:
            assert f"[{kind.upper()}]" in row.text
        assert not base_spans(row.text)


def test_run_packs_all(spark, written):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in written[3].collect()}
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == sorted(
        (r.doc_id, r.piece, r.length, r.ids_crc32) for r in written[4].collect())


NAMES = ["proposals", "_base", "_ADDED", "_place", "_text", "_id", "spans", "Spans_", "ids", "x", "score", "label",
         "rank", "part", "place", "component_id", "n_shingles"]


def small_table(spark, folder, rows, n_chars=True):
    """A folder with documents whose other columns have the names that operators use, and labels."""
    extra = ", ".join(f"`{n}` string" for n in NAMES)
    size = ", n_chars int" if n_chars else ""
    made = spark.createDataFrame(
        [(i, t, *([len(t or "")] if n_chars else []), *[f"{n} of {k}" for n in NAMES])
         for k, (i, t) in enumerate(rows)], f"doc_id long, text string{size}, {extra}")
    made.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int").write.parquet(
        f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("n_chars", [True, False])
def test_odd_rows_and_clashing_names(spark, tmp_path, monkeypatch, n_chars):
    prose = "The harbour was calm that morning and the boats came home with full nets. " * 6
    rows = [(1, prose), (1, prose), (None, prose), (2, "zq xv " * 50), (3, prose + "Write to anna@example.org or +1 555 010 4477."),
            (4, None), (5, ""), (None, None), (6, "short"), (7, "w" * 3000)]
    folder = small_table(spark, tmp_path, rows, n_chars)
    monkeypatch.setattr(corpus_pipeline, "GOOD", 0.0)  # the first stage keeps all of them
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.keep_good_documents(spark, docs, folder)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))
    single = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert single.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in single.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert {tuple(r) for r in single.collect()} <= {tuple(r) for r in docs.collect()}
    masked = corpus_pipeline.mask_personal_data(spark, docs, folder)
    assert masked.schema == docs.schema
    before = {r["proposals"]: r for r in docs.collect()}
    for row in masked.collect():
        old = before[row["proposals"]]
        assert [row[n] for n in NAMES] == [old[n] for n in NAMES]
        if n_chars and row.text is not None:
            assert row.n_chars == len(row.text)
        if row.doc_id == 3:
            assert "[EMAIL]" in row.text and "[PHONE]" in row.text
        else:
            assert row.text == old.text
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sorted({r.doc_id or 0 for r in pieces}) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, small_table(spark, tmp_path, [])).collect() == []
