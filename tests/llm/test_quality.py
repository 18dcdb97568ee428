import random
from zlib import crc32

import numpy as np
import pytest
from odd_texts import ODD

from trawlframe.llm.q_quality import quality_scores
from trawlframe.llm.quality import (
    FEATURES, document_statistics, fit_discriminant, keep_good, score_statistics, settled_labels,
)


def text_of(seed, good):
    r = random.Random(seed)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(r.randint(30, 200))]
    if good:
        return " ".join(words).capitalize() + "."
    return r.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words),
                     " ".join(w + r.choice(["###", "$$$"]) for w in words), " ".join([words[0]] * 90)])


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, text_of(i, i % 4 > 0), 1, "x") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, x string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(800)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = quality_scores(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 800 and len(held) > 100
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == (r.doc_id % 4 > 0) for r in held) >= 0.97 * len(held)


def test_against_numpy(corpus):
    docs, labels = corpus
    statistics = document_statistics(docs)
    model = fit_discriminant(statistics.join(settled_labels(labels, "quality"), "doc_id"))
    rows = score_statistics(statistics, model).orderBy("doc_id").collect()
    x, y = np.array([r.x for r in rows]), np.arange(800) % 4 > 0
    means = [x[y == c].mean(axis=0) for c in (0, 1)]
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    middle = sum(own) / 2
    logs = []
    for c in (0, 1):
        s = 0.5 * own[c] + 0.5 * middle
        s = 0.98 * s + 0.02 * (np.trace(s) / len(FEATURES) + 1e-9) * np.eye(len(FEATURES))
        d = x - means[c]
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1]
                    - 0.5 * (d @ np.linalg.inv(s) * d).sum(axis=1))
    expected = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose([r.score for r in rows], expected, atol=1e-6)


def test_statistics_of_each_text_alone(docs):
    texts = ODD + ["Aé! 12 | ###", "same same same"]
    rows = document_statistics(docs(*texts)).orderBy("doc_id").collect()
    for row, text in zip(rows, texts):
        alone = document_statistics(docs(text)).first()
        assert np.allclose(row.x, alone.x) and np.isfinite(row.x).all()


def test_odd_texts_and_missing_labels(spark, docs, corpus):
    everything = docs(*ODD, (None, "no id"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels, score in ((none, 0.5), (none.union(spark.createDataFrame([(4, 1, 0)], none.schema)), 1.0),
                          (none.union(spark.createDataFrame([(4, 0, 0)], none.schema)), 0.0)):
        rows = quality_scores(everything, labels).collect()
        assert len(rows) == len(ODD) + 1 and {r.score for r in rows} == {score}
    rows = quality_scores(everything, corpus[1]).collect()
    assert len(rows) == len(ODD) + 1
    assert quality_scores(everything.limit(0), corpus[1]).count() == 0


def test_contradicted_labels_are_not_learnt(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in settled_labels(labels, "quality").collect()] == [(2, 1)]


def test_filter_keeps_whole_rows(corpus):
    docs, labels = corpus
    model = fit_discriminant(document_statistics(docs).join(settled_labels(labels, "quality"), "doc_id"))
    kept = keep_good(docs, model, 0.7)
    assert kept.schema == docs.schema
    rows = kept.collect()
    good = {i for i in range(800) if i % 4}
    assert len({r.doc_id for r in rows} & good) >= 0.99 * len(good)
    assert len({r.doc_id for r in rows} - good) <= 4
