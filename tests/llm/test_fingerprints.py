import hashlib
import random

import numpy as np
import pytest
from odd_texts import ODD

from trawlframe.llm import syncmers
from trawlframe.llm.syncmers import anchors, edited_fingerprints, fingerprint_documents, likeness, written

random.seed(5)
WORDS = ["".join(random.choices("abcdefgé漢", k=random.randint(1, 9))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (key, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        prints = [anchors([t])[0][1] for t in (text, edited, after)]
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(prints[0]),
                    written(prints[1]), likeness(prints[0], prints[1]), likeness(prints[0], prints[2])))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 5])
def test_edited_neighbours(spark, docs, partitions):
    rows = [(i * 7, t) for i, t in enumerate(ODD)] + [(1000 + i, prose(80, i // 3)) for i in range(300)]
    rows += [(None, "no id"), (None, None), (1004, "twice"), (1004, "twice")]
    df = docs(*random.Random(1).sample(rows, len(rows))).repartition(partitions)
    got = sorted((tuple(r) for r in edited_fingerprints(df).collect()), key=str)
    assert got == expected(rows)


@pytest.mark.parametrize("rows", [[], [(3, "alone and only")], [(1, "a"), (2, "bc")], [(5, "x")] * 3, [(None, "n")]])
def test_few_rows(docs, rows):
    df = docs(*rows) if rows else docs("x").limit(0)
    assert sorted((tuple(r) for r in edited_fingerprints(df).collect()), key=str) == expected(rows)


def test_anchors_are_closed_syncmers_of_the_window_alone():
    text = prose(300, 9)
    at, hashes = anchors([text])[0]
    assert len(at) > 20
    for shift in (1, 17, 100):
        moved = "é" * shift + text
        later = dict(zip(*(a.tolist() for a in anchors([moved])[0])))
        assert all(later[p + shift] == h for p, h in zip(at.tolist(), hashes.tolist()))
    windows = np.diff(at)
    assert windows.max() <= syncmers.ANCHOR - syncmers.INNER + 1  # the window guarantee


def test_batches_do_not_matter():
    texts = [t or "" for t in ODD] + [prose(n, n) for n in (3, 6, 7, 8, 9, 60)]
    together = anchors(texts)
    for text, (at, hashes) in zip(texts, together):
        alone = anchors([text])[0]
        assert (at == alone[0]).all() and (hashes == alone[1]).all()
        assert (len(hashes) == 0) == (text == "")


def test_likeness():
    a, b = anchors([prose(300, 1), prose(300, 2)])
    half = anchors([prose(300, 1)[:900] + prose(300, 2)[900:]])[0]
    assert likeness(a[1], a[1]) == 1 and likeness(a[1], b[1]) == 0
    assert likeness(a[1][:0], a[1][:0]) == 1 and likeness(a[1][:0], a[1]) == 0
    assert 0.3 < likeness(a[1], half[1]) < 0.8
    assert likeness(a[1], half[1]) == likeness(half[1], a[1])
    backwards = np.arange(9, dtype=np.uint32)
    assert likeness(backwards, backwards[::-1]) == pytest.approx(2 / 18)


def test_table_of_fingerprints(docs):
    rows = fingerprint_documents(docs(*ODD)).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: written(anchors([t or ""])[0][1]) for i, t in enumerate(ODD)}
    assert all(len(r.positions) == len(r.hashes) == len(r.fingerprint) // 8 for r in rows)
