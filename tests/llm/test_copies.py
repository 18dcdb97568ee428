import random

import numpy as np
import pytest
from odd_texts import ODD

from trawlframe.llm import ngram_join
from trawlframe.llm.components import components
from trawlframe.llm.ngram_join import FrequentItems, near_duplicates, one_of_each

VOCABULARY = [f"w{i}" for i in range(3000)]


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0D]+", fold(text or ""))]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    """(id, size, component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    leader = list(range(len(rows)))

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    leader[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None and sets[i]:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(sets[i]), least.get(find(i)) if sets[i] else key)
                   for i, (key, _) in enumerate(rows)), key=str)


def edited(words, r, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(VOCABULARY)
    return words


def corpus(seed):
    """Groups of copies of very different closeness, shared passages, and loners."""
    r = random.Random(seed)
    texts = []
    passage = r.choices(VOCABULARY, k=60)
    for _ in range(12):
        base = r.choices(VOCABULARY, k=r.randint(20, 150))
        for _ in range(r.choice([1, 2, 3, 9])):
            texts.append(edited(base, r, r.choice([0, 0, 1, 2, len(base) // 25, len(base) // 12])))
    for _ in range(40):
        texts.append(r.choices(VOCABULARY, k=r.randint(30, 120)) + passage)
    base = r.choices(VOCABULARY, k=100)
    for i in range(50):  # a chain: ends are unlike, neighbours alike
        base = edited(base, r, 1)
        texts.append(base + r.choices(VOCABULARY, k=i % 3))
    texts += [passage] * 5 + [passage[:40]] * 3
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed, short_list", [(1, 2), (2, 64), (3, 6)])
def test_against_all_pairs(docs, monkeypatch, seed, short_list):
    # Short lists make the pivots and what is derived from them do the work.
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short_list)
    monkeypatch.setattr(ngram_join, "BUCKET_ENTRIES", 4 if short_list == 2 else 1 << 16)
    monkeypatch.setattr(ngram_join, "BUFFER", 500)
    rows = [(i * 3 + 1, t) for i, t in enumerate(corpus(seed) + ODD)] + [(None, ODD[9]), (None, "a b c"), (7, None)]
    df = docs(*random.Random(4).sample(rows, len(rows))).repartition(5)
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == expected(rows)


def test_threshold_itself_links(docs):
    # 7 and 9 shingles share 7: 7 / 9; 6 of 8 is 0.75 exactly; 5 of 7 is less.
    words = VOCABULARY[:20]
    rows = [" ".join(words[:10]), " ".join(words[:12])]
    assert expected(list(enumerate(rows))) == sorted(
        (tuple(r) for r in near_duplicates(docs(*rows)).collect()), key=str) == [(0, 6, 0), (1, 8, 0)]
    rows = [" ".join(words[:9]), " ".join(words[:11])]
    assert [r.component_id for r in near_duplicates(docs(*rows)).orderBy("doc_id").collect()] == [0, 1]


def test_empty_table_and_only_empty_texts(docs):
    assert near_duplicates(docs("x").limit(0)).count() == 0
    rows = near_duplicates(docs("", None, " ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_one_of_each_group_stays(spark, docs, tmp_path):
    rows = [(i, t) for i, t in enumerate(corpus(3) + ODD)] + [(None, ODD[9]), (None, None), (3, ODD[9]), (3, ODD[9])]
    docs(*random.Random(4).sample(rows, len(rows))).repartition(4).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    kept = one_of_each(df)
    assert kept.schema == df.schema
    groups = {}
    for i, (key, size, component) in enumerate(expected([(i, t) for i, (_, t) in enumerate(rows)])):
        groups.setdefault((component, size > 0), []).append(rows[key])
    stay = sorted(((min(g, key=lambda r: (r[0] is None, r[0] or 0))[0], 1) for g in groups.values()), key=str)
    assert sorted(((r.doc_id, 1) for r in kept.collect()), key=str) == stay


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 560)]
    leader = {}

    def find(x):
        while leader.setdefault(x, x) != x:
            x = leader[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        leader[max(x, y)] = min(x, y)
    got = {n: label for n, label in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}


def test_frequent_items_are_all_found(monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTERS", 50)
    monkeypatch.setattr(ngram_join, "BUFFER", 100)
    r = np.random.default_rng(1)
    stream = np.concatenate([np.repeat(np.arange(20, dtype=np.uint64), 160), r.integers(100, 10**9, 3000).astype(np.uint64)])
    r.shuffle(stream)
    parts = []
    for half in np.array_split(stream, 7):
        part = FrequentItems()
        for chunk in np.array_split(half, 11):
            part.add(chunk)
        part.settle()
        parts.append(part)
    whole = FrequentItems()
    for part in parts:
        whole.add(part.keys, part.counts)
    whole.settle()
    often = {k for k, n in zip(*np.unique(stream, return_counts=True)) if n > len(stream) / 50}
    assert often and often <= set(whole.keys.tolist()) and len(whole.keys) <= 50


def test_a_crowd_near_the_threshold_is_not_asked_pair_by_pair(docs, monkeypatch):
    # Two changed words in a hundred each: any two texts are alike to 0.66, a few to more.
    r = random.Random(9)
    base, texts = r.choices(VOCABULARY, k=100), []
    for i in range(60):
        words = list(base)
        for at in r.sample(range(4, 96), 2):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    asked = []
    questions = ngram_join._open_questions

    def counted(*args):
        asked.append(questions(*args).count())
        return questions(*args)

    monkeypatch.setattr(ngram_join, "_open_questions", counted)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = list(enumerate(texts))
    got = sorted((tuple(x) for x in near_duplicates(docs(*rows)).collect()), key=str)
    assert got == expected(rows)
    assert len({c for _, _, c in got}) > 20
    # Before, 60 texts asked each other one by one.
    assert 0 < sum(asked) < 60 * 60 / 5
