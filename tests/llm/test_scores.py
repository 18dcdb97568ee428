import collections
import math
import os
import random
import re
from zlib import crc32

import numpy as np
import pytest
from odd_texts import ODD
from pyspark.sql import functions as F

from trawlframe.llm import suffix_tree
from trawlframe.llm.suffix_tree import SuffixTree, score_documents


def training():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", fold(text or "")) + [None]


def trains(key):
    return key is None or crc32(str(key).encode()) % 5 != 1


def prose(seed, n=80):
    """Words of a chain in which some words ask for certain others."""
    r, words = random.Random(seed), ["a"]
    while len(words) < n:
        follow = {"a": ["b", "c"], "b": ["a"], "c": ["d", "e", "a"]}.get(words[-1])
        words.append(r.choice(follow) if follow and r.random() < 0.9 else r.choice(["a", "c", f"r{r.randrange(4000)}"]))
    return " ".join(words)


def check_base(rows, got):
    texts = [(k, tokens(t)) for k, t in rows]
    counts = collections.Counter(w for k, t in texts if trains(k) for w in t)
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted(
        (str(k), not trains(k), len(t), sum(counts[w] > 0 for w in t), total,
         round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t), 6)) for k, t in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in got) == expected


@pytest.mark.parametrize("common", [1 << 20, 16])
def test_base_scores_and_gain(docs, monkeypatch, common):
    monkeypatch.setattr(suffix_tree, "COMMON_WORDS", common)  # 16: almost all words meet their counts by bucket
    monkeypatch.setattr(suffix_tree, "SYMBOLS", min(common, 1 << 16))
    monkeypatch.setattr(suffix_tree, "BUFFER", 1000)
    rows = list(enumerate(ODD + [prose(i) for i in range(150)] + [prose(1)] * 3)) + [(None, "a b a"), (3, "twice"), (3, "twice")]
    got = score_documents(docs(*rows).repartition(4), training()).collect()
    check_base(rows, got)
    held = [r for r in got if r.held_out and r.n_tokens > 50]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 5 * len(held)


def test_probabilities_add_up_to_one(spark, docs, monkeypatch):
    """After every kept context, the words seen in training and one unknown share probability 1."""
    kept = {}
    plain = suffix_tree._tree

    def remember(counted, words):
        kept["words"], kept["tree"] = words, plain(counted, words)
        return kept["tree"]

    monkeypatch.setattr(suffix_tree, "_tree", remember)
    texts = [prose(i) for i in range(200)]
    score_documents(docs(*texts), F.lit(True)).count()
    words, tree = kept["words"], kept["tree"]
    assert len(tree.contexts) > 4 and (tree.contexts >> 17 > 0).any()
    everything = words.base(words.counts)
    unknown = words.base(np.zeros(1))
    assert everything.sum() + unknown.sum() == pytest.approx(1)
    symbols = words.symbols
    assert len(words.keys) == words.distinct  # so small a corpus has no uncommon word
    for context in tree.contexts:
        first, n = context & ((1 << 17) - 1), len(symbols)
        p, q = everything, unknown
        for c in ([first] if context == first else [first, context]):
            p = tree.smooth(np.full(n, c), symbols, p)
            q = tree.smooth(np.full(1, c), np.zeros(1, np.int64), q)
        assert p.sum() + q.sum() == pytest.approx(1)
        assert (p > 0).all() and (q > 0).all()


def test_an_empty_tree_leaves_probabilities(docs):
    tree = SuffixTree(*(np.empty(0, t) for t in (np.int64, float, np.int64, float)))
    assert tree.smooth(np.array([1]), np.array([1]), np.array([0.25])).tolist() == [0.25]


def test_odd_tables(docs):
    assert score_documents(docs("x").limit(0), training()).count() == 0
    rows = score_documents(docs(*ODD), F.lit(False)).collect()  # nothing to learn from
    assert len(rows) == len(ODD)
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.held_out and math.isfinite(r.score) for r in rows)
    check_base([(0, None)], score_documents(docs(None), training()).collect())


def tree_scores(rows):
    """Score of each text by plain dictionaries, contexts and successors counted from 2 on."""
    texts = [(k, tokens(t)) for k, t in rows]
    counts = collections.Counter(w for k, t in texts if trains(k) for w in t)
    total, after = sum(counts.values()), collections.defaultdict(collections.Counter)
    for k, t in texts:
        for i in range(len(t) if trains(k) else 0):
            for depth in (1, 2):
                if i >= depth:
                    after[tuple(t[i - depth:i])][t[i]] += 1
    kept = {}

    def probability(context, word):
        if not context:
            return (counts[word] + 0.5) / (total + 0.5 * (len(counts) + 1))
        p = probability(context[1:], word)
        if context in kept:
            n, successors = kept[context]
            p *= 1 - sum(c - 0.75 for c in successors.values()) / n
            p += (successors[word] - 0.75) / n if word in successors else 0
        return p

    for context in sorted(after, key=len):
        n = sum(after[context].values())
        successors = {w: c for w, c in after[context].items() if c >= 2}
        shorter = {w: probability(context[1:], w) for w in successors}
        gain = sum(c / n * math.log(c / n / shorter[w]) for w, c in successors.items())
        rest, rest_shorter = (max(1e-12, 1 - x) for x in (sum(successors.values()) / n, sum(shorter.values())))
        if n >= 2 and n * (gain + rest * math.log(rest / rest_shorter)) >= 20:
            kept[context] = n, successors
    return {k: sum(math.log10(probability(tuple(t[max(0, i - 2):i]), w)) for i, w in enumerate(t)) for k, t in texts}


@pytest.mark.parametrize("bound", [1 << 20, 32])
def test_rare_contexts_are_kept_whatever_is_in_memory(docs, monkeypatch, bound):
    for name in ("COMMON_WORDS", "SYMBOLS", "CONTEXTS", "SUCCESSORS"):
        monkeypatch.setattr(suffix_tree, name, min(bound, 1 << 16))
    if bound == 32:
        monkeypatch.setattr(suffix_tree, "FILTER_BITS", 4096, raising=False)  # so full that most is looked up
        monkeypatch.setattr(suffix_tree, "BUFFER", 500)
    phrase = " ".join(f"seldom{i}" for i in range(12))
    rows = list(enumerate(ODD + [prose(i) + (f" {phrase} end" if i % 25 == 0 else "") for i in range(150)] + [phrase]))
    got = {r.doc_id: r.score for r in score_documents(docs(*rows).repartition(4), training()).collect()}
    assert got == pytest.approx(tree_scores(rows), abs=1e-6)


def test_tables_between_are_gone_when_the_model_is_made(spark):
    from urllib.parse import urlparse

    from trawlframe.session import cut_lineage, scratch_folder

    docs = spark.createDataFrame(
        [(i, "a b c a b d " * (1 + i % 3)) for i in range(30)], "doc_id long, text string")
    cut_lineage(spark.range(1))  # so that there is a checkpoint folder

    def left():
        folders = (scratch_folder(spark), spark.sparkContext.getCheckpointDir())
        tables, checkpoints = (os.listdir(urlparse(f).path) if os.path.isdir(urlparse(f).path) else [] for f in folders)
        return {x for x in tables if x.startswith("table-")}, {x for x in checkpoints if x.startswith("rdd-")}

    tables, checkpoints = left()
    assert score_documents(docs, F.lit(True)).count() == 30
    now = left()
    assert not now[0] - tables
    assert len(now[1] - checkpoints) <= 3  # words, gains, scored texts
