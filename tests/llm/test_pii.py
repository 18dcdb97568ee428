import random
import re

from odd_texts import ODD
from pyspark.sql import functions as F

from trawlframe.llm.pii import (
    BASE_KINDS, KINDS, LABELERS, estimate_labelers, find_pii, learn_spans, mask_spans, train_classifier,
)

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "")
            if valid(k, m.group())]


def noise(seed):
    r = random.Random(seed)
    bits = ["1.2.3.4", "256.1.1.1", "0001.002.3.4.5.6.7.8", "a.b@c.d", "a@b@c.de", "x@y", "a_b%@q-r.st.", "@", "+1 (743) 555-3824",
            "+1", "+49 30 1234567", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "1 2 3", "é",
            "漢🙂", " ", "\n", "-", ".", "(", "9" * 20, "token = \"24be64439e3e49cf46b2d7c90f3602a3\"", "a@b.c_d@e.f", "555-3824",
            "12345678901234567890", "1.1.1.1.", "a.@b-.c--d", "+" + "1" * 16, "x" * 40, "A1" * 12]
    return "".join(r.choices(bits, k=r.randint(1, 14)))


def test_base_spans_against_brute_force(docs):
    texts = ODD + [noise(i) for i in range(600)]
    df = docs(*texts)
    model = learn_spans(df)
    rows = find_pii(df, model).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id]
        assert [(s.kind, s.start, s.end) for s in row.spans if s.base] == base_spans(text), text
        assert all(0 <= s.score <= 1 and 0 <= s.start < s.end <= len(text) for s in row.spans)
        order = [(KINDS.index(s.kind), s.start) for s in row.spans]
        assert order == sorted(order)
        assert row.label == "score" and row.ids == "ids" and row.n_chars == 7


def test_secrets_are_added_and_prose_is_not(docs):
    secret = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = [f'le token = "{secret}" est' for _ in range(20)] + ["plain words of no kind 12 and 3 more"] * 20
    texts += ["Write to jane.doe@example.com or +1 (743) 555-3824, 10.0.0.1"] * 20
    df = docs(*texts)
    rows = {r.doc_id: r.spans for r in find_pii(df, learn_spans(df)).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[0]] == [("secret", 12, 52)]
    assert rows[20] == []
    assert [s.kind for s in rows[40]] == ["email", "ip", "phone"]


def test_reliabilities_are_recovered():
    r = random.Random(1)
    truth, accuracy = [r.random() < 0.3 for _ in range(6000)], [0.95, 0.9, 0.85, 0.8, 0.75, 0.7]
    counted = {}
    for t in truth:
        votes = tuple((1 if t else -1) * (1 if r.random() < a else -1) for a in accuracy)
        counted[votes] = counted.get(votes, 0) + 1
    patterns = sorted((0, v, n) for v, n in counted.items())
    tables, belief = estimate_labelers(patterns)
    for table, a in zip(tables, accuracy):
        assert abs(table[1][1] - a) < 0.05 and abs(table[-1][0] - a) < 0.05
    kinds, weights = train_classifier(patterns, belief)
    right = sum(n for (k, v, n), b in zip(patterns, belief)
                if (kinds[k] + sum(w[x] for w, x in zip(weights, v)) > 0) == (b > 0.5))
    assert right > 0.97 * len(truth)
    assert len(tables) == len(LABELERS)


def test_no_proposals_and_empty_tables(docs):
    df = docs("only words", None)
    rows = find_pii(df, learn_spans(df)).collect()
    assert [r.spans for r in rows] == [[], []]
    assert find_pii(df.limit(0), learn_spans(df.limit(0))).count() == 0


def test_masks(docs):
    texts = ODD + [noise(i) for i in range(200)] + ["1.1.1.1 " * 2000]
    df = docs(*texts)
    found = find_pii(df, learn_spans(df))
    for row in found.withColumn("masked", mask_spans(F.col("text"), F.col("spans"))).collect():
        if row.text is None:
            assert row.masked is None
            continue
        merged = []
        for s in sorted(row.spans, key=lambda s: (s.start, s.end, s.kind)):
            if merged and s.start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s.end)
            else:
                merged.append([s.start, s.end, s.kind])
        expected = row.text
        for start, end, kind in reversed(merged):
            expected = f"{expected[:start]}[{kind.upper()}]{expected[end:]}"
        assert row.masked == expected
    assert set(BASE_KINDS) < set(KINDS)
