import random

import pytest

from odd_texts import ODD
from trawlframe.llm import line_dedup
from trawlframe.llm.line_dedup import BLANKS, drop_common_lines
from trawlframe.llm.common import LOWER, UPPER


def brute(rows, least_chars=20, least_docs=3):
    """{(id, text): (kept text, lines, dropped)} by plain dictionaries."""
    fold = str.maketrans(UPPER, LOWER)
    split = [(i, t, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, _, lines in split:
        for line in lines:
            if i is not None:
                holders.setdefault(line.strip(BLANKS).translate(fold), set()).add(i)
    out = {}
    for i, t, lines in split:
        kept = [line for line in lines
                if not (len(k := line.strip(BLANKS).translate(fold)) >= least_chars
                        and len(holders.get(k, ())) >= least_docs and max(holders[k]) != i)]
        out[i, t] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def check(docs, rows, **options):
    got = drop_common_lines(docs(*rows), **options)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    expected = brute(rows, **options)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(
        repr((i, *expected[i, t])) for i, t in rows)


SHARED = "A line that very many documents hold"


def some_rows(seed):
    r = random.Random(seed)
    pool = [SHARED, f"  {SHARED.upper()}\t", "short", "", "exactly twenty chars", "ÄÖ straße ünïcode größer 漢字",
            "äÖ straße ünïcode größer 漢字", "\x0b\x0cform feeds around a line\r", "nineteen characters"]
    pool += [f"line number {k} of the pool, long enough" for k in range(30)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 12)))) for i in range(60)]
    return rows + [(100 + i, f"{SHARED}\nown text {i} of one document\n{SHARED}") for i in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_dictionaries(docs, seed):
    check(docs, some_rows(seed))


def test_equals_plain_dictionaries_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    check(docs, some_rows(3) + [(None, SHARED), (None, None)])


@pytest.mark.parametrize("options", [{"least_chars": 1, "least_docs": 2}, {"least_chars": 30, "least_docs": 1}])
def test_other_limits(docs, options):
    check(docs, some_rows(4), **options)


def test_odd_texts_repeats_and_null_ids(docs):
    rows = list(enumerate(ODD)) + [(5, "another text of id 5\nthe line of three documents"), (None, None),
                                   (5, "the line of three documents"), (6, "the line of three documents"),
                                   (7, "the line of three documents\n\nthe line of three documents"),
                                   (7, "the line of three documents"), (None, "the line of three documents\nx")]
    check(docs, rows)


def test_rows_of_one_id_are_one_document(docs):
    line = "the same line, in rows of one id"
    check(docs, [(1, line), (1, f"{line}\nand more"), (1, line), (2, line)])


def test_a_text_of_very_many_lines_to_drop(docs):
    long = "\n".join(f"line {k % 50_000} of the long text" for k in range(100_000))
    rows = [(1, long), (2, long), (3, long + "\nend")]
    check(docs, rows)


def test_no_documents(docs):
    assert drop_common_lines(docs((1, "a")).limit(0)).count() == 0


def test_other_columns_with_clashing_names_are_ignored(spark):
    df = spark.createDataFrame([(i, SHARED, 1, 2, 3, "h", 4, "k") for i in range(3)],
                               "doc_id long, text string, _id int, _text int, _hash int, key string, place int, places string")
    got = drop_common_lines(df).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_dropped) for r in got] == [("", 1, 1), ("", 1, 1), (SHARED, 1, 0)]
