import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_texts import ODD
from tokenizers import Tokenizer

from trawlframe.llm import q_tokens
from trawlframe.llm.bin_slack import fullest_combination, pack_documents, plan_bins
from trawlframe.llm.bpe_codec import decode_ids, encode_texts
from trawlframe.llm.byte_bpe import WordEncoder, json_ranks, tiktoken_ranks

RANKS, JSON = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
ODDER = ["<|endoftext|>", "a<|endoftext|> b", "'s're'll'd", "don't I'LL we're  \n x", " \t\u3000\x85 12½", "e\u0301"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return WordEncoder(tiktoken_ranks(RANKS))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text_as_the_library(library, words, texts):
    flat, counts = words.encode(texts)
    assert [len(library.encode_ordinary(t)) for t in texts] == counts.tolist()
    assert [i for t in texts for i in library.encode_ordinary(t)] == flat.tolist()
    assert words.decode(flat.tolist()) == "".join(texts).encode()


def test_mixed_alphabets_and_forgetting(library, words):
    random.seed(3)
    alphabet = "abst'vermld'' \n\t\u00a0\u3000 12é€ñ漢字!?.,🙂\x1c\x85_-’"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(3000)]
    for _ in range(2):
        flat, counts = words.encode(texts)
        assert [i for t in texts for i in library.encode_ordinary(t)] == flat.tolist()
        words.forget()


def test_special_tokens_as_the_json_library():
    own, library = WordEncoder(*json_ranks(JSON)), Tokenizer.from_file(JSON)
    texts = [t or "" for t in ODD + ODDER]
    flat, counts = own.encode(texts)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, expected))
    assert flat.tolist() == sum(expected, [])


def test_round_trip_of_a_table(docs, library):
    texts = ODD + ODDER + [(None, "no id")]
    rows = decode_ids(encode_texts(docs(*texts), RANKS), RANKS).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = "no id" if row.doc_id is None else texts[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    assert encode_texts(docs("x").limit(0), RANKS).count() == 0


def test_digests(docs, library, monkeypatch):
    monkeypatch.setattr(q_tokens, "table", lambda *_: docs(*ODD))
    for row in q_tokens.op10_byte_bpe(None, "").collect():
        ids = library.encode_ordinary(ODD[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((ODD[row.doc_id] or "").encode()).hexdigest()


def packed(df, capacity):
    bins = {}
    for row in sorted(df.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert row.offset == sum(r.length for r in bins.get(row.sequence_id, []))
        bins.setdefault(row.sequence_id, []).append(row)
    assert all(sum(r.length for r in rows) <= capacity for rows in bins.values())
    return bins


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing(docs, capacity):
    texts = ODD + ODDER + ["one two three"] * 30 + [(None, "no id")]
    library = Tokenizer.from_file(JSON)
    bins = packed(pack_documents(docs(*texts), JSON, capacity), capacity)
    rows = [r for b in bins.values() for r in b]
    total = 0
    for key in [*range(len(texts) - 1), None]:
        text = "no id" if key is None else texts[key] or ""
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        total += len(ids)
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        assert all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len(bins) <= -(-total // capacity) + 2
    assert pack_documents(docs("x").limit(0), JSON).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.just(40))
def test_fullest_combination_is_the_fullest(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    chosen = fullest_combination(counts, capacity)
    assert all(n <= counts[length] for length, n in chosen.items())
    assert max(lengths) in chosen
    rest = sorted(lengths)[:-1]
    sums = {0}
    for length in rest:
        sums |= {s + length for s in sums if s + length <= capacity - max(lengths)}
    assert sum(length * n for length, n in chosen.items()) == max(lengths) + max(sums)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10**9), max_size=30))
def test_plan_uses_every_piece_once(histogram):
    used = {}
    for bins, chosen in plan_bins(histogram, 64):
        assert sum(length * n for length, n in chosen.items()) <= 64
        for length, n in chosen.items():
            used[length] = used.get(length, 0) + bins * n
    assert used == histogram
