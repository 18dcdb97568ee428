"""Byte-level BPE on length-bucketed numpy matrices, many words at once."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import regex

# Ids of distinct words that a Python worker keeps; it starts anew beyond that.
CACHE_WORDS = 400_000
NO_RANK = np.int64(1 << 40)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# The endings that the split pattern takes off after an apostrophe, in its order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    """token -> rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank)
                for token, rank in (line.split() for line in lines if line.strip())}


def json_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """token -> id in the order of the merges, and the special tokens, of a byte-level JSON file."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    # Byte-level files show a byte as itself if printable, else as a letter from U+0100 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = (b for b in range(256) if b not in set(shown))
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items()
            if token not in special}, special


class PairTable:
    """(left id, right id) -> merged id: open addressing in two arrays, looked up for whole matrices."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            # Every cut of a token into two tokens is a possible merge into it.
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        size = 1 << (4 * len(keys)).bit_length()
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NO_RANK, np.int64)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        slots = self._slot(keys)
        while len(keys):  # each round places the first key of every free slot
            free = self.keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            first = first[free[first]]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def merge_words(words: list[bytes], byte_ids: np.ndarray, pairs: PairTable) -> list[np.ndarray]:
    """The ids of each word, in the given order.

    Words of similar length form one padded matrix. In every round each row finds
    its lowest rank, merges the leftmost pair that has it, and closes the gap; rows
    without a known pair leave the matrix.
    """
    out: list[np.ndarray] = [None] * len(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = max(4, int(sizes[order[at]] * 1.25) + 1)
        end = int(np.searchsorted(sizes[order], longest, side="right"))
        end = min(end, at + max(1, 4_000_000 // longest))
        rows = order[at:end]
        at = end
        _merge_bucket([words[i] for i in rows], rows, sizes[rows], byte_ids, pairs, out)
    return out


def _merge_bucket(words, rows, sizes, byte_ids, pairs, out) -> None:
    width = int(sizes.max(initial=1))
    flat = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    ids = np.full((len(words), width), -1, np.int64)
    ids[np.arange(width) < sizes[:, None]] = flat
    sizes = sizes.copy()

    def ranks_of(left, right):
        known = right >= 0
        found = np.full(left.shape, NO_RANK, np.int64)
        found[known] = pairs.look_up(left[known] << 32 | right[known])
        return found

    ranks = ranks_of(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((len(words), 0), np.int64)
    while len(rows):
        if ranks.shape[1]:
            where = ranks.argmin(axis=1)  # the leftmost of the lowest
            best = ranks[np.arange(len(rows)), where]
        else:
            where, best = np.zeros(len(rows), np.int64), np.full(len(rows), NO_RANK)
        done = best == NO_RANK
        if done.any():
            for i in np.flatnonzero(done):
                out[rows[i]] = ids[i, :sizes[i]].copy()
            keep = ~done
            rows, ids, sizes, ranks = rows[keep], ids[keep], sizes[keep], ranks[keep]
            where, best = where[keep], best[keep]
            if not len(rows):
                return
        width = int(sizes.max())
        line = np.arange(len(rows))
        columns = np.arange(width - 1)
        moved = columns[None, :] > where[:, None]
        new = np.where(moved, ids[:, 1:width], ids[:, :width - 1])
        new[line, where] = best
        sizes = sizes - 1
        new[columns[None, :] >= sizes[:, None]] = -1
        # Pair ranks move with the ids; only the two pairs beside the merge are looked up again.
        pair_columns = np.arange(max(width - 2, 0))
        shifted = np.where(pair_columns[None, :] >= where[:, None],
                           ranks[:, 1:width - 1], ranks[:, :max(width - 2, 0)])
        ids, ranks = new, shifted
        if ranks.shape[1]:
            right = np.flatnonzero(where < ranks.shape[1])
            ranks[right, where[right]] = ranks_of(
                ids[right, where[right]], ids[right, where[right] + 1])
            left = np.flatnonzero(where > 0)
            ranks[left, where[left] - 1] = ranks_of(
                ids[left, where[left] - 1], ids[left, where[left]])


@lru_cache(1)
def _character_classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for every code point, as the regex library has them."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 0x20  # surrogates stand in no text
    text = points.tobytes().decode("utf-32-le")
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, text):
            classes[found.start():found.end()] = kind
    classes[0xD800:0xE000] = OTHER
    return classes


def split_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where the words of the split pattern begin, in code points joined from several texts.

    ``breaks`` are the places where a text begins. The pattern takes runs of letters,
    numbers or other marks, each with one blank before it; contractions after an
    apostrophe; and the rest of white space, whose last character is left to what follows.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = _character_classes()[points]
    first = np.zeros(n, bool)  # of a text
    first[breaks[breaks < n]] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= first
    start = change.copy()  # at first: every run
    space = kind == SPACE
    # The last character of a white-space run before a word begins a word of its own.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & change[1:] & ~first[1:]
    start |= last
    # A blank there takes the following run with it.
    blank = last & (points == 0x20)
    start[1:] &= ~blank[:-1]
    # An apostrophe of its own, that begins a word, takes s, t, re, ve, m, ll or d.
    marks = np.flatnonzero((points == 0x27) & start)
    marks = marks[marks + 1 < n]
    marks = marks[~first[marks + 1] & (kind[marks + 1] == LETTER)]
    for mark in marks:
        tail = points[mark + 1:mark + 3]
        ending = chr(tail[0])
        if ending in "stmd":
            size = 1
        elif (len(tail) == 2 and not first[mark + 2]
              and ending + chr(tail[1]) in CONTRACTIONS):
            size = 2
        else:
            continue
        start[mark + 1] = False
        after = mark + 1 + size
        if after < n and kind[after] == LETTER and not first[after]:
            start[after] = True
    return np.flatnonzero(start)


class WordEncoder:
    """Ids of texts; words are merged once and kept up to ``CACHE_WORDS``."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int] | None = None):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(ranks)
        self.ranks = ranks
        self.special = special or {}
        self.vocabulary = {i: token for token, i in ranks.items()}
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        merged = merge_words([w.encode("utf-8") for w in words], self.byte_ids, self.pairs)
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        for word in words:
            self.index[word] = len(self.index)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, *merged])

    def word_numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, and how many each text has."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        starts = split_starts(points, ends - np.fromiter(map(len, texts), np.int64, len(texts)))
        counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        cuts = starts.tolist()
        cuts.append(len(joined))
        words = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
        get = self.index.get
        numbers = [get(w, -1) for w in words]
        missing = list(dict.fromkeys(w for w, i in zip(words, numbers) if i < 0))
        if missing:
            self._learn(missing)
            index = self.index
            numbers = [index[w] if i < 0 else i for w, i in zip(words, numbers)]
        return np.array(numbers, np.int64), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has. Special tokens first, if any."""
        plain, pieces, specials = [], [], []
        pattern = "|".join(map(regex.escape, self.special)) if self.special else None
        for text in texts:
            parts = regex.split(f"({pattern})", text) if pattern and any(
                s in text for s in self.special) else [text]
            plain += parts[::2]
            specials += [self.special[p] for p in parts[1::2]] + [-1]  # -1: a text ends here
            pieces.append(len(parts[::2]))
        numbers, counts = self.word_numbers(plain)
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        flat = self.ids[np.arange(total) - np.repeat(ends - sizes - self.starts[numbers], sizes)]
        word_ends = np.concatenate([[0], ends])
        piece_ends = word_ends[np.cumsum(counts)]
        lengths = np.diff(piece_ends, prepend=0)
        if not self.special:
            return flat, lengths
        extra = np.array(specials, np.int64)
        flat = np.insert(flat, piece_ends[extra >= 0], extra[extra >= 0])
        per_text = np.add.reduceat(lengths, np.cumsum([0, *pieces[:-1]])) if pieces else lengths
        return flat, per_text + np.array(pieces, np.int64) - 1

    def decode(self, ids: Iterator[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(2)
def encoder(load: Callable, path: str) -> WordEncoder:
    """One encoder for each file and worker."""
    loaded = load(path)
    return WordEncoder(*loaded) if isinstance(loaded, tuple) else WordEncoder(loaded)
