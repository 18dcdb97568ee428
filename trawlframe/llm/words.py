"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from trawlframe.llm.common import CHUNK_CHARS, slices

# The bytes between words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)[_FOLD]


def text_bytes(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, where each row's bytes begin, and the end) in bounded chunks."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = (np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None
            else np.empty(0, np.uint8))
    for a, b in slices(np.diff(offsets).tolist(), limit):
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, length in bytes, and row of every word of lower-cased (A-Z) texts in UTF-8.

    Words are runs without blanks and bytes 9 to 13. The hash is a polynomial in the
    place within the word, over random values of the bytes.
    """
    inside = ~WHITE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    text_starts = bounds[:-1][bounds[:-1] < len(data)]
    starts[text_starts] = inside[text_starts]
    at = np.flatnonzero(inside)
    firsts = np.flatnonzero(starts[at])
    if not len(firsts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.diff(firsts, append=len(at))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()) - 1, BASE, np.uint64)]))
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    hashes = np.add.reduceat(_BYTE_VALUES[data[at]] * powers[place], firsts)
    rows = np.searchsorted(bounds, at[firsts], side="right") - 1
    return mixed(hashes + sizes.astype(np.uint64)), sizes, rows


def per_row(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Bounds of each row's stretch in an array whose rows ascend."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
