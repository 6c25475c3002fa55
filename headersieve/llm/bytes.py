"""Whole batches of texts as byte arrays, so that numpy works on millions of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

#: White space: blank and tab to carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def flat_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each text begins (one more offset than texts). Null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return whole, offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes at most; a longer text stands alone."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        yield begin, end
        begin = end


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word, in order: a 64-bit hash, the text it is in and the byte where it begins.

    Words are runs of anything but white space; a word never spans two texts.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts
    places = np.flatnonzero(word)
    number = np.cumsum(first[places]) - 1
    lengths = np.bincount(number, minlength=len(starts))
    # A polynomial in an odd base, with the power by place in the word.
    powers = np.cumprod(np.full(int(lengths.max()), _ODD, dtype=np.uint64))
    terms = (data[places].astype(np.uint64) + np.uint64(1)) * powers[places - starts[number]]
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    hashes = mixed(np.add.reduceat(terms, begins) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1, starts


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row of one text, and the index of the first word of each."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = owner[:n] == owner[width - 1 :]
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * _ODD + hashes[k : k + n]
    at = np.flatnonzero(inside)
    return mixed(total[at]), at
