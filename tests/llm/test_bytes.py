"""Words and windows of flat batches against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from headersieve.llm.bytes import blocks, flat_texts, hashed_words, windows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(seed):
    draw = random.Random(seed)
    parts = ["a", "bb", "é", " ", "\n", "\t", "日本", "\x00", "\x1f", "x y", ""]
    return [None, "", " "] + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(200)]


def test_words_are_those_of_the_texts():
    some = texts(1)
    data, offsets = flat_texts(pa.array(some))
    hashes, owner, _ = hashed_words(data, offsets)
    want = [(i, w) for i, t in enumerate(some) for w in words(t)]
    assert owner.tolist() == [i for i, _ in want]
    told = {}
    for h, (_, w) in zip(hashes.tolist(), want, strict=True):
        assert told.setdefault(w, h) == h
    assert len(set(told.values())) == len(told)


def test_windows_stay_in_their_text():
    some = texts(2)
    hashes, owner, _ = hashed_words(*flat_texts(pa.array(some)))
    grams, at = windows(hashes, owner, 3)
    want = [(i, tuple(words(t)[k : k + 3])) for i, t in enumerate(some) for k in range(len(words(t)) - 2)]
    assert owner[at].tolist() == [i for i, _ in want]
    assert len(set(grams.tolist())) == len({w for _, w in want})


def test_slices_and_blocks():
    some = pa.array(texts(3))
    data, offsets = flat_texts(some.slice(5, 20))
    assert bytes(data).decode() == "".join(t or "" for t in some.slice(5, 20).to_pylist())
    assert flat_texts(pa.array([], pa.string()))[1].tolist() == [0]
    offsets = np.array([0, 3, 3, 50, 51, 60])
    assert list(blocks(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
