"""Counts, intervals and ranks against plain Python and SQL."""

import random
import re
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences

from headersieve.llm import collocations
from headersieve.llm.collocations import FmIndex, mine_collocations, transform
from headersieve.llm.queries import ORACLE_SQL, QUERIES
from headersieve.session import shared_dir

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LETTERS)):
            ws = re.findall("[^ \t]+", piece)
            own.update(tuple(ws[i : i + k]) for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in counts.items():
        n = sum(f for p, f in own.items() if len(p) == 1)
        found = {p: f for p, f in own.items() if len(p) > 1 and f >= least}
        dropped = {p[i : i + k] for p, g in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * g >= 80 * found[p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in dropped:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def test_query_equals_sql(spark, sf_dir):
    assert differences(spark, connect(sf_dir), QUERIES["op12_collocations"], ORACLE_SQL["op12_collocations"], sf_dir) is None


def test_intervals_are_those_of_both_orders():
    draw = random.Random(2)
    symbols = np.array([0, *(draw.choice([0, 1, 1, 2, 3, 4]) for _ in range(400)), 0], np.int32)
    index = FmIndex(transform(symbols), transform(symbols[::-1]))
    ring, back = [*symbols.tolist()] * 2, [*symbols.tolist()][::-1] * 2
    orders = [sorted(tuple(x[i : i + 4]) for i in range(len(symbols))) for x in (ring, back)]
    for path in ("r", "l", "rl", "lr", "rlr", "llr", "rrr"):
        phrases = index.single()
        for way in path:
            phrases = index.right(phrases) if way == "r" else index.left(phrases)
        want = Counter(tuple(ring[i : i + 1 + len(path)]) for i in range(len(symbols)))
        want = {p: n for p, n in want.items() if 0 not in p}
        got = {}
        for words, begin, mirror, n in zip(zip(*(w.tolist() for w in phrases.words)), phrases.begin, phrases.mirror, phrases.n):
            got[words] = n
            for order, phrase, at in ((orders[0], words, begin), (orders[1], words[::-1], mirror)):
                inside = [k for k, x in enumerate(order) if x[: len(phrase)] == phrase]
                assert inside == list(range(at, at + n)), (path, words)
        assert got == want


@pytest.mark.parametrize("words, top, bits", [(100, 2000, 16), (5000, 7, 6)])
def test_ranks_over_many_shards(spark, monkeypatch, words, top, bits):
    monkeypatch.setattr(collocations, "SHARD_WORDS", words)
    monkeypatch.setattr(collocations, "TOP", top)
    monkeypatch.setattr(collocations, "MOST_BITS", bits)  # a crowded table lets more through, never less
    monkeypatch.setattr(collocations, "LEAST_BITS", 6)
    monkeypatch.setattr(collocations, "PART_ROWS", 50)
    monkeypatch.setattr(collocations, "PARTS", 3)
    draw, rows = random.Random(words), []
    vocabulary = [f"{c}{k}" for c in "abÄ" for k in range(9)]
    fixed = [draw.choices(vocabulary, k=draw.randrange(2, 7)) for _ in range(12)]
    for i in range(500):
        parts = [draw.choice(fixed) if draw.random() < 0.6 else [draw.choice(vocabulary)] for _ in range(draw.randrange(9))]
        rows.append((draw.choice([" ", "\t", ", ", "  ", ".\n"]).join(" ".join(p) for p in parts), draw.choice(["x", "y", None, "und"])))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(map(tuple, mine_collocations(docs).collect()))
    assert got == brute(rows, top=top) and len(got) > 10


def test_odd_rows(spark):
    rows = [(None, "x"), ("", "x"), (" . ", None), ("one two", ""), ("A b. " * 40, "x"), ("a B c d e " * 3000 + "f", "y"), ("w " * 200, "w")]
    rows += [("go there now", None)] * 30 + [("go there", "und")] * 29 + [("x" * 50_000 + " z", "long")] * 31
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, f int, rank int")
    got = mine_collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert mine_collocations(docs.limit(0)).count() == 0
    assert mine_collocations(docs.where("text = ''")).count() == 0


def test_work_folder_holds_the_words_once(spark):
    draw = random.Random(5)
    texts = [" ".join(f"word{draw.randrange(2000)}" for _ in range(400)) for _ in range(600)]
    folder = Path(urlparse(shared_dir(spark)).path)
    before = set(folder.rglob("*"))
    mine_collocations(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string").repartition(2)).count()
    written = sum(f.stat().st_size for f in set(folder.rglob("*")) - before if f.is_file())
    assert written < 0.4 * sum(map(len, texts))


@pytest.mark.parametrize("ranges", [1, 16, 4096])
def test_packets_keep_every_count(spark, monkeypatch, ranges):
    monkeypatch.setattr(collocations, "PACKET_ROWS", 300)
    draw, want, batches = random.Random(ranges), Counter(), []
    known = [0, 1, 2**64 - 1, 1 << 24, 255 << 56, *(draw.getrandbits(64) for _ in range(200))]
    for _ in range(4):  # tasks
        shards = []
        for _ in range(5):
            own = sorted(set(draw.sample(known, 150)))
            n = [draw.choice([1, 1, 1, 2, 3, 29, 30, 31, 256, 70_000]) if draw.random() < 0.2 else 1 for _ in own]
            shards += [(np.array(own, np.uint64), np.array(n)), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for h, x in zip(own, n):
                want[h >> (64 - collocations.HASH_BITS)] += x
        batches += collocations.packets(iter(shards), ranges)
    table = pa.Table.from_batches(batches)
    assert max(table["range"].to_pylist()) < ranges and len(batches) > 4
    got = collocations.frequent_marks(spark.createDataFrame(table), ranges).toArrow()["mark"].to_numpy().view(np.uint64)
    assert sorted((got >> np.uint64(64 - collocations.HASH_BITS)).tolist()) == sorted(h for h, x in want.items() if x >= 30)
    assert 0 < len(got) < len(want)
