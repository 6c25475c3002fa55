"""The best documents of each item against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, differences

from headersieve.llm import lexical_search
from headersieve.llm.lexical_search import ImpactLists, rank_documents
from headersieve.llm.queries import ORACLE_SQL, QUERIES

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LETTERS))


def brute(rows, items, top=10):
    docs = [(i, Counter(plain_terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    many, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c, n in docs:
            m = 100 - 90 + (90 * n * many) // total
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item, rank, i, -s))
    return sorted(out, key=str)


def test_query_equals_sql(spark, sf_dir):
    assert differences(spark, connect(sf_dir), QUERIES["op11_lexical_search"], ORACLE_SQL["op11_lexical_search"], sf_dir) is None


@pytest.mark.parametrize("postings, step", [(40, 1), (1 << 20, 2), (300, 16)])
def test_ties_and_crowds(spark, monkeypatch, postings, step):
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "STEP", step)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 12)  # several blocks of items
    draw = random.Random(step)
    rows = [(i, " ".join(draw.choice("abcdefghij") * draw.randrange(1, 3) for _ in range(draw.randrange(1, 12)))) for i in range(300)]
    rows += [(1000 + i, "a b c") for i in range(60)]  # equal scores
    items = [(k, " ".join(draw.choice("abcdefghij") * draw.randrange(1, 3) for _ in range(5))) for k in range(8)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = rank_documents(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items)


def test_reading_stops_early():
    """With one list far above the rest the search looks at a small part of the postings."""
    n = 50_000
    impacts = np.concatenate([np.arange(n, 0, -1) * 1000, np.full(n, 1)]).astype(np.int64)
    rows = np.concatenate([np.arange(n), np.arange(n)])
    lists = ImpactLists(np.array([3, 7]), np.array([n, n]), rows, impacts)
    reads = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                reads.append(at.stop - at.start)
            return np.asarray(self)[at]

    lists.read = lists.read.view(Counting)
    found, scores = lists.best([3, 7], 10, np.arange(n))
    assert found.tolist() == list(range(10)) and scores[0] == n * 1000 + 1
    assert 0 < sum(reads) < 1000


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(80_000))
    rows = [(1, None), (2, ""), (3, "-- !"), (None, "Alpha beta"), (5, "alpha BETA"), (5, "alpha BETA"), (4, "alpha beta"), (6, "Äpfel ä 漢字 alpha"),
            (7, long), (8, long + " alpha"), (9, "beta\x00gamma"), (10, "x" * 100_000)]
    items = [(1, "ALPHA beta"), (2, None), (3, ""), (None, "Äpfel 漢字"), (4, "nowhere"), (5, "w1 w2"), (5, "w3 alpha"), (6, "gamma " * 500), (7, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id int, text string, score int, rank string")
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    got = rank_documents(docs, table)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items)
    assert rank_documents(docs.limit(0), table).count() == 0
    assert rank_documents(docs, table.limit(0)).count() == 0
