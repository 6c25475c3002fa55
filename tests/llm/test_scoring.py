"""Scores against a model counted in plain Python; Elias-Fano sequences against bisection."""

import math
import random
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from headersieve.llm import scoring
from headersieve.llm.scoring import EliasFano, score_texts


@pytest.mark.parametrize("top", [10, 300, 1 << 20, 1 << 62])
def test_elias_fano(top):
    draw = random.Random(top)
    values = sorted({draw.randrange(top) for _ in range(500)})
    asked = values + [draw.randrange(top + 5) for _ in range(500)] + [0, top + 4]
    for some in (values, values[:1], []):
        place, equal = EliasFano(np.array(some, dtype=np.uint64)).successors(np.array(asked, dtype=np.uint64))
        assert place.tolist() == [bisect_left(some, a) for a in asked]
        assert equal.tolist() == [a in set(some) for a in asked]


def brute(rows):
    def tokens(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]

    train = [tokens(t) for _, t, out in rows if not out]
    one = Counter(w for ws in train for w in ws)
    two = Counter(p for ws in train for p in zip(["<s>", *ws], ws))
    n, v, texts = sum(one.values()), len(one), len(train)
    often = {w for w in one if one[w] * scoring.FREQUENT >= n}
    for key, text, out in rows:
        ws = tokens(text)
        base = score = 0.0
        for before, w in zip(["<s>", *ws], ws):
            p = (one[w] + 1) / (n + v + 1)
            base += math.log10(p)
            if before == "<s>" or before in often:
                c = texts if before == "<s>" else one[before]
                p = 0.5 * two[before, w] / c + 0.5 * p if c else p
            else:
                p = (two[before, w] + scoring.PRIOR_MASS * p) / (one[before] + scoring.PRIOR_MASS)
            score += math.log10(p)
        yield key, out, len(ws), sum(one[w] > 0 for w in ws), n, base, score


@pytest.mark.parametrize("frequent", [5, 5000])
def test_scores_are_those_of_counts(spark, sf_dir, frequent, monkeypatch):
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    monkeypatch.setattr(scoring, "PACKET_TOKENS", 20_000)
    monkeypatch.setattr(scoring, "LEAST_SHARDS", 5)
    rows = [(r.doc_id, r.text, r.doc_id % 5 == 0) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, None, False), (None, "", True), (1, "THE the É é", False), (-1, "qq " * 30_000, True)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, out boolean, key int")
    got = sorted(map(tuple, score_texts(docs, F.col("out")).collect()), key=str)
    want = sorted(brute(rows), key=str)
    by = lambda r: (str(r[0]), r[1], r[2], r[3])
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-3)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id int, text string, out boolean")
    assert score_texts(docs.limit(0), F.col("out")).count() == 0
    rows = sorted(map(tuple, score_texts(docs, F.col("out")).collect()))
    assert [r[:5] for r in rows] == [(1, True, 3, 0, 0), (2, True, 1, 0, 0)]
    assert all(r[5] == r[6] == 0.0 for r in rows)
