"""Mixes against targets found by resharing step by step."""

import random

import pytest

from headersieve.llm.mixing import mix, mix_texts


def reshared(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in above)
        open_ -= above
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_are_met(spark, seed):
    draw = random.Random(seed)
    sources = ["a", "B", "é", "z9", None, "hot", "zero"]
    rows = []
    for i in range(3000):
        s = "hot" if i % 3 == 0 else draw.choice(sources)
        n = 0 if s == "zero" else draw.choice([0, 1, 7, 7, 7, 50, draw.randint(1, 400)])
        rows.append((i % 2500 if i % 7 else None, s, n, "x"))
    docs = spark.createDataFrame(rows, "doc_id int, source string, size int, rate string")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    want = reshared(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-3, s
    again = sorted(map(str, mix(docs).collect()))
    assert again == sorted(map(str, got))


def test_copies_of_rows_and_odd_tables(spark):
    rows = [(i, " ".join("w" * (i % 5)), f"s{i % 3}", "c") for i in range(40)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, copy string")
    got = mix_texts(docs)
    assert set(got.columns) == set(docs.columns)
    assert all(n <= 2 for n in [r["count"] for r in got.groupBy("doc_id").count().collect()])
    assert mix_texts(docs.limit(0)).count() == 0
    assert [r.taken for r in mix(spark.createDataFrame([(1, "a", 0)], "doc_id int, source string, size int")).collect()] == [0]
