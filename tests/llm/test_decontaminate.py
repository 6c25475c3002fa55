"""Alignments against a plain Smith-Waterman, candidates against aligning everything."""

import random
import re

import numpy as np
import pytest

from headersieve.llm.decontaminate import best_alignment, drop_contaminated, find_contaminated


def plain(a, b):
    before, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, before[j - 1] + (2 if x == y else -1), before[j] - 1, row[-1] - 1))
        best, before = max(best, *row), row
    return best


def test_alignment_is_smith_waterman():
    draw = random.Random(5)
    for _ in range(150):
        a, b = ([draw.randrange(6) for _ in range(draw.randint(1, 30))] for _ in "ab")
        assert best_alignment(np.array(a), np.array(b)) == plain(a, b)


def cased(text, up):
    return "".join((c.upper() if up else c.lower()) if c.isascii() else c for c in text)


def tokens(text):
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010FFFF]+", cased(text or "", False)) if w]


def test_found_are_those_of_aligning_everything(spark, sf_dir):
    draw = random.Random(9)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(12).collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for k, (_, text) in enumerate(items):
        words = text.split()
        for share in (0.0, 0.1, 0.2):
            edited = [w if draw.random() >= share else f"z{draw.randrange(99)}" for w in words]
            rows.append((1000 + len(rows), rows[k][1][:500] + " " + cased(" ".join(edited), True) + " the end"))
        rows.append((1000 + len(rows), " ".join(words[: len(words) // 3])))
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double")
    bench = spark.createDataFrame([*items, (None, None), (99, "a b"), (98, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in find_contaminated(docs, bench).collect()}
    want = {}
    for i, text in rows:
        for j, item in items:
            a, b = tokens(item), tokens(text)
            if len(set(a) & set(b)) > len(a) // 4 and (s := plain(a, b) / (2 * len(a))) >= 0.5:
                want[i, j] = s
    assert got.keys() == want.keys(), [(k, want.get(k), got.get(k), dict(rows)[k[0]], dict(items)[k[1]]) for k in got.keys() ^ want.keys()]
    assert len(want) > 30
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_common_item_and_odd_rows(spark):
    item = "one small step for a man is one giant leap for all of us here today"
    rows = [(i, f"{item} {i}", "x") for i in range(50)] + [(None, f"so {item}", "x"), (60, None, "x"), (61, "", "x")]
    rows += [(62, "one small step", "x"), (None, "something else", "x"), (0, f"{item} 0", "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, seeds string")
    bench = spark.createDataFrame([(7, item)], "item_id int, text string")
    got = [(r.doc_id, r.item_id) for r in find_contaminated(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(i, 7) for i in [*range(50), None]], key=str)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([60, 61, 62, None], key=str)
    assert find_contaminated(docs.limit(0), bench).count() == find_contaminated(docs, bench.limit(0)).count() == 0


def test_hot_edited_copy_beside_one_verbatim_copy(spark):
    words = [f"w{k}" for k in range(22)]
    edited = [f"edit{k}" if k in (2, 6, 10, 14, 18) else w for k, w in enumerate(words)]
    rows = [(0, "so " + " ".join(words))] + [(i, f"x{i} " + " ".join(edited)) for i in range(1, 120)]
    rows += [(i, " ".join(words[:12]) + f" y{i}") for i in range(120, 240)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id int, text string")
    got = {r.doc_id: r.score for r in find_contaminated(docs, bench).collect()}
    own = tokens(" ".join(words))
    assert got == {i: pytest.approx(plain(own, tokens(t)) / 44, abs=1e-5) for i, t in rows}
