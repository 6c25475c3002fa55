"""Code lengths against a tree walked byte by byte, predictions against held-out labels."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from headersieve.llm import language
from headersieve.llm.bytes import flat_texts
from headersieve.llm.language import ORDER, count_contexts, fit_trees, lay_out, predict_language
from headersieve.llm.queries import op8_language_id


def walked(trained, text, width):
    """Bits of a text by the definition."""
    counts = defaultdict(Counter)
    for t in trained:
        b = b"\n" * ORDER + t.encode()
        for i in range(ORDER, len(b)):
            for k in range(ORDER + 1):
                counts[b[i - k : i]][b[i]] += 1
    counts = {c: n for c, n in counts.items() if len(c) < ORDER}| {
        c: n for c, n in counts.items() if len(c) == ORDER and sum(n.values()) >= language.LEAST_SEEN
    }
    bits, b = 0.0, b"\n" * ORDER + text.encode()
    for i in range(ORDER, len(b)):
        for k in range(ORDER, -2, -1):
            if k < 0:
                bits += 8.0
                break
            seen = counts.get(b[i - k : i])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if b[i] in seen:
                bits -= math.log2(seen[b[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
    return bits


def test_lengths_are_those_of_the_tree():
    trained = ["the cat sat on the mat\nthe end " * 3, "", "a thé that thaws", "the the"]
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * 4, "text": trained})
    trees = lay_out(("x",), pa.Table.from_batches(list(count_contexts(iter([batch])))))
    texts = ["the cat", "", "thaws the mat\nthe", "zé\U0001f600 qq", "t", "", "the end"]
    got = trees.lengths(*flat_texts(pa.array(texts)))[:, 0]
    want = [walked(trained, t, trees.width) for t in texts]
    assert np.allclose(got, want, atol=0.05), (got, want)


def test_long_texts_in_parts(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "y"], "text": ["abcabd" * 50, "bca" * 90]})
    trees = lay_out(("x", "y"), pa.Table.from_batches(list(count_contexts(iter([batch])))))
    texts = flat_texts(pa.array(["abcab" * 100, "bc", "", "abd" * 333]))
    whole = trees.lengths(*texts)
    monkeypatch.setattr(language, "BLOCK_BYTES", 4)
    assert np.allclose(trees.lengths(*texts), whole)


def test_held_out_labels(spark, sf_dir):
    got = op8_language_id(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = [r for r in got.join(docs, "doc_id").collect() if r.held_out]
    assert got.count() == docs.count()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows) > 0


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    rows = [(1, "der hund und die katze " * 9, "de"), (2, "the dog and the cat " * 9, "en"), (3, "the", None)]
    rows += [(None, None, "en"), (4, "", "de"), (5, "123 !?", None), (3, "the", None)]
    docs = spark.createDataFrame([(*r, 7.0) for r in rows], "doc_id int, text string, lang string, score double")
    docs = docs if labelled else docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")
    trees = fit_trees(docs)
    got = [(r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in predict_language(docs, trees).collect()]
    assert all(ok for *_, ok in got)
    if labelled:
        assert {(i, p) for i, p, _ in got} == {(1, "de"), (2, "en"), (3, "en"), (None, "und"), (4, "und"), (5, "und")}
        assert predict_language(docs.limit(0), trees).count() == 0
    else:
        assert {p for _, p, _ in got} == {"und"} and fit_trees(docs.limit(0)) is None
