"""Measures against plain Python, verdicts against what the rules are for."""

import re
from collections import Counter

from headersieve.llm.quality import BASE, keep_good, measure_texts, rate_quality

CLEAN = (
    "The morning train was late again, so the teacher walked along the river. She counted nine grey "
    "herons near the old bridge.\nNobody else had stopped to look, and the water was calm. "
    "A man with a dog asked for the time; it was almost eight."
)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures_are_those_of_plain_python(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [None, "", " \n\t", "a", "a b c d e a b c d e", "a a a a a a", "x y é\n\n z", "# $ " * 9, CLEAN * 40]
    texts += ["a b c d e f a b c d e g b c d e f"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_words string")
    got = {r.doc_id: tuple(r[c] for c in BASE) for r in measure_texts(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_verdicts(spark):
    junk = ["### " + " ".join(w + "$$$" for w in CLEAN.split()), (CLEAN.upper() + "!!\n") * 2, "spam " * 60, "a b", None]
    rows = [(i, CLEAN.replace("nine", f"{i}") + f" Day {i}.") for i in range(60)] + [(100 + i, t) for i, t in enumerate(junk)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id int, text string")
    got = rate_quality(docs)
    assert {r.doc_id for r in got.where("kept").collect()} == set(range(60))
    assert got.count() == len(rows) + 1 and got.where("doc_id = 0").distinct().count() == 1
    assert rate_quality(docs.limit(0)).count() == 0


def test_filter_keeps_columns_and_clashing_names(spark):
    rows = [(1, CLEAN, "q", 1, "s"), (2, "a b", "q", 1, "s"), (None, CLEAN, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, kept string, v_length int, quality string")
    got = keep_good(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2]], key=str)
