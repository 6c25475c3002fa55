"""Reliabilities are found again from votes alone."""

import random

import pytest
from pyspark.sql import functions as F

from headersieve.llm.weak_supervision import fit_votes


def test_reliabilities_are_found(spark):
    draw = random.Random(2)
    yes, no = (0.97, 0.9, 0.95, 0.92), (0.8, 0.7, 0.6, 0.9)
    rows = []
    for _ in range(20_000):
        good = draw.random() < 0.8
        right = [draw.random() < (y if good else n) for y, n in zip(yes, no)]
        rows.append([0 if draw.random() < 0.2 else (1 if r == good else -1) for r in right])
    votes = spark.createDataFrame(rows, "a int, b int, c int, d int")
    patterns = votes.groupBy("a", "b", "c", "d").agg(F.count("*").alias("n"))
    model = fit_votes(patterns, list("abcd"))
    assert model.prior == pytest.approx(0.8, abs=0.03)
    assert model.right_yes == pytest.approx(yes, abs=0.04)
    assert model.right_no == pytest.approx(no, abs=0.08)
    assert fit_votes(patterns, list("abcd")) == model


def test_no_votes_leave_the_belief(spark):
    none = spark.createDataFrame([], "a int, n bigint")
    model = fit_votes(none, ["a"], prior=0.7)
    assert (model.prior, model.right_yes, model.right_no) == (0.7, (0.97,), (0.3,))
