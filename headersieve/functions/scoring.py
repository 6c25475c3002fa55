"""Class probabilities from set feature columns and linear weights."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.functions.fixed_values import HUMAN_THRESHOLD, PROBABILITY_DIGITS

def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


@dataclass(frozen=True)
class LinearScorer:
    """Per-class intercepts and weights (one row of class weights per column)."""

    classes: list[str]
    intercepts: list[float]
    weights: list[list[float]]

    @property
    def width(self) -> int:
        return len(self.weights)

    @staticmethod
    def from_table(coefficients: DataFrame, classes: list[str] | None = None) -> LinearScorer:
        """Read rows ``(class, column, weight)`` of a model that fits the driver; column -1 holds the intercept."""
        rows = coefficients.collect()
        classes = sorted({row["class"] for row in rows}) if classes is None else classes
        width = max((row["column"] for row in rows), default=-1) + 1
        number = {name: i for i, name in enumerate(classes)}
        intercepts = [0.0] * len(classes)
        weights = [[0.0] * len(classes) for _ in range(width)]
        for row in rows:
            target = intercepts if row["column"] < 0 else weights[row["column"]]
            target[number[row["class"]]] = float(row["weight"])
        return LinearScorer(classes, intercepts, weights)

    def margins(self, positions: Column) -> Column:
        """The intercept plus the weights of a row's set columns, by class.

        Columns at or beyond the trained width are ignored.
        """
        doubles = "array<double>"
        weights = F.from_json(F.lit(json.dumps(self.weights)), f"array<{doubles}>")
        intercepts = F.from_json(F.lit(json.dumps(self.intercepts)), doubles)
        known = F.filter(positions, lambda p: p < self.width)
        return F.aggregate(
            known,
            intercepts,
            lambda sums, p: F.zip_with(sums, F.element_at(weights, p + 1), lambda a, w: a + w),
        )

    def probabilities(self, positions: Column) -> Column:
        """``map<class, probability>`` of a row's set columns, null if none is set."""
        return probabilities(self.classes, self.margins(positions), positions)


def probabilities(class_names: list[str], margins: Column, positions: Column) -> Column:
    """``map<class, probability>`` from a row's margins, null if it sets no column.

    The class sigmoids are divided by their sum and rounded.
    """
    classes = F.from_json(F.lit(json.dumps(class_names)), "array<string>")
    # The aggregate hands the sum on, so that the sigmoids are made only once.
    normalised = F.element_at(
        F.transform(
            F.array(F.transform(margins, sigmoid)),
            lambda s: F.transform(
                s,
                lambda x: F.round(
                    x / F.aggregate(s, F.lit(0.0), lambda a, b: a + b), PROBABILITY_DIGITS
                ),
            ),
        ),
        1,
    )
    return F.when(F.size(positions) > 0, F.map_from_arrays(classes, normalised))


def human_verdict(probabilities: Column, claimed_family: Column, threshold: float = HUMAN_THRESHOLD):
    """Whether the claimed family's rounded probability is above the threshold."""
    return F.coalesce(probabilities[claimed_family] > threshold, F.lit(False))
