"""Votes of imperfect rules turned into probabilities by expectation-maximisation.

A vote is 1 (yes), -1 (no) or 0 (abstain). Rules are taken to err independently given the truth,
and abstaining says nothing. Only the table of distinct vote patterns is used: with k rules it has
at most 3^k rows whatever the number of items, so each iteration is one small aggregation, and the
driver holds nothing but two accuracies per rule and one prior.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 40
SETTLED = 1e-4
#: Bounds of how often a vote is right, when the truth is yes and when it is no. A rule that knows
#: one kind of fault says yes to all the other faults, so the second may be low.
YES_BOUNDS, NO_BOUNDS = (0.6, 0.995), (0.05, 0.95)
#: Pseudo-items that each say what is believed of a rule before any vote is seen.
BELIEF = 20.0


@dataclass(frozen=True)
class VoteModel:
    """The prior of yes and, per rule, how often its vote is right when the truth is yes or no."""

    prior: float
    right_yes: tuple[float, ...]
    right_no: tuple[float, ...]

    def log_odds(self, votes: Sequence[Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, yes, no in zip(votes, self.right_yes, self.right_no, strict=True):
            total = total + (
                F.when(vote == 1, F.lit(math.log(yes / (1 - no))))
                .when(vote == -1, F.lit(math.log((1 - yes) / no)))
                .otherwise(F.lit(0.0))
            )
        return total

    def posterior(self, votes: Sequence[Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(votes)))


def fit_votes(
    patterns: DataFrame,
    rules: Sequence[str],
    count: str = "n",
    prior: float = 0.85,
    right_yes: float = 0.97,
    right_no: float = 0.3,
) -> VoteModel:
    """The model of the votes in ``rules``, columns of distinct patterns seen ``count`` times.

    ``prior``, ``right_yes`` and ``right_no`` are what is believed at the start; an empty table leaves
    it at that.
    Values are rounded after each round, so that the order of a sum doesn't show.
    """
    model = VoteModel(prior, (right_yes,) * len(rules), (right_no,) * len(rules))
    n = F.col(count)
    for _ in range(ROUNDS):
        p = model.posterior([F.col(r) for r in rules])
        held = patterns.select("*", (n * p).alias("_yes"), (n * (1 - p)).alias("_no"))
        yes, no = F.col("_yes"), F.col("_no")
        sums = [F.sum(yes).alias("yes"), F.sum(no).alias("no")]
        for k, rule in enumerate(rules):
            vote = F.col(rule)
            sums += [
                F.sum(F.when(vote == 1, yes)).alias(f"a{k}"),
                F.sum(F.when(vote != 0, yes)).alias(f"b{k}"),
                F.sum(F.when(vote == -1, no)).alias(f"c{k}"),
                F.sum(F.when(vote != 0, no)).alias(f"d{k}"),
            ]
        row = held.agg(*sums).first()
        if row is None or row["yes"] is None:
            return model

        def share(part: float | None, whole: float | None, belief: float, bounds: tuple[float, float]) -> float:
            value = ((part or 0.0) + BELIEF * belief) / ((whole or 0.0) + BELIEF)
            return round(min(bounds[1], max(bounds[0], value)), 6)

        before, every = model, row["yes"] + row["no"]
        model = VoteModel(
            round(min(0.99, max(0.01, (row["yes"] + BELIEF * prior) / (every + BELIEF))), 6),
            tuple(share(row[f"a{k}"], row[f"b{k}"], right_yes, YES_BOUNDS) for k in range(len(rules))),
            tuple(share(row[f"c{k}"], row[f"d{k}"], right_no, NO_BOUNDS) for k in range(len(rules))),
        )
        moved = [abs(x - y) for x, y in zip(model.right_yes + model.right_no, before.right_yes + before.right_no)]
        if max([abs(model.prior - before.prior), *moved]) < SETTLED:
            break
    return model
