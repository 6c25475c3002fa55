"""Scoring rows with weights that stay a table.

The columns of a feature vector are the order slots, which are few and the same for every model, and behind them the
value slots, as many as the vocabulary has values. A row sets at most one value slot for each spelling of a
value header. So a row is scored in place: its order slots by weights in the expression, its value slots by one
lookup each. Nothing is grouped, so a stream is scored like a table, whatever the number of weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.functions.headers import VALUE_SPELLINGS, once
from headersieve.functions.pairs import ORDER_WIDTH
from headersieve.functions.scoring import LinearScorer, probabilities
from headersieve.operators.lookup import Lookup, lookup_join
from headersieve.session import materialize

# A row's value slots at most.
VALUE_SLOTS = len(VALUE_SPELLINGS)


@dataclass(frozen=True)
class TableScorer:
    """Weights by column: those of order slots as a small scorer, those of value slots as a lookup.

    ``tail`` is keyed by ``column`` and holds ``weights``, an array in the order of the classes. It is
    broadcast, once for each executor, if it was measured to fit, else it is shuffled.
    """

    head: LinearScorer
    width: int
    tail: Lookup

    @property
    def classes(self) -> list[str]:
        return self.head.classes

    @staticmethod
    def from_table(coefficients: DataFrame, **bounds: int) -> TableScorer:
        """Read rows ``(class, column, weight)``; column -1 holds the intercept.

        To the driver come the names of the classes and the weights of the order slots. ``bounds`` are those
        of ``Lookup.measure``.
        """
        classes = sorted(row["class"] for row in coefficients.select("class").distinct().collect())
        head = LinearScorer.from_table(coefficients.filter(F.col("column") < ORDER_WIDTH), classes)
        widest = coefficients.agg(F.max("column").alias("column")).first()["column"]
        by_class = F.map_from_entries(F.collect_list(F.struct("class", F.col("weight").cast("double").alias("weight"))))
        weights = F.array(*(F.coalesce(F.col("found")[name], F.lit(0.0)) for name in classes))
        tail = (
            coefficients.filter(F.col("column") >= ORDER_WIDTH)
            .groupBy("column")
            .agg(by_class.alias("found"))
            .select("column", weights.cast("array<double>").alias("weights"))
        )
        width = 0 if widest is None else widest + 1
        return TableScorer(head, width, Lookup.measure(materialize(tail, "weights"), "column", **bounds))

    def score(self, df: DataFrame, name: str = "probs") -> DataFrame:
        """Add ``name``, the probability of each family by ``positions``; null if no column is set.

        Columns at or beyond the trained width are ignored. Weights are added in the order of the positions, with
        those of order slots first, so every size gives the same last digit.
        """
        kept, positions = df.columns, F.col("positions")
        tail = F.filter(positions, lambda p: (p >= ORDER_WIDTH) & (p < self.width))
        too_many = F.raise_error(F.lit(f"more than {VALUE_SLOTS} value slots in a row"))
        df = df.withColumn("__tail", F.when(F.size(tail) <= VALUE_SLOTS, tail).when(F.size(tail) > VALUE_SLOTS, too_many))
        zeros = F.array(*(F.lit(0.0) for _ in self.classes)).cast("array<double>")
        margins = self.head.margins(F.filter(positions, lambda p: p < ORDER_WIDTH))
        for k in range(VALUE_SLOTS if self.width > ORDER_WIDTH else 0):
            found = self.tail.table.select("column", F.col("weights").alias(f"__weights{k}"))
            df = lookup_join(df, Lookup(found, "column", self.tail.small), F.get("__tail", F.lit(k)))
            margins = _plus(margins, F.coalesce(f"__weights{k}", zeros))
        return once(df, name, probabilities(self.classes, margins, positions)).select(*kept, name)


def _plus(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)
