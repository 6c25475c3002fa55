"""Training the browser-family classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    OneVsRest,
    OneVsRestModel,
)
from pyspark.ml.feature import CountVectorizerModel, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.functions.fixed_values import INVERSE_REGULARISATION
from headersieve.functions.scoring import LinearScorer, sigmoid

COEFFICIENTS = "class string, column int, weight double"


@dataclass(frozen=True)
class FamilyModel:
    """A trained model: its weights, and the Spark ML model for three or more families."""

    scorer: LinearScorer
    one_vs_rest: OneVsRestModel | None

    def export_coefficients(self, spark: SparkSession) -> DataFrame:
        """Weights as ``(class, column, weight)``; column -1 holds the intercept."""
        rows = [
            (name, column, float(value[i]))
            for column, value in [(-1, self.scorer.intercepts), *enumerate(self.scorer.weights)]
            for i, name in enumerate(self.scorer.classes)
        ]
        return spark.createDataFrame(rows, COEFFICIENTS)


def assemble_training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``(log_id, positions, family)`` from sparse cells and labels, paired by id.

    A labelled log without a cell stays, as a row of zeros.
    """
    rows = features.groupBy("log_id").agg(F.sort_array(F.collect_set("column")).alias("positions"))
    named = labels.select("log_id", F.col("name").alias("family"))
    none = F.array().cast("array<int>")
    return named.join(rows, "log_id", "left").select(
        "log_id", F.coalesce("positions", none).alias("positions"), "family"
    )


def trained_width(training_set: DataFrame) -> int:
    """The highest set column plus one."""
    widest = training_set.agg(F.max(F.array_max("positions")).alias("widest")).first()["widest"]
    return 0 if widest is None else widest + 1


def with_vectors(df: DataFrame, width: int) -> DataFrame:
    """Add ``features``, the 0/1 vector of the set columns, kept sparse.

    Columns at or beyond the width are ignored.
    """
    names = [str(column) for column in range(width)]
    to_vector = CountVectorizerModel.from_vocabulary(names, "__names", "features").setBinary(True)
    named = df.withColumn("__names", F.col("positions").cast("array<string>"))
    return to_vector.transform(named).drop("__names")


def train_family_model(
    training_set: DataFrame,
    inverse_strength: float = INVERSE_REGULARISATION,
    parallelism: int = 8,
    max_iter: int = 100,
) -> FamilyModel:
    """One logistic regression per family against the rest.

    The strength is given as the weight of the summed loss against the penalty;
    Spark averages the loss, hence the division by the number of rows. Two
    families need one regression, a single family none. The training set is read
    many times, so hand in a written table.
    """
    width = trained_width(training_set)
    if training_set.isEmpty():
        return FamilyModel(LinearScorer([], [], []), None)
    indexer = StringIndexer(
        inputCol="family", outputCol="label", stringOrderType="alphabetAsc"
    ).fit(training_set)
    classes = list(indexer.labels)
    if len(classes) == 1:
        return FamilyModel(LinearScorer(classes, [0.0], [[0.0]] * width), None)
    rows = training_set.count()
    ready = with_vectors(indexer.transform(training_set), width).select("label", "features")
    regression = LogisticRegression(
        maxIter=max_iter,
        regParam=1.0 / (inverse_strength * rows),
        standardization=False,
        family="binomial",
    )
    if len(classes) == 2:
        only = regression.fit(ready)
        towards = only.coefficients.toArray()
        return FamilyModel(
            LinearScorer(
                classes,
                [-only.intercept, only.intercept],
                [[-float(w), float(w)] for w in towards],
            ),
            None,
        )
    fitted = OneVsRest(classifier=regression, parallelism=parallelism).fit(ready)
    models: list[LogisticRegressionModel] = fitted.models
    columns = zip(*(m.coefficients.toArray().tolist() for m in models))
    scorer = LinearScorer(classes, [m.intercept for m in models], [list(c) for c in columns])
    return FamilyModel(scorer, fitted)


def optimality_residual(
    training_set: DataFrame, model: FamilyModel, inverse_strength: float = INVERSE_REGULARISATION
) -> DataFrame:
    """``(class, residual)``: how far a trained model is from the best one for its training set.

    The penalised loss of a class against the rest is convex, so its weights are the best ones exactly where
    its gradient is zero. The residual is the largest part of that gradient: for a column the mean of (probability
    - label) over the rows that set it, plus the penalty's share; the intercept has no penalty. It is one pass over
    the set cells with as many sums per column as there are classes. A single family is not trained and has the
    residual 0.
    """
    spark, scorer = training_set.sparkSession, model.scorer
    weights = model.export_coefficients(spark)
    if len(scorer.classes) < 2:
        return weights.groupBy("class").agg(F.lit(0.0).alias("residual"))
    rows = training_set.count()
    labels = [(F.col("family") == name).cast("double") for name in scorer.classes]
    scored = training_set.select("positions", scorer.margins(F.col("positions")).alias("margins"), *(
        label.alias(f"label{k}") for k, label in enumerate(labels)
    ))
    errors = [sigmoid(F.col("margins")[k]) - F.col(f"label{k}") for k in range(len(labels))]
    cells = scored.select(
        F.explode(F.concat(F.array(F.lit(-1)), "positions")).alias("column"),
        *(error.alias(f"error{k}") for k, error in enumerate(errors)),
    )
    sums = cells.groupBy("column").agg(*(F.sum(f"error{k}").alias(f"error{k}") for k in range(len(labels))))
    by_class = F.array(*(
        F.struct(F.lit(name).alias("class"), F.col(f"error{k}").alias("error")) for k, name in enumerate(scorer.classes)
    ))
    loss = sums.select("column", F.inline(by_class))
    penalty = F.when(F.col("column") < 0, 0.0).otherwise(F.col("weight") / (inverse_strength * rows))
    # A column that no row sets has no error, only its penalty.
    gradient = F.coalesce(F.col("error"), F.lit(0.0)) / rows + penalty
    return weights.join(loss, ["class", "column"], "left").groupBy("class").agg(F.max(F.abs(gradient)).alias("residual"))
