"""Retraining from the newest logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.functions.fixed_values import TRAINING_SAMPLE
from headersieve.operators.features import newest_first_rows, prepare_sample, sparse_cells
from headersieve.operators.model import assemble_training_set, train_family_model
from headersieve.session import materialize
from headersieve.sources.stores import read_training_tables, save_model, write_training_tables


def training_tables(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells ``(log_id, row, column)`` and labels ``(log_id, name)`` of a prepared sample."""
    rows = newest_first_rows(sample)
    cells = sparse_cells(sample).join(rows, "log_id").select("log_id", "row", "column")
    return cells, sample.select("log_id", F.col("family").alias("name"))


def retrain(
    spark: SparkSession,
    logs: DataFrame,
    store: str,
    n: int = TRAINING_SAMPLE,
    unknown: str = "slot0",
    **train_options,
) -> int:
    """Fit on the newest ``n`` logs, keep the training tables, publish the model.

    Gives the published version. Scorers that load the newest version get the
    model together with the vocabulary it was trained on.
    """
    sample, vocabulary = prepare_sample(logs, n, unknown)
    sample = materialize(sample, "sample")
    write_training_tables(*training_tables(sample), f"{store}/training")
    cells, labels = read_training_tables(spark, f"{store}/training")
    training_set = materialize(assemble_training_set(cells, labels), "training")
    model = train_family_model(training_set, **train_options)
    return save_model(spark, model, vocabulary, store)
