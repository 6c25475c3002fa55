"""Label codes for user agents and their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headersieve.operators.lookup import Lookup, dense_index, lookup_join


def fit_label_codes(
    df: DataFrame, column: str, order: tuple[str, ...] = ("timestamp", "log_id")
) -> DataFrame:
    """Distinct labels as ``(text, int_code, float_code)``, dense in first-seen order."""
    first = df.groupBy(F.col(column).alias("text")).agg(F.min(F.struct(*order)).alias("first"))
    return number_labels(first)


def number_labels(first: DataFrame) -> DataFrame:
    """Labels ``text`` as ``(text, int_code, float_code)``, dense in the order of ``first``."""
    numbered = dense_index(first, [F.col("first"), F.col("text")], "code")
    return numbered.select(
        "text",
        F.col("code").cast("int").alias("int_code"),
        F.col("code").cast("double").alias("float_code"),
    )


def encode_label(df: DataFrame, codes: DataFrame | Lookup, column: str) -> DataFrame:
    """Add ``int_code`` and ``float_code``; a label without a code gets 0."""
    lookup = codes if isinstance(codes, Lookup) else Lookup.measure(codes, "text")
    coded = lookup_join(df, lookup, F.col(column))
    return coded.withColumns(
        {
            "int_code": F.coalesce("int_code", F.lit(0)),
            "float_code": F.coalesce("float_code", F.lit(0.0)),
        }
    )


def one_hot_labels(df: DataFrame, codes: DataFrame | Lookup, column: str) -> DataFrame:
    """Add ``label``, the place of the 1 in the row's one-hot label vector.

    The dense 0/1 row is never built: its width is the number of labels.
    """
    coded = encode_label(df, codes, column).drop("float_code")
    return coded.withColumnRenamed("int_code", "label")


def decode_label(df: DataFrame, codes: DataFrame | Lookup, column: str) -> DataFrame:
    """Add ``text``, the label of a code; null if there is none."""
    table = codes.table if isinstance(codes, Lookup) else codes
    decoder = Lookup.measure(table.select("int_code", "text"), "int_code")
    return lookup_join(df, decoder, F.col(column))
