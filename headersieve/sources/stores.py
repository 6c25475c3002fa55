"""Tables the engine keeps: logs, vocabulary, codes, training tables and models."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.operators.lookup import Lookup
from headersieve.operators.model import FamilyModel
from headersieve.operators.scorer import TableScorer

LOGS = (
    "log_id bigint, timestamp timestamp, ip string, user_agent string, ua_family_code string, "
    "ua_version string, ua_class_code string, device_class_code string, os_family_code string, "
    "os_code string, value_data map<string,string>, order_data map<string,int>, "
    "created_at timestamp, log_date date"
)
VERSIONS = "version bigint, width int"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, empty if nothing has been written to the path yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


#: The owner of batches that ``ingest_pending`` writes. A stream is named by its checkpoint.
INGEST = "ingest"


def batch_path(path: str, owner: str, batch: int) -> str:
    """The directory of one batch: batch numbers are counted by each owner for itself."""
    return f"{path}/owner={owner}/batch={batch}"


def stream_owner(checkpoint: str) -> str:
    """A name for a stream that stays the same over restarts from its checkpoint."""
    return "stream-" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def write_logs(
    logs: DataFrame, path: str, batch: int, dry_run: bool = False, owner: str = INGEST
) -> None:
    """Write one batch of logs, partitioned by owner, batch and UTC day.

    Each batch of an owner has its directory, so repeating a batch that broke off
    replaces what it left behind and nothing else. A dry run works every row out
    and keeps nothing.
    """
    if dry_run:
        logs.write.format("noop").mode("overwrite").save()
        return
    day = F.floor(F.unix_seconds("timestamp") / 86400).cast("int")
    dated = logs.withColumn("log_date", F.date_from_unix_date(day))
    # A day's rows are brought together first, in parts of a good size, or every task would
    # write a file for every day.
    dated = dated.hint("rebalance", F.col("log_date"))
    dated.write.mode("overwrite").partitionBy("log_date").parquet(batch_path(path, owner, batch))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Stored logs; a filter on ``log_date`` leaves other days' files unread."""
    return spark.read.schema(LOGS).parquet(path)


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    overwrite(vocabulary.select("feature_name", "idx"), path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature_name string, idx int").parquet(path)


def save_codes(codes: DataFrame, path: str) -> None:
    overwrite(codes.select("text", "int_code", "float_code"), path)


def load_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, int_code int, float_code double").parquet(path)


def load_decoder(spark: SparkSession, path: str) -> DataFrame:
    """The inverse of the codes: ``(int_code, text)``."""
    return load_codes(spark, path).select("int_code", "text")


def write_training_tables(features: DataFrame, labels: DataFrame, path: str) -> None:
    """Replace the sparse cells ``(log_id, row, column)`` and labels ``(log_id, name)``."""
    overwrite(features, f"{path}/features")
    overwrite(labels, f"{path}/browsers")


def read_training_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    features = spark.read.schema("log_id bigint, row bigint, column int")
    labels = spark.read.schema("log_id bigint, name string")
    return features.parquet(f"{path}/features"), labels.parquet(f"{path}/browsers")


def write_test_logs(bots: DataFrame, path: str) -> None:
    """Replace the sample of false logs with their original id and family."""
    overwrite(bots, path)


@dataclass(frozen=True)
class PublishedModel:
    """A model version ready for scoring, with the vocabulary it was trained on."""

    version: int
    width: int
    vocabulary: Lookup
    coefficients: DataFrame
    scorer: TableScorer


def latest_version(spark: SparkSession, store: str) -> int:
    """The newest published version, 0 if there is none."""
    versions = read_or_empty(spark, f"{store}/published", VERSIONS)
    return versions.agg(F.max("version").alias("v")).first()["v"] or 0


def save_model(spark: SparkSession, model: FamilyModel, vocabulary: DataFrame, store: str) -> int:
    """Write a new version and publish it last.

    Model, vocabulary and width lie in one version directory; a reader finds a
    version only once the published table names it, so parts of two versions
    never mix and a broken-off save is never seen. The number is claimed first, so
    trainers that save at the same time get different ones; unused numbers stay free.
    """
    from headersieve.sources.claims import Claims  # which reads its table with the functions above

    version, _ = Claims(spark, f"{store}/claims").draw("version", latest_version(spark, store) + 1)
    home = f"{store}/version={version}"
    overwrite(model.export_coefficients(spark), f"{home}/coefficients")
    save_vocabulary(vocabulary, f"{home}/vocabulary")
    if model.one_vs_rest is not None:
        model.one_vs_rest.write().overwrite().save(f"{home}/one_vs_rest")
    published = spark.createDataFrame([(version, model.scorer.width)], VERSIONS)
    published.coalesce(1).write.mode("append").parquet(f"{store}/published")
    return version


def load_model(spark: SparkSession, store: str, version: int | None = None) -> PublishedModel:
    """A published version, the newest by default, for scoring."""
    chosen = latest_version(spark, store) if version is None else version
    if not chosen:
        raise FileNotFoundError(f"no model has been published in {store}")
    home = f"{store}/version={chosen}"
    coefficients = spark.read.parquet(f"{home}/coefficients")
    scorer = TableScorer.from_table(coefficients)
    width = (
        read_or_empty(spark, f"{store}/published", VERSIONS)
        .filter(F.col("version") == chosen)
        .first()["width"]
    )
    vocabulary = Lookup.measure(load_vocabulary(spark, f"{home}/vocabulary"), "feature_name")
    return PublishedModel(chosen, width, vocabulary, coefficients, scorer)
