"""Verdicts on a stream of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from headersieve.operators.verdict import judge_requests
from headersieve.sources.signatures import Signatures
from headersieve.sources.stores import (
    PublishedModel,
    batch_path,
    latest_version,
    load_model,
    stream_owner,
)

REQUESTS = "request_id bigint, client_ip string, body string"


def verdict_stream(
    requests: DataFrame, signatures: Signatures, model: PublishedModel, **options
) -> DataFrame:
    """A streaming frame of verdicts under one model, for any sink.

    Signatures, vocabulary and weights are static sides; nothing is kept as state, and rows are scored
    in place however many weights there are. More patterns than are tried in place need batches, as
    ``stream_verdicts`` has them.
    """
    return judge_requests(requests, signatures, model.vocabulary, model.scorer, **options)


def latest_model(spark: SparkSession, store: str) -> Callable[[], PublishedModel]:
    """A function giving the newest published model, reloaded only when it changes."""
    held: list[PublishedModel] = []

    def current() -> PublishedModel:
        version = latest_version(spark, store)
        if not held or held[0].version != version:
            held[:] = [load_model(spark, store, version or None)]
        return held[0]

    return current


def stream_verdicts(
    requests: DataFrame,
    signatures: Signatures,
    store: str,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Judge each request once, every micro-batch under the newest published model.

    Model and vocabulary are taken together from one version. Verdicts are
    written with the version that gave them, one output directory per batch of this
    checkpoint, overwritten if the batch is run again.
    """
    current = latest_model(requests.sparkSession, store)
    owner = stream_owner(checkpoint)

    def judge(batch_requests: DataFrame, batch: int) -> None:
        model = current()
        judged = verdict_stream(batch_requests, signatures, model, **options)
        versioned = judged.withColumn("model_version", F.lit(model.version).cast("bigint"))
        versioned.write.mode("overwrite").parquet(batch_path(out, owner, batch))

    return (
        requests.writeStream.foreachBatch(judge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
