"""Continuous ingest of log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from headersieve.operators.shred import parse_log_lines, project_logs
from headersieve.sources.signatures import Signatures
from headersieve.sources.stores import stream_owner, write_logs

# A log id is batch number, partition and place in the partition side by side.
_BATCH_SHIFT, _PART_SHIFT, _PLACE_BITS = 45, 31, 33
# Compressed bytes that a micro-batch admits.
BATCH_BYTES = 64 * 1024**3


def number_lines(lines: DataFrame, batch: int) -> DataFrame:
    """Add ``log_id`` to the lines of a micro-batch; no two lines of a stream have the same.

    More partitions than an id has room for are put together first. More lines in one partition, or more batches,
    than there is room for are an error and never an id that another line has.
    """
    if batch >= 1 << (63 - _BATCH_SHIFT):
        raise OverflowError(f"batch {batch} is beyond the numbers that a log id has room for")
    place = F.monotonically_increasing_id()
    part = F.shiftleft(F.shiftright(place, _PLACE_BITS), _PART_SHIFT)
    within = place.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    too_many = F.raise_error(F.lit("a partition holds more lines than a log id has room for")).cast("bigint")
    number = F.when(within < (1 << _PART_SHIFT), F.lit(batch << _BATCH_SHIFT) + part + within).otherwise(too_many)
    return lines.coalesce(1 << (_BATCH_SHIFT - _PART_SHIFT)).withColumn("log_id", number)


def stream_ingest(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    signatures: Signatures,
    name_pattern: str = "*gz*",
    start: int | None = None,
    finish: int | None = None,
    batch_bytes: int = BATCH_BYTES,
    **parse_options,
) -> StreamingQuery:
    """Load each new file once; the checkpoint remembers which were loaded.

    Takes what is there and stops, so it can be scheduled. A backlog is worked off in
    micro-batches of up to ``batch_bytes`` of files. Every micro-batch owns a directory of the output and overwrites it if it is run again. Streams
    with other checkpoints, and ``ingest_pending``, write beside it.
    """
    lines = (
        spark.readStream.option("pathGlobFilter", name_pattern)
        .option("recursiveFileLookup", "true")
        .option("lineSep", "\n")
        .option("maxBytesPerTrigger", batch_bytes)
        .text(path)
        .withColumnRenamed("value", "line")
    )

    owner = stream_owner(checkpoint)

    def load(batch_lines: DataFrame, batch: int) -> None:
        numbered = number_lines(batch_lines, batch)
        parsed = parse_log_lines(numbered, signatures, start=start, finish=finish, **parse_options)
        logs = project_logs(parsed).withColumn("created_at", F.current_timestamp())
        write_logs(logs, out, batch, owner=owner)

    return (
        lines.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
