"""What the operators of this folder share: tables, words, splits of the rows, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.session import materialize

#: White space is blank, tab, line feed, vertical tab, form feed, carriage return; anything else is word.
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

#: A batch handed to Python holds at most so many rows and about so many bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 16 * 1024 * 1024

#: A key with more than this part of all rows is hot.
HOT_SHARE = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text; of null, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def remainder_is(key: Column, modulus: int, value: int) -> Column:
    """Whether crc32 of the key as text leaves ``value``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == value, F.lit(False))


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Keep the batches that go to Python small, so that long texts don't pile up in a worker."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def join_unevenly(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of their row of ``table``, which holds each of the ``keys`` once; inner join.

    Keys that hold more than one in ``HOT_SHARE`` of ``rows`` are at most so many: their rows of the table
    are broadcast, so that no task gets all rows of such a key. The others meet by a shuffle.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(materialize(counted.where(F.col("_n") * HOT_SHARE > rows.count()).select(*keys), "hot"))
    here = rows.join(F.broadcast(table.join(hot, keys)), keys)
    return here.unionByName(rows.join(hot, keys, "left_anti").join(table.join(hot, keys, "left_anti"), keys))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys`` in a sorted stream of batches, each run whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = [0]
        if batch.num_rows > 1:
            differs = None
            for key in keys:
                column = batch.column(key)
                new = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
                differs = new if differs is None else pc.or_(differs, new)
            changes += [int(k) + 1 for k in pc.indices_nonzero(differs).to_numpy()]
        own = [tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, batch.num_rows - 1)]
        if held and own[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in zip(changes, [*changes[1:], batch.num_rows]):
            if begin and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
        last = own[1]
    if held:
        yield pa.Table.from_batches(held)
