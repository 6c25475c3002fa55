"""Joins against lookup tables, and dense numbering.

A lookup keeps every row on the left exactly once, so the right side must be
unique on its key. Whether it is broadcast is decided by measuring it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headersieve.session import materialize

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024


@dataclass(frozen=True)
class Lookup:
    """A table unique on ``key`` and whether it was measured to fit a broadcast."""

    table: DataFrame
    key: str
    small: bool

    @staticmethod
    def measure(
        table: DataFrame, key: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
    ) -> Lookup:
        return Lookup(table, key, fits_broadcast(table, max_rows, max_bytes))

    @staticmethod
    def load(table: DataFrame, key: str) -> Lookup:
        """Measure a table that many queries will use, and keep it at hand."""
        return Lookup.measure(table.persist(), key)


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Count the rows and bytes of ``df`` and compare them with the bounds."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("bytes"),
    ).first()
    return row["n"] <= max_rows and (row["bytes"] or 0) <= max_bytes


def lookup_join(df: DataFrame, lookup: Lookup, on: Column) -> DataFrame:
    """Left join ``df`` to ``lookup`` where ``on`` equals the lookup's key.

    The key column of the lookup is dropped. A small lookup is broadcast. A
    larger one is shuffled once, without copies of its rows: a key held by a
    large share of ``df`` makes a skewed partition, which adaptive execution
    splits among tasks (``build_session`` turns that on). A stream has no
    adaptive execution, so there the keys known to be hot are few anyway: a
    micro-batch is bounded.
    """
    key = "__lookup_key"
    right = lookup.table.withColumnRenamed(lookup.key, key)
    if lookup.small:
        right = F.broadcast(right)
    return df.join(right, on == F.col(key), "left").drop(key)


def attach(df: DataFrame, lookup: Lookup, on: Column, name: str) -> DataFrame:
    """Left join a lookup with its columns packed into one struct, null on a miss."""
    fields = [c for c in lookup.table.columns if c != lookup.key]
    packed = lookup.table.select(lookup.key, F.struct(*fields).alias(name))
    return lookup_join(df, Lookup(packed, lookup.key, lookup.small), on)


def hash_slot(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - bits)


def hash_bits(df: DataFrame, value: Column, bits: int) -> DataFrame:
    """``(word, mask)``: a table of 2^``bits`` bits, those at the hashes of the values set; 2^(``bits`` - 6) rows at most."""
    slot = hash_slot(value, bits)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return df.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(mask).alias("mask"))


def in_hash_bits(df: DataFrame, value: Column, others: DataFrame, other: Column, bits: int) -> DataFrame:
    """The rows of ``df`` whose ``value`` may be among those of ``other``: all that are, and few that are not."""
    kept = df.columns
    table = F.broadcast(materialize(hash_bits(others, other, bits), "bits"))
    marked = df.withColumn("__slot", hash_slot(value, bits)).join(table, F.shiftright("__slot", 6) == F.col("word"))
    bit = F.call_function("getbit", F.col("mask"), F.col("__slot").bitwiseAND(F.lit(63)).cast("int"))
    return marked.filter(bit == 1).select(*kept)


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows 0..n-1 in the given total order without a one-task sort.

    A distributed sort leaves the rows in order across partitions; the running
    id Spark hands out holds (partition, place in partition). Once the sorted
    table is written, that id is frozen, and only the per-partition counts, one
    row per partition, have to be added up.
    """
    placed = materialize(
        df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), name
    )
    part = F.shiftright(F.col("__place"), 33)
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    # One row per sort partition, so the broadcast is bounded by the partition count.
    return (
        placed.withColumn("__part_l", part)
        .join(F.broadcast(starts), F.col("__part_l") == F.col("__part"))
        .withColumn(name, F.col("__start") + within)
        .drop("__place", "__part", "__part_l", "__start")
    )
