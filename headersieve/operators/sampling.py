"""Selecting logs by time, and making false ones."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headersieve.operators.lookup import Lookup, lookup_join
from headersieve.session import materialize

# Parts that a range of times or ids is counted in, and keys that are looked at one by one.
BUCKETS = 1024
FEW_KEYS = 4096


def _in_period(start: int, finish: int) -> Column:
    moments = (F.timestamp_seconds(F.lit(t)) for t in (start, finish))
    return F.col("timestamp").between(*moments)


def _on_days(start: int, finish: int) -> Column:
    """The UTC days of a period, as ``write_logs`` partitions by them."""
    first, last = (F.lit(date(1970, 1, 1) + timedelta(days=t // 86400)) for t in (start, finish))
    return F.col("log_date").between(first, last)


def logs_in_period(df: DataFrame, start: int, finish: int, ordered: bool = False) -> DataFrame:
    """Logs from ``start`` to ``finish`` in epoch seconds, both included.

    Stored logs are also filtered by day, so other days' files are not listed or
    opened. ``ordered`` sorts by time, then id.
    """
    inside = df.filter(_in_period(start, finish))
    if "log_date" in df.columns:
        inside = inside.filter(_on_days(start, finish))
    return inside.orderBy("timestamp", "log_id") if ordered else inside


def _whole_days(df: DataFrame, n: int, newest: bool) -> DataFrame:
    """The newest or first whole days that hold at least ``n`` logs.

    Counting rows per day reads no column data, only file footers, so a long
    history costs next to nothing. There is one row per day to sort.
    """
    days = df.groupBy("log_date").agg(F.count(F.lit(1)).alias("logs"))
    day = F.col("log_date")
    nearer = Window.orderBy(day.desc() if newest else day.asc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = days.withColumn("nearer", F.coalesce(F.sum("logs").over(nearer), F.lit(0)))
    edge = F.min(day) if newest else F.max(day)
    last = counted.filter(F.col("nearer") < n).agg(edge.alias("day")).first()["day"]
    if last is None:
        return df
    return df.filter(day >= F.lit(last) if newest else day <= F.lit(last))


def _bucket_range(bucket: int, width: int) -> tuple[int, int]:
    """The values whose division by ``width``, cut towards zero, gives ``bucket``."""
    if bucket == 0:
        return 1 - width, width - 1
    return (bucket * width, bucket * width + width - 1) if bucket > 0 else (bucket * width - width + 1, bucket * width)


def _narrow(
    df: DataFrame, column: str, n: int, newest: bool, low: int, high: int, inside: int
) -> tuple[DataFrame, int, int, int]:
    """Narrow ``low`` to ``high``, which hold ``inside`` rows, around the ``n``-th value in order.

    Every turn counts the rows of up to ``BUCKETS`` equal parts, at most so many numbers for the driver, and goes on
    with the part that the ``n``-th is in. Gives its rows, the place of the ``n``-th among them, and the range.
    """
    df = df.filter(F.col(column).between(low, high))
    while low < high and inside > FEW_KEYS:
        width = (high - low) // BUCKETS + 1
        counts = df.groupBy(F.expr(f"{column} div {width}L").alias("bucket")).count().collect()
        for row in sorted(counts, reverse=newest):
            if n <= row["count"]:
                break
            n -= row["count"]
        first, last = _bucket_range(row["bucket"], width)
        low, high, inside = max(low, first), min(high, last), row["count"]
        df = df.filter(F.col(column).between(low, high))
    return df, n, low, high


def nth_key(df: DataFrame, n: int, newest: bool) -> tuple[int, int] | None:
    """The ``n``-th key ``(microseconds, log_id)`` in order of time and id; None if there are no more than ``n`` rows.

    The key is closed in on by histograms, first of the time and then, if a single moment holds too many rows, of
    the id; nothing is sorted and no task gets more than its own rows. The last ``FEW_KEYS`` keys at most are looked
    at one by one.
    """
    keys = df.select(F.unix_micros("timestamp").alias("at"), "log_id")
    ends = keys.agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.count("at").alias("rows"),
        F.min("log_id").alias("low_id"), F.max("log_id").alias("high_id"),
    ).first()
    if ends["rows"] <= n:
        return None
    part, n, low, high = _narrow(keys, "at", n, newest, ends["low"], ends["high"], ends["rows"])
    if low == high:
        part, n, _, _ = _narrow(part, "log_id", n, newest, ends["low_id"], ends["high_id"], part.count())
        if part.agg(F.min("log_id") == F.max("log_id")).first()[0]:
            return low, part.first()["log_id"]
    return tuple(sorted(part.collect(), reverse=newest)[n - 1])


def _up_to_nth(df: DataFrame, n: int, newest: bool) -> DataFrame:
    """The first ``n`` rows by (timestamp, log_id) without moving or sorting rows.

    The key of the last of them becomes a filter on the full rows, which stay where
    they are; the filter on the time reaches the scan.
    """
    if n <= 0:
        return df.limit(0)
    df = df.filter(F.col("timestamp").isNotNull())
    if "log_date" in df.columns:
        df = _whole_days(df, n, newest)
    cut = nth_key(df, n, newest)
    if cut is None:
        return df
    at, last_id = cut
    moment, time, number = F.timestamp_micros(F.lit(at)), F.col("timestamp"), F.col("log_id")
    if newest:
        return df.filter((time >= moment) & ((time > moment) | (number >= last_id)))
    return df.filter((time <= moment) & ((time < moment) | (number <= last_id)))


def newest_logs(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` logs; equal times are settled by the higher ``log_id``."""
    return _up_to_nth(df, n, newest=True)


def first_n_in_period(df: DataFrame, start: int, finish: int, n: int) -> DataFrame:
    """The first ``n`` logs of a period."""
    return _up_to_nth(logs_in_period(df, start, finish), n, newest=False)


def sample_summary(df: DataFrame) -> DataFrame:
    """How many logs there are, and the oldest and newest time among them."""
    return df.agg(
        F.count(F.lit(1)).alias("logs"),
        F.min("timestamp").alias("oldest"),
        F.max("timestamp").alias("newest"),
    )


def family_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("ua_family_code").agg(F.count(F.lit(1)).alias("logs"))


def false_families(df: DataFrame, seed: int | None = None) -> DataFrame:
    """``(ua_family_code, false_family)``: every family gets the next one in a cycle.

    The cycle runs over the families by name, or shuffled by ``seed``. With two
    or more families nothing keeps its own. Families are few: they come from the
    signature tables, so one sort over their names is enough.
    """
    families = df.select("ua_family_code").distinct()
    order = [F.col("ua_family_code")]
    if seed is not None:
        order = [F.md5(F.concat_ws(":", "ua_family_code", F.lit(seed))), *order]
    cycle = Window.orderBy(*order)
    following = F.lead("ua_family_code").over(cycle)
    first = F.first("ua_family_code").over(cycle)
    return families.select("ua_family_code", F.coalesce(following, first).alias("false_family"))


def make_bot_sample(df: DataFrame, seed: int | None = None) -> DataFrame:
    """Logs under a false family, remembering their id and family as ``original_*``."""
    false = Lookup.measure(materialize(false_families(df, seed), "families"), "ua_family_code")
    kept = df.withColumn("original_id", F.col("log_id"))
    renamed = kept.withColumnRenamed("ua_family_code", "original_ua_family_code")
    relabelled = lookup_join(renamed, false, F.col("original_ua_family_code"))
    return relabelled.withColumnRenamed("false_family", "ua_family_code")
