"""Value vocabulary, feature slots and sparse cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.functions.headers import VALUE_SPELLINGS, once, trim_values
from headersieve.functions.pairs import ORDER_WIDTH, order_slots
from headersieve.operators.labels import number_labels, one_hot_labels
from headersieve.operators.lookup import Lookup, dense_index, lookup_join
from headersieve.operators.sampling import logs_in_period, newest_logs
from headersieve.session import materialize

# Bits of the table that tells values outside a large vocabulary: 2 MB for every task.
TABLE_BITS = 24


def value_keys(value_data: Column) -> Column:
    """``"<header>=<value>"`` for each trimmed header value of a row."""
    return F.transform(
        F.map_entries(trim_values(value_data)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )


def fit_value_vocabulary(df: DataFrame) -> DataFrame:
    """Distinct header values of the rows as ``(feature_name, idx)``, idx dense.

    Numbered alphabetically, so that a refit on the same rows gives the same
    numbers whatever the partitioning.
    """
    names = df.select(F.explode(value_keys(F.col("value_data"))).alias("feature_name")).distinct()
    return _number_names(names)


def _number_names(names: DataFrame) -> DataFrame:
    numbered = dense_index(names, [F.col("feature_name")], "idx")
    return numbered.select("feature_name", F.col("idx").cast("int").alias("idx"))


def _slots_in_place(df: DataFrame, vocabulary: DataFrame, unknown: str) -> DataFrame:
    """Look each header up in its own part of a broadcast vocabulary; no shuffle."""
    kept, slots = df.columns, []
    for n, header in enumerate(VALUE_SPELLINGS):
        text = F.col("value_data")[header]
        key, slot = f"__key{n}", f"__slot{n}"
        part = vocabulary.filter(F.col("feature_name").startswith(f"{header}=")).select(
            F.col("feature_name").alias(key), F.col("idx").alias(slot)
        )
        on = F.concat(F.lit(f"{header}="), text)
        df = lookup_join(df, Lookup(part, key, True), on)
        found = F.coalesce(slot, F.lit(0)) if unknown == "slot0" else F.col(slot)
        slots.append(F.when(text.isNotNull(), found))
    distinct = F.array_except(F.array(*slots), F.array(F.lit(None).cast("int")))
    return df.select(*kept, F.sort_array(distinct).alias("value_slots"))


def vocabulary_bits(vocabulary: DataFrame) -> DataFrame:
    """``(word, mask)``: a table of 2^``TABLE_BITS`` bits, those at the hashes of the vocabulary set.

    It has 2^(``TABLE_BITS`` - 6) rows at most, whatever the size of the vocabulary.
    """
    slot = _bit_slot(F.col("feature_name"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return vocabulary.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(mask).alias("mask"))


def _bit_slot(name: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(name), 64 - TABLE_BITS)


def _slots_by_shuffle(df: DataFrame, lookup: Lookup, unknown: str) -> DataFrame:
    """One row per known header value, one join, and back to one row per log.

    A table of bits, which every task has, tells most values that are in no vocabulary; they become slot 0 in place.
    Only the others move, and the join drops those that the bits let through by mistake.
    """
    kept = df.columns
    bits = F.broadcast(materialize(vocabulary_bits(lookup.table), "bits"))
    values = df.select("log_id", F.explode(value_keys(F.col("value_data"))).alias("__name"))
    values = values.withColumn("__slot", _bit_slot(F.col("__name")))
    marked = values.join(bits, F.shiftright("__slot", 6) == F.col("word"), "left")
    bit = F.call_function("getbit", F.coalesce("mask", F.lit(0).cast("bigint")), F.col("__slot").bitwiseAND(F.lit(63)).cast("int"))
    known = marked.filter(bit == 1).select("log_id", "__name")
    found = lookup_join(known, lookup, F.col("__name")).filter(F.col("idx").isNotNull())
    slots = found.groupBy(F.col("log_id").alias("__log_id")).agg(
        F.sort_array(F.collect_set("idx")).alias("__slots"), F.count(F.lit(1)).alias("__known")
    )
    joined = df.join(slots, df["log_id"] == slots["__log_id"], "left")
    slots_ = F.coalesce("__slots", F.array().cast("array<int>"))
    if unknown == "slot0":
        # A row with more values than were found has one that is unknown.
        unseen = F.size(value_keys(F.col("value_data"))) > F.coalesce("__known", F.lit(0))
        slots_ = F.when(unseen, F.array_sort(F.array_union(slots_, F.array(F.lit(0))))).otherwise(slots_)
    return joined.select(*kept, slots_.alias("value_slots"))


def value_features(
    df: DataFrame, vocabulary: DataFrame | Lookup, unknown: str = "slot0"
) -> DataFrame:
    """Add ``value_slots``, the sorted distinct vocabulary numbers of a row's values.

    A value outside the vocabulary sets slot 0, or nothing with
    ``unknown="drop"``. The vocabulary is broadcast only if it is measured to fit.
    """
    lookup = vocabulary if isinstance(vocabulary, Lookup) else Lookup.measure(vocabulary, "feature_name")
    if lookup.small:
        return _slots_in_place(df, lookup.table, unknown)
    return _slots_by_shuffle(df, lookup, unknown)


def order_features(df: DataFrame, unknown: str = "slot0") -> DataFrame:
    """Add ``order_slots``, the slots of the row's header pairs."""
    return once(df, "order_slots", order_slots(F.col("order_data"), unknown))


def full_features(
    df: DataFrame, vocabulary: DataFrame | Lookup, unknown: str = "slot0"
) -> DataFrame:
    """Add ``positions``: order slots, then value slots behind the last order slot."""
    kept = df.columns
    slotted = value_features(df, vocabulary, unknown)
    shifted = F.transform("value_slots", lambda slot: slot + ORDER_WIDTH)
    positions = F.concat(order_slots(F.col("order_data"), unknown), shifted)
    return once(slotted, "positions", positions).select(*kept, "positions")


def sparse_cells(df: DataFrame) -> DataFrame:
    """One row per set feature as ``(log_id, column)``."""
    return df.select("log_id", F.explode("positions").alias("column"))


def newest_first_rows(df: DataFrame) -> DataFrame:
    """``(log_id, row)``: the place of each log in the newest-first sample."""
    keys = df.select("log_id", "timestamp")
    order = [F.col("timestamp").desc(), F.col("log_id").desc()]
    return dense_index(keys, order, "row").select("log_id", "row")


def prepare_sample(logs: DataFrame, n: int, unknown: str = "slot0") -> tuple[DataFrame, DataFrame]:
    """The newest ``n`` logs as ``(log_id, timestamp, family, positions)`` and the vocabulary.

    The sample, no more than ``n`` rows, is written once: it is read for the
    vocabulary and again for the features.
    """
    needed = ("log_id", "timestamp", "ua_family_code", "value_data", "order_data")
    sample = materialize(newest_logs(logs, n).select(*needed), "newest")
    vocabulary = fit_value_vocabulary(sample)
    features = full_features(sample, vocabulary, unknown).select(
        "log_id", "timestamp", F.col("ua_family_code").alias("family"), "positions"
    )
    return features, vocabulary


def prepare_period(
    logs: DataFrame, start: int, finish: int, unknown: str = "slot0"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Logs of a period as ``(log_id, positions, label)`` with vocabulary and label codes.

    The label is the user agent's code, the 1 of its one-hot row. The logs are read once, for the columns that are needed,
    and the period is written; one explode and one shuffle of it give the distinct header values and, with their first
    appearance, the distinct agents, told apart by a tag.
    """
    needed = ("log_id", "timestamp", "user_agent", "value_data", "order_data")
    period = materialize(logs_in_period(logs, start, finish).select(*needed), "period")
    values = F.transform(value_keys(F.col("value_data")), lambda key: F.struct(F.lit("value").alias("tag"), key.alias("text")))
    agent = F.array(F.struct(F.lit("agent").alias("tag"), F.col("user_agent").alias("text")))
    keys = period.select("timestamp", "log_id", F.inline(F.concat(values, agent)))
    first = keys.groupBy("tag", "text").agg(F.min(F.struct("timestamp", "log_id")).alias("first"))
    first = materialize(first, "keys")
    vocabulary = _number_names(first.filter("tag = 'value'").select(F.col("text").alias("feature_name")))
    codes = number_labels(first.filter("tag = 'agent'").select("text", "first"))
    features = full_features(period, vocabulary, unknown)
    labelled = one_hot_labels(features, codes, "user_agent")
    return labelled.select("log_id", "positions", "label"), vocabulary, codes
