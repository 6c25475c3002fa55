"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source gets a target number of words: its share, by weight, of ``share`` times all words, at
most ``cap`` times what it has; what is above goes to the other sources by weight. Documents get
rates that meet the targets and are closest, in relative entropy, to taking each once: the solution
is the exponential tilt ``min(cap, exp(multiplier * size / mean size))`` with one multiplier per
source, found by safeguarded Newton steps on the convex dual. Each step is one distributed
aggregation over the counts of (source, size), written to the shared folder.

Rates become whole copies by systematic rounding: along the documents of a source, ordered by size,
a copy is given whenever the running sum of the fractions passes the next half. A source so misses
its target by at most about the size of its largest document. The running sums come from the
(source, size) counts and the ranks from a distributed sort, so no source, however large, is
gathered in one task; only the list of distinct sources is.

Null or empty texts have size 0, and a copy of them takes nothing. A null source is a source of its
own, ordered last. Ties are broken by a hash of the key; rows with equal keys are interchangeable,
so reruns agree as sets of rows. Empty tables give an empty result. Columns of a result's name are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headersieve.llm.texts import words_of
from headersieve.session import fresh_path, materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
STEPS = 60
#: A source is settled when its expected words are this close to its target, relatively.
CLOSE = 1e-7


def source_targets(
    counts: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``_source, source_size, n_docs, least_size, target`` from the counts ``_source, size, n``."""
    sources = counts.groupBy("_source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum("n").alias("n_docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"),
    )
    # "-" is the null source, "=..." any other. Strings are ordered by their bytes, as code points are.
    place = F.row_number().over(Window.orderBy(F.col("_source") == "-", "_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    most = F.col("source_size") * F.lit(float(cap))
    # Sources reach their cap in the order of cap by weight: those before the first that doesn't are full.
    by_ratio = Window.orderBy(F.col("_most") / F.col("_weight"), "_source")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return (
        sources.withColumns({"_weight": weight, "_most": most})
        .withColumn(
            "_unit",
            (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
            / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))),
        )
        .withColumn("_rank", F.row_number().over(by_ratio))
        .withColumn(
            "_level",
            F.min(F.when(F.col("_most") > F.col("_unit") * F.col("_weight"), F.struct("_rank", "_unit"))).over(every),
        )
        .withColumn(
            "target",
            F.when(
                F.col("_level").isNull() | (F.col("_rank") < F.col("_level._rank")), F.col("_most")
            ).otherwise(F.col("_level._unit") * F.col("_weight")),
        )
        .select("_source", "source_size", "n_docs", "least_size", F.least("target", "_most").alias("target"))
    )


def _tilt(cap: float):
    """The uncapped logarithm of a document's rate."""
    return F.least(F.col("_multiplier") * F.col("size") / F.col("_mean"), F.lit(math.log(cap)))


def balance(counts: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """``targets`` with the ``_multiplier`` of each source and the ``_mean`` size its tilt is scaled by."""
    top = math.log(cap)
    state = targets.withColumns(
        {
            "_mean": F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)),
            "_full": F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12)),
        }
    ).withColumns(
        {
            "_multiplier": F.lit(0.0),
            # With the highest multiplier the smallest document reaches the cap. The lowest comes by doubling.
            "_high": F.coalesce(F.lit(top * (1 + 1e-9)) * F.col("_mean") / F.col("least_size"), F.lit(0.0)),
            "_low": F.lit(None).cast("double"),
            "_done": F.col("_full") | (F.col("target") <= 0),
        }
    )
    state = materialize(state, "dual")
    for _ in range(STEPS):
        tilt = _tilt(cap)
        mass = F.col("n") * F.col("size") * F.exp(tilt)
        slope = F.when(tilt < top, mass * F.col("size") / F.col("_mean")).otherwise(F.lit(0.0))
        moved = (
            counts.join(state.where(~F.col("_done")).select("_source", "_multiplier", "_mean"), "_source")
            .groupBy("_source")
            .agg(F.sum(mass).alias("_words"), F.sum(slope).alias("_slope"))
        )
        over = F.col("_words") - F.col("target")
        low = F.when(over <= 0, F.col("_multiplier")).otherwise(F.col("_low"))
        high = F.when(over > 0, F.col("_multiplier")).otherwise(F.col("_high"))
        newton = F.col("_multiplier") - over / F.col("_slope")
        inside = (F.col("_slope") > 0) & ((newton > F.col("_l")) | F.col("_l").isNull()) & (newton < F.col("_h"))
        aside = F.when(F.col("_l").isNull(), F.least(F.col("_multiplier"), F.lit(0.0)) * 2 - 1).otherwise(
            (F.col("_l") + F.col("_h")) / 2
        )
        held = F.col("_done") | F.col("_words").isNull() | (F.abs(over) <= F.col("target") * CLOSE)
        state = (
            state.join(moved, "_source", "left")
            .withColumns({"_l": low, "_h": high, "_newton": newton})
            .withColumns(
                {
                    "_multiplier": F.when(held, F.col("_multiplier")).when(inside, newton).otherwise(aside),
                    "_low": F.col("_l"),
                    "_high": F.col("_h"),
                    "_done": held,
                }
            )
            .drop("_words", "_slope", "_l", "_h", "_newton")
        )
        state = materialize(state, "dual")
        if state.where(~F.col("_done")).isEmpty():
            break
    return state


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
) -> DataFrame:
    """``docs`` (which have a size) with ``source_size, target, rate, copies, taken``."""
    own = [c for c in docs.columns if c not in ("source_size", "target", "rate", "copies", "taken")]
    packed = docs.select(
        F.struct(*own).alias("_row"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")).alias("_source"),
        F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.col(key)).alias("_hash"),
    )
    # Ids count up within a partition and partitions follow the order, so an id less the first of its
    # group in the partition, plus the group's rows in earlier partitions, is a rank.
    order = ["_source", "size", "_hash", f"_row.{key}"]
    placed = materialize(
        packed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "mix",
    ).withColumn("_part", F.shiftright("_at", 33))
    runs = materialize(
        placed.groupBy("_source", "size", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first")), "runs"
    )
    counts = materialize(runs.groupBy("_source", "size").agg(F.sum("n").alias("n")), "sizes")
    sources = balance(counts, materialize(source_targets(counts, weights, share, cap), "targets"), cap)

    rate = F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("_full"), F.lit(float(cap)))
    rated = counts.join(
        sources.select("_source", "source_size", "target", "_full", "_multiplier", "_mean"), "_source"
    ).withColumn("rate", rate.otherwise(F.exp(_tilt(cap))))
    rated = rated.withColumns({"_whole": F.floor("rate"), "_share": F.col("n") * (F.col("rate") - F.floor("rate"))})
    upto = F.sum("_share").over(Window.partitionBy("_source").orderBy("size"))
    rated = rated.withColumn("_upto", upto).withColumn(
        "_extra", F.floor(F.col("_upto") + 0.5) - F.floor(F.col("_upto") - F.col("_share") + 0.5)
    )
    earlier = Window.partitionBy("_source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        runs.withColumn("_earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
        .join(rated.select("_source", "size", "source_size", "target", "rate", "_whole", "_extra"), ["_source", "size"])
    )
    rank = F.col("_at") - F.col("_first") + F.col("_earlier")
    copies = (F.col("_whole") + F.when(rank < F.col("_extra"), 1).otherwise(0)).cast("bigint")
    return (
        placed.join(runs, ["_source", "size", "_part"])
        .withColumn("copies", copies)
        .select(
            *[F.col(f"_row.{c}").alias(c) for c in own],
            "source_size",
            "target",
            "rate",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mix_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the number of the copy in ``copy``."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c != "copy"]
    path = fresh_path(spark, "mixed")
    rows = docs.select(F.monotonically_increasing_id().alias("_id"), F.struct(*own).alias("_doc"))
    sized = rows.withColumn("_size", F.size(words_of(F.col(f"_doc.{text}"))))
    sized.write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    narrow = rows.select("_id", F.col(f"_doc.{key}").alias("_key"), F.col(f"_doc.{source}").alias("_from"), "_size")
    taken = mix(narrow, "_key", "_from", "_size").where("copies > 0").select("_id", "copies")
    return (
        rows.select("_id", "_doc")
        .join(taken, "_id")
        .select(
            *[F.col(f"_doc.{c}").alias(c) for c in own],
            F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        )
    )
