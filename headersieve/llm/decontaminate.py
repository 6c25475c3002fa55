"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are compared without ASCII case and punctuation. A seed is ``SEED`` words in a row of a benchmark
item. One pass over the texts tests all their n-grams against a bit table of the seeds (of fixed size,
so any benchmark may be tested this way) and gives out, for each cluster of hits, the hits and the
hashed words around them. Clusters with equal words and hits are one from there on, however many texts
hold them. All seeds are then joined exactly, common ones too. A text and an item with
``LEAST_SEEDS`` different seeds on nearby diagonals are aligned by Smith-Waterman on words; the score
is the best alignment over that of the item with itself, 0 to 1, and from ``CONTAMINATED`` on the text
is held to contain the item, whole, edited or in large part.

Items of fewer than ``LEAST_WORDS`` words are left out, as they occur by chance, and so are null items.
Null and empty texts contain nothing. Repeated rows each count; rows without an id are aligned too.
Ties between places go to the first. Empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headersieve.llm.bytes import LOWER, blocks, flat_texts, hashed_words, windows
from headersieve.llm.texts import bound_batches
from headersieve.session import materialize

SEED = 3
LEAST_WORDS = 8
LEAST_SEEDS = 2
CONTAMINATED = 0.5
MATCH, MISS, GAP = 2, -1, -1
BIN = 64
TABLE_BITS = 24
BLOCK_BYTES = 1 << 20

#: ASCII letters in lower case; digits and bytes of other alphabets as they are; the rest is space.
_PLAIN = LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def _plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words(_PLAIN[data], offsets)[:2]


def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``item_id, words (hashes), seeds`` of the items that are long enough."""
    for batch in batches:
        words, owner = _plain_words(*flat_texts(batch.column("text")))
        keep, lists, seeds = [], [], []
        for i in range(len(batch)):
            own = words[owner == i]
            if len(own) >= LEAST_WORDS:
                keep.append(i)
                lists.append(own.view(np.int64))
                seeds.append(windows(own, np.zeros(len(own), np.int64), SEED)[0].view(np.int64))
        big = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id").take(pa.array(keep, pa.int64())), pa.array(lists, big), pa.array(seeds, big)],
            names=["item_id", "words", "seeds"],
        )


def find_clusters(table, reach: int):
    """The map from texts to clusters of seed hits."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(table.value).astype(bool)
        for batch in batches:
            data, offsets = flat_texts(batch.column("text"))
            rows: list[tuple] = []
            for begin, end in blocks(offsets, BLOCK_BYTES):
                words, owner = _plain_words(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
                grams, at = windows(words, owner, SEED)
                hit = np.flatnonzero(bits[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
                if not len(hit):
                    continue
                grams, at = grams[hit], at[hit]
                cut = np.flatnonzero((np.diff(at) > reach) | (owner[at[1:]] != owner[at[:-1]])) + 1
                for part in np.split(np.arange(len(at)), cut):
                    if len(np.unique(grams[part])) < LEAST_SEEDS:
                        continue
                    text = owner[at[part[0]]]
                    first = np.searchsorted(owner, text)
                    last = np.searchsorted(owner, text, side="right")
                    low, high = max(first, at[part[0]] - reach), min(last, at[part[-1]] + SEED + reach)
                    rows.append((begin + text, words[low:high].view(np.int64), at[part] - low, grams[part].view(np.int64)))
            if rows:
                of, near, places, seeds = zip(*rows, strict=True)
                big = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(of)),
                        batch.column("digest").take(pa.array(of)),
                        pa.array(near, big),
                        pa.array(places, big),
                        pa.array(seeds, big),
                    ],
                    names=["id", "digest", "near", "places", "seeds"],
                )

    return find


def best_alignment(item: np.ndarray, near: np.ndarray) -> int:
    """The Smith-Waterman score of two lists of words, row by row of the item."""
    steps = np.arange(len(near) + 1) * -GAP
    before, best = np.zeros(len(near) + 1, np.int64), 0
    for word in item:
        row = np.zeros(len(near) + 1, np.int64)
        row[1:] = np.maximum(before[:-1] + np.where(near == word, MATCH, MISS), before[1:] + GAP)
        np.maximum(row, 0, out=row)
        # A gap along the row loses GAP a step, so the best start of one is a running maximum.
        before = np.maximum.accumulate(row + steps) - steps
        best = max(best, int(before.max()))
    return best


def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cluster, item_id, score`` of candidates; 0 for those that cannot reach ``CONTAMINATED``."""
    for batch in batches:
        scores = []
        for words, near, diagonal in zip(batch.column("words"), batch.column("near"), batch.column("diagonal"), strict=True):
            item, around = words.values.to_numpy(), near.values.to_numpy()
            low = max(0, diagonal.as_py() - 2 * BIN)
            part = around[low : diagonal.as_py() + len(item) + 3 * BIN]
            # An alignment scores at most MATCH for each word of the item that is there at all.
            most = MATCH * int(np.isin(item, part).sum())
            enough = most >= CONTAMINATED * MATCH * len(item)
            scores.append(best_alignment(item, part) / (MATCH * len(item)) if enough else 0.0)
        kept = [batch.column(c) for c in ("cluster", "item_id")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=["cluster", "item_id", "score"])


def align_benchmark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, digest, item_id, score`` of the texts that contain an item; ``digest`` tells equal ids apart."""
    spark = docs.sparkSession
    bound_batches(spark)
    kinds = dict(benchmark.dtypes)["item_id"], dict(docs.dtypes)[key]
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").mapInArrow(
        item_seeds, f"item_id {kinds[0]}, words array<bigint>, seeds array<bigint>"
    )
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = materialize(items.select("item", F.posexplode("seeds").alias("place", "seed")), "seeds")
    # The table has 2^TABLE_BITS bits, 2 MB, for any benchmark.
    marks = seeds.select(F.shiftrightunsigned("seed", 64 - TABLE_BITS).alias("bit")).distinct().toArrow()["bit"].to_numpy()
    table = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
    table[marks.astype(np.int64)] = 1
    table = spark.sparkContext.broadcast(np.packbits(table))
    longest = items.agg(F.max(F.size("words")).alias("n")).first()["n"] or 0

    rows = docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest")
    )
    clusters = rows.mapInArrow(
        find_clusters(table, longest + BIN),
        f"id {kinds[1]}, digest string, near array<bigint>, places array<bigint>, seeds array<bigint>",
    ).withColumn("cluster", F.sha2(F.to_json(F.struct("near", "places", "seeds")).cast("binary"), 256))
    every = materialize(clusters, "clusters")
    clusters = every.groupBy("cluster").agg(*[F.first(c).alias(c) for c in ("near", "places", "seeds")])
    clusters = materialize(clusters, "passages")
    hits = clusters.select("cluster", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select(
        "cluster", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at")
    )

    diagonal = F.col("at") - F.col("place")
    # Two grids of bins, half a bin apart, so that hits of one passage share a bin of one of them.
    grid = F.array(F.lit(0), F.lit(BIN // 2))
    binned = (
        hits.join(seeds, "seed")
        .select("cluster", "item", "seed", diagonal.alias("diagonal"), F.explode(grid).alias("grid"))
        .groupBy("cluster", "item", "grid", F.floor((F.col("diagonal") + F.col("grid")) / BIN).alias("bin"), "seed")
        .agg(F.min("diagonal").alias("diagonal"))
        .groupBy("cluster", "item", "grid", "bin")
        .agg(F.count("*").alias("n"), F.min("diagonal").alias("diagonal"))
        .where(F.col("n") >= LEAST_SEEDS)
        .groupBy("cluster", "item")
        .agg(F.min_by("diagonal", F.struct(-F.col("n"), "diagonal")).alias("diagonal"))
    )
    candidates = materialize(binned, "candidates")
    scored = (
        candidates.join(clusters.select("cluster", "near"), "cluster")
        .join(items.select("item", "item_id", "words"), "item")
        .select("cluster", "item_id", "words", "near", "diagonal")
        .mapInArrow(aligned, f"cluster string, item_id {kinds[0]}, score double")
        .where(F.col("score") >= CONTAMINATED)
    )
    scored = materialize(scored, "scored")
    found = every.select("cluster", "id", "digest").join(scored, "cluster")
    return found.groupBy("id", "digest", "item_id").agg(F.max("score").alias("score"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, item_id, score`` for each text and each item that it contains."""
    found = align_benchmark(docs, benchmark, key, text)
    return found.groupBy(F.col("id").alias(key), "item_id").agg(F.round(F.max("score"), 6).alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text contains no item, columns unchanged."""
    found = align_benchmark(docs, benchmark, key, text).select("id", F.col("digest").alias("_digest")).distinct()
    found = materialize(found.withColumnRenamed("id", "_id"), "contaminated")
    digest = F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))
    return docs.join(found, docs[key].eqNullSafe(found["_id"]) & (digest == found["_digest"]), "left_anti")
