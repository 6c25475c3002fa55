"""Ranked lexical search of all documents for a set of items, by the Best Position Algorithm.

Terms are runs of ASCII letters and digits and of any character beyond ASCII, with A-Z in lower case. The
score of a document is a sum over the item's terms of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``
in whole numbers, with ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and
``m = 10 + (90 * n * N) div L``: N documents that have a term, L terms in all, n terms in the document, df
documents that hold the term, tf occurrences in the document.

Documents are cut into shards of up to ``SHARD_POSTINGS`` postings of the items' terms, each a row of the
index, which is written to the shared folder. With N, L and df summed over the shards, each shard is
searched for itself. A term's *impact list* holds its documents by falling impact. For an item, the lists of
its terms are read from the top, all equally deep; a document met there is at once looked up in the other
lists, where its place counts as seen as well. The *best position* of a list is the last one up to which
every place is seen, by reading or by looking up. A document that was not met lies behind it in every
list, so it scores at most the sum of the impacts at the best positions. A shard is done once that sum is below the
score of its last candidate, strictly, since equal scores are put in order by id. A shard hands on its ``top``
best for each item, so what is shuffled does not depend on how many documents an item's terms are in.

Items are worked off in blocks of about ``BLOCK_TERMS`` terms; only a block's terms are sent to the tasks.

Documents without an id take part and come last among equal scores. Rows that repeat a document's id or
text are documents of their own, with ranks of their own. Items are told by id: rows that repeat one are one
item with the terms of all of them; a null id is an id. Texts that are null or without a term find and are
found by nothing. Empty tables give an empty result. Columns of other names are not returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from headersieve.llm.texts import bound_batches
from headersieve.session import materialize

TOP = 10
SHARD_POSTINGS = 1 << 20
BLOCK_TERMS = 200_000
#: Places of each list that are read before the threshold is looked at; doubled up to the second number.
STEP, MOST_STEP = 16, 1024

_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max

_SHARD = (
    "documents bigint, terms bigint, id array<bigint>, size array<bigint>, "
    "term array<int>, held array<int>, row array<int>, times array<int>"
)


def terms_of(data: bytes) -> list[bytes]:
    """The terms of one text, in order."""
    return data.translate(_TERM_BYTES).split()


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``item, terms``: the different terms of each row."""
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.large_binary())
        lists = [[t.decode() for t in sorted(set(terms_of(x.as_py())))] for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(lists, pa.list_(pa.string()))], names=["item", "terms"])


class _Postings:
    """The documents of a shard that hold a wanted term."""

    def __init__(self) -> None:
        self.documents = self.terms = self.count = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[list[int], list[int]]] = []

    def row(self) -> pa.RecordBatch:
        lengths = [len(terms) for terms, _ in self.parts]
        row = np.repeat(np.arange(len(self.parts)), lengths).astype(np.int32)
        term = np.fromiter((t for terms, _ in self.parts for t in terms), np.int32, self.count)
        times = np.fromiter((n for _, found in self.parts for n in found), np.int32, self.count)
        order = np.argsort(term, kind="stable")
        terms, held = np.unique(term, return_counts=True)
        columns = {
            "documents": pa.array([self.documents]), "terms": pa.array([self.terms]),
            "id": pa.array([self.ids], pa.list_(pa.int64())), "size": pa.array([self.sizes], pa.list_(pa.int64())),
        }
        lists = {"term": terms, "held": held.astype(np.int32), "row": row[order], "times": times[order]}
        return pa.RecordBatch.from_pydict(columns | {k: pa.array([v], pa.list_(pa.int32())) for k, v in lists.items()})


def cut_shards(numbers):
    """The map from documents to shards of postings of the terms in ``numbers``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, shard = numbers.value, _Postings()
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.large_binary())
            for id_, text in zip(batch.column("id").to_pylist(), texts):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                shard.documents += 1
                shard.terms += len(terms)
                counts = Counter(terms)
                hits = counts.keys() & wanted.keys()
                if hits:
                    shard.ids.append(id_)
                    shard.sizes.append(len(terms))
                    shard.parts.append(([wanted[t] for t in hits], [counts[t] for t in hits]))
                    shard.count += len(hits)
                if shard.count >= SHARD_POSTINGS:
                    yield shard.row()
                    shard = _Postings()
        if shard.documents:
            yield shard.row()

    return cut


class ImpactLists:
    """A shard's postings with their impacts, by term and document, and by term and falling impact."""

    def __init__(self, terms, held, rows, impacts) -> None:
        self.begin = dict(zip(terms.tolist(), np.concatenate(([0], np.cumsum(held)[:-1])).tolist()))
        self.held = dict(zip(terms.tolist(), held.tolist()))
        self.rows, self.impacts = rows, impacts
        own = np.repeat(np.arange(len(terms)), held)
        self.read = np.lexsort((rows, -impacts, own))  # by place in the impact lists: where the posting is
        self.place = np.empty(len(rows), np.int64)
        self.place[self.read] = np.arange(len(rows))

    def best(self, wanted: list[int], top: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``top`` best documents by score, then id."""
        lists = [(self.begin[t], self.begin[t] + self.held[t]) for t in wanted if t in self.begin]
        known = np.zeros(len(ids), bool)
        seen = [np.zeros(end - begin, bool) for begin, end in lists]
        position = [0] * len(lists)  # how many places from the top are seen without a gap
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STEP
        while True:
            met = [self.rows[self.read[b + depth : min(b + depth + step, e)]] for b, e in lists]
            met = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            met = met[~known[met]]
            known[met] = True
            depth, step = depth + step, min(2 * step, MOST_STEP)
            score, threshold = np.zeros(len(met), np.int64), 0
            for k, (begin, end) in enumerate(lists):
                # Direct access: a list is also in the order of its documents.
                at = begin + np.searchsorted(self.rows[begin:end], met)
                at[at == end] = begin
                hit = self.rows[at] == met
                score[hit] += self.impacts[at[hit]]
                seen[k][self.place[at[hit]] - begin] = True
                ahead = seen[k][position[k] :]
                gap = int(np.argmin(ahead)) if len(ahead) else 0
                position[k] += len(ahead) if len(ahead) and ahead[gap] else gap
                if position[k] < end - begin:
                    threshold += int(self.impacts[self.read[begin + position[k] - 1]])
            some = score > 0
            found, scores = np.concatenate([found, met[some]]), np.concatenate([scores, score[some]])
            order = np.lexsort((ids[found], -scores))[:top]
            found, scores = found[order], scores[order]
            # With no list left open nothing is unseen; a document of score 0 is none.
            if threshold == 0 or (len(scores) == top and threshold < scores[-1]):
                return found, scores


def search_shards(block, top: int):
    """The map from shards to ``item, id, score``: the ``top`` best of each item in each."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, total = block.value
        for batch in batches:
            for k in range(batch.num_rows):
                column = {name: batch.column(name)[k].values for name in ("id", "size", "term", "held", "row", "times")}
                ids = column["id"].fill_null(_LAST).to_numpy()
                size, term, held, row, times = (column[n].to_numpy().astype(np.int64) for n in list(column)[1:])
                m = 10 + 90 * size * documents // total
                impacts = np.repeat(weights[term], held) * (1_000_000_000 * times // (1000 * times + 8 * m[row]))
                lists = ImpactLists(term, held, row, impacts)
                rows, scores, of = [], [], []
                for item, wanted in enumerate(items):
                    r, s = lists.best(wanted, top, ids)
                    rows.append(r)
                    scores.append(s)
                    of.append(np.full(len(r), item, np.int64))
                taken = np.concatenate([np.zeros(0, np.int64), *rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.zeros(0, np.int64), *of])),
                        column["id"].take(pa.array(taken)),
                        pa.array(np.concatenate([np.zeros(0, np.int64), *scores])),
                    ],
                    names=["item", "id", "score"],
                )

    return search


def _search_block(docs: DataFrame, items: list[tuple], kind, top: int) -> DataFrame:
    """``item_id, id, score`` of the best of each shard for a block of ``(item_id, terms)``."""
    spark = docs.sparkSession
    words = sorted({t for _, terms in items for t in terms})
    number = {t.encode(): k for k, t in enumerate(words)}
    shards = docs.mapInArrow(cut_shards(spark.sparkContext.broadcast(number)), _SHARD)
    shards = materialize(shards, "shards")
    documents, total = shards.agg(F.sum("documents"), F.sum("terms")).first()
    counted = shards.select(F.explode(F.arrays_zip("term", "held")).alias("x")).groupBy("x.term").agg(F.sum("x.held").alias("df"))
    table = counted.toArrow()  # at most one row a term of the block
    df = np.zeros(len(words), np.int64)
    df[table["term"].to_numpy()] = table["df"].to_numpy()
    documents = documents or 0
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    lists = [[number[t.encode()] for t in terms] for _, terms in items]
    block = spark.sparkContext.broadcast((lists, weights, documents, total))
    found = shards.mapInArrow(search_shards(block, top), "item bigint, id bigint, score bigint")
    schema = StructType([StructField("item", LongType()), StructField("item_id", kind)])
    names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(items)], schema)
    return found.join(F.broadcast(names), "item").select("item_id", "id", "score")  # one row an item of the block


def rank_documents(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", top: int = TOP,
) -> DataFrame:
    """``item_key, rank, key, score``: the ``top`` best documents of each item; ``key`` must be a whole number."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    items = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text"))
    kind = items.schema["item"].dataType
    told = items.mapInArrow(item_terms, f"item {kind.simpleString()}, terms array<string>")
    told = told.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    told = materialize(told.where(F.size("terms") > 0), "items")
    blocks = -(-(told.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    found = None
    for k in range(blocks):
        block = told.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
        part = _search_block(docs, [tuple(r) for r in block], kind, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = StructType([StructField("item_id", kind), StructField("id", LongType()), StructField("score", LongType())])
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item_id").alias(item_key), "rank", F.col("id").alias(key), "score")
