"""Language of whole texts by prediction by partial matching over bytes.

For each language a context tree counts which byte follows each context of up to ``ORDER`` bytes, over
a sample of about ``SAMPLE_TEXTS`` labelled whole texts per language. The statistics are then frozen:
with escape method C a byte seen n times in a context (T times in all, D different bytes) has
probability n / (T + D), any other byte escapes with D / (T + D) to the next shorter context, and
below the empty context all bytes are equally likely. A context a language has never seen costs it
nothing and leads to the shorter one. The code length of a text is the exact sum over all its bytes;
the shortest wins. Contexts of full order seen fewer than ``LEAST_SEEN`` times are cut off, so the depth of the tree
varies.

The trees of all languages are laid out as one table (context, byte) -> costs, in 1/256 bit, which
the sample bounds and every task gets once. Texts are scored in blocks of bytes.

Null texts and texts without a letter are ``und`` with score 0, as is everything if no labelled text
is there to learn from. Null labels or texts teach nothing. Ties go to the first language by name.
Rows are independent: repeats get equal results, empty tables give an empty one. Columns of a
result's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.llm.bytes import blocks, flat_texts
from headersieve.llm.texts import bound_batches

ORDER = 3
SAMPLE_TEXTS = 1500
LEAST_SEEN = 8
UNIT = 256
BLOCK_BYTES = 1 << 20
UNKNOWN = "und"
_START = 10  # texts are taken to follow a line feed


@dataclass(frozen=True)
class Trees:
    """``costs[row * width + code, language]``; ``row_of`` gives the row of the last ``ORDER`` codes."""

    languages: tuple[str, ...]
    code_of: np.ndarray
    width: int
    row_of: np.ndarray
    costs: np.ndarray

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in bits of each text in each language."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        for begin, end in blocks(offsets, BLOCK_BYTES):
            at = offsets[begin : end + 1] - offsets[begin]
            for part in range(0, int(at[-1]), 8 * BLOCK_BYTES):  # only a single huge text has several
                upto = min(int(at[-1]), part + 8 * BLOCK_BYTES)
                low = max(0, part - ORDER)
                piece = data[offsets[begin] + low : offsets[begin] + upto]
                context, symbol = _contexts(self.code_of[piece], at[:-1] - low, self.width, self.code_of[_START])
                rows = self.row_of[context] * np.int64(self.width) + symbol
                costs = self.costs[rows[part - low :]]
                full = np.flatnonzero(at[1:] > at[:-1])
                starts = np.maximum(at[:-1][full] - part, 0)
                total[begin + full] += np.add.reduceat(costs, starts, axis=0, dtype=np.int64)
        return total / UNIT


def _contexts(codes: np.ndarray, starts: np.ndarray, width: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the last ``ORDER`` codes before each position, the nearest counting least."""
    codes = codes.astype(np.int64)
    context, away = np.zeros(len(codes), dtype=np.int64), _distance(starts, len(codes))
    for k in range(1, ORDER + 1):
        before = np.full(len(codes), start, dtype=np.int64)
        before[k:] = codes[:-k]
        before[away < k] = start
        context += before * width ** (k - 1)
    return context, codes


def _distance(starts: np.ndarray, n: int) -> np.ndarray:
    """Bytes since the start of the text, up to ``ORDER``."""
    away = np.full(n, ORDER, dtype=np.int64)
    for k in range(ORDER - 1, -1, -1):
        at = starts + k
        away[at[(at >= 0) & (at < n)]] = k
    return away


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, seen (order), context, symbol, n`` of labelled texts."""
    for batch in batches:
        data, offsets = flat_texts(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            picked = [i for i, other in enumerate(langs) if other == lang and offsets[i + 1] > offsets[i]]
            if not picked:
                continue
            codes = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in picked])
            starts = np.cumsum([0, *(offsets[i + 1] - offsets[i] for i in picked)])[:-1]
            context, symbol = _contexts(codes, starts, 256, _START)
            for order in range(ORDER + 1):
                keys, n = np.unique((context % 256**order) * 256 + symbol, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang] * len(keys), pa.string()),
                        "seen": pa.array(np.full(len(keys), order, np.int32)),
                        "key": pa.array(keys),
                        "n": pa.array(n.astype(np.int64)),
                    }
                )


def fit_trees(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Trees | None:
    """The frozen trees of the labelled rows of ``docs``."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {row["lang"]: row["n"] for row in labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    drawn = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000))
    chosen = F.lit(False)
    for name, n in sorted(counts.items()):
        chosen = chosen | ((F.col(lang) == name) & (drawn < math.ceil(1_000_000 * SAMPLE_TEXTS / n)))
    sample = labelled.where(chosen).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    bound_batches(docs.sparkSession)
    table = (
        sample.mapInArrow(count_contexts, "lang string, seen int, key bigint, n bigint")
        .groupBy("lang", "seen", "key")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    return lay_out(tuple(sorted(counts)), table)


def lay_out(languages: tuple[str, ...], table: pa.Table) -> Trees | None:
    """One table of costs from the counts of ``count_contexts``."""
    if not len(table):
        return None
    lang = np.searchsorted(np.array(languages), np.array(table.column("lang").to_pylist()))
    order, key, n = (table.column(c).to_numpy() for c in ("seen", "key", "n"))
    symbols = np.unique(key[order == 0] % 256)
    code_of = np.full(256, len(symbols), dtype=np.int64)
    code_of[symbols] = np.arange(len(symbols))
    width = len(symbols) + 1  # the last code stands for every byte never seen
    code_of[_START] = min(code_of[_START], width - 1)
    rest, context = key // 256, np.zeros(len(key), dtype=np.int64)
    for k in range(ORDER):
        context += np.where(order > k, code_of[(rest // 256**k) % 256], 0) * width**k
    symbol = code_of[key % 256]

    costs = np.full((1, width, len(languages)), math.log2(256.0), dtype=np.float32)
    row_of, rows = np.zeros(1, dtype=np.int32), [costs]
    at = 0
    for level in range(ORDER + 1):
        here = order == level
        seen, node = np.unique(context[here], return_inverse=True)
        if level == ORDER:
            enough = np.bincount(node, weights=n[here], minlength=len(seen)) >= LEAST_SEEN
            keep = enough[node]
            seen, node = np.unique(context[here][keep], return_inverse=True)
        else:
            keep = np.ones(int(here.sum()), dtype=bool)
        l_, s_, n_ = lang[here][keep], symbol[here][keep], n[here][keep].astype(np.float64)
        every, kinds = np.zeros((len(seen), len(languages))), np.zeros((len(seen), len(languages)))
        np.add.at(every, (node, l_), n_)
        np.add.at(kinds, (node, l_), 1.0)
        shorter = np.concatenate(rows)[row_of[seen % width ** max(level - 1, 0)]]
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(every > 0, -np.log2(kinds / (every + kinds)), 0.0)
            block = (shorter + escape[:, None, :]).astype(np.float32)
            block[node, s_, l_] = -np.log2(n_ / (every + kinds)[node, l_])
        # Contexts without a node of their own keep the row of the shorter one.
        at += len(rows[-1])
        row_of = np.tile(row_of, width) if level else row_of.copy()
        row_of[seen] = at + np.arange(len(seen), dtype=np.int32)
        rows.append(block)
    flat = np.minimum(np.rint(np.concatenate(rows) * UNIT), np.iinfo(np.int16).max).astype(np.int16)
    return Trees(languages, code_of, width, row_of, flat.reshape(-1, len(languages)))


def predicted(text: Column, trees: Trees, spark) -> Column:
    """A struct ``lang, score`` for each text."""
    shared = spark.sparkContext.broadcast(trees)

    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        names = pa.array(model.languages)
        for batch in batches:
            data, offsets = flat_texts(batch)
            bits = model.lengths(data, offsets)
            best = bits.argmin(axis=1)
            behind = bits - bits.min(axis=1, keepdims=True)
            # Neighbouring bytes are far from independent: a text speaks as if it had 64 at most.
            size = np.maximum(1.0, np.diff(offsets) / 64.0)[:, None]
            score = 1.0 / np.exp2(-behind / size).sum(axis=1)
            yield pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score)], ["lang", "score"])

    return F.arrow_udf(guess, "lang string, score double")(text)


def predict_language(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    if trees is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    spark = docs.sparkSession
    bound_batches(spark)
    told = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    guessed = docs.withColumn("_guess", predicted(F.col(text), trees, spark))
    return guessed.withColumns(
        {
            "lang_pred": F.when(told, F.col("_guess.lang")).otherwise(F.lit(UNKNOWN)),
            "score": F.when(told, F.col("_guess.score")).otherwise(F.lit(0.0)),
        }
    ).drop("_guess")
