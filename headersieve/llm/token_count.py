"""Token counts of whole texts, also of huge ones, by overlap resynchronisation.

A text longer than ``chunk`` bytes is encoded in pieces that overlap. The encodings of two
neighbours are spliced at a position inside the overlap that both have as a token boundary and
that is *proven* stable: a blank after a character that is no blank. No piece of the vocabulary
holds a blank after another character (this is checked when the model is loaded), so no merge can
cross such a position and what stands left of it cannot influence what stands right of it. Where an
overlap holds no such position, it is doubled, up to the rest of the text.

Null texts count as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows, ties and
empty tables need no care; an existing column of a result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.llm.texts import bound_batches

CHUNK_BYTES = 65_536
OVERLAP_BYTES = 512
TOKEN_LIMIT = 4096

_BLANKS = (b" ", "▁".encode())  # the model writes a blank as U+2581


@cache
def _processor(model_path: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (processor.id_to_piece(i) for i in range(processor.vocab_size()))
    return processor, not any("▁" in piece.lstrip("▁") for piece in pieces)


def _stable(data: bytes, at: int) -> bool:
    """Whether no merge can cross ``at``."""
    return 0 < at < len(data) and data[at : at + 1] == b" " and not data[:at].endswith(_BLANKS, max(0, at - 3))


def _place(data: bytes, at: int) -> int:
    """The first start of a character from ``at`` on."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def _splice_point(data: bytes, left, left_from: int, right, right_from: int) -> tuple[int, int] | None:
    """At the first proven common boundary: the left tokens before it and the right tokens up to it."""
    ends, n = {}, len(left.pieces)
    while n and left_from + left.pieces[n - 1].end > right_from:
        ends[left_from + left.pieces[n - 1].end] = n
        n -= 1
    last = max(ends, default=right_from)
    for k in range(1, len(right.pieces)):
        at = right_from + right.pieces[k].begin
        if at > last:
            break
        if at in ends and right_from + right.pieces[k - 1].end == at and _stable(data, at):
            return ends[at], k
    return None


def count_pieces(text: str, processor, proven: bool, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> int:
    """Tokens of one text, the same as encoding it at once."""
    data = text.encode()
    if len(data) <= chunk or not proven:
        return len(processor.encode(text))

    def encode(begin: int, end: int):
        return processor.encode(data[begin : _place(data, end)].decode(), return_type="proto")

    total, skip, begin, end, width = 0, 0, 0, _place(data, chunk), overlap
    here = encode(begin, end + width)
    while end < len(data):
        then = _place(data, end + chunk)
        there = encode(end, then + overlap)
        spliced = _splice_point(data, here, begin, there, end)
        while spliced is None and end + width < len(data):
            width *= 2
            here = encode(begin, end + width)
            if end + width > then:
                then = _place(data, end + width)
                there = encode(end, then + overlap)
            spliced = _splice_point(data, here, begin, there, end)
        if spliced is None:  # the left piece reaches the end of the text
            break
        total += spliced[0] - skip
        here, begin, end, skip, width = there, end, then, spliced[1], overlap
    return total + len(here.pieces) - skip


def token_counts(text: Column, model_path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> Column:
    """A column with the number of tokens of each text; null counts as empty."""

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        processor, proven = _processor(model_path)
        for batch in batches:
            texts = batch.tolist()
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if t and (4 * len(t) <= chunk or not proven)]
            for i, ids in zip(short, processor.encode([texts[i] for i in short], num_threads=1), strict=True):
                counts[i] = len(ids)
            for i, t in enumerate(texts):
                if t and proven and 4 * len(t) > chunk:
                    counts[i] = count_pieces(t, processor, proven, chunk, overlap)
            yield pd.Series(counts, dtype="int64")

    return tokens(text)


def count_tokens(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    limit: int = TOKEN_LIMIT,
    chunk: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` for each text."""
    bound_batches(docs.sparkSession)
    counted = docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint"),
            "n_tokens": token_counts(F.col(text), model_path, chunk, overlap),
        }
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
