"""Token counts against encoding whole texts at once."""

import random

import public_tokenizers
import pytest

from headersieve.llm.token_count import _processor, count_pieces, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("overlap", [1, 8, 64])
def test_spliced_counts_are_whole_counts(overlap):
    processor, proven = _processor(MODEL)
    assert proven
    draw = random.Random(7)
    parts = ["alpha", " ", "  ", "\n", "<s>", "éß", "xyz" * 9, "▁", "日本語", ". ", "a\tb", " the", "▁ q"]
    for _ in range(150):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 120)))
        for chunk in (16, 40, 100):
            assert count_pieces(text, processor, True, chunk, overlap) == len(processor.encode(text)), text
    for text in ("z" * 5000, " " * 5000, "ab cd" * 2000):
        assert count_pieces(text, processor, True, 256, overlap) == len(processor.encode(text))


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(1, None, 9), (None, "", 9), (3, "a b", 9), (3, "a b", 9), (4, "word " * 5000, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(count_tokens(docs, MODEL, chunk=1000).collect(), key=lambda r: (r.n_bytes, r.doc_id or 0))
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [
        (0, 0, False),
        (0, 0, False),
        (3, 2, False),
        (3, 2, False),
        (25000, len(_processor(MODEL)[0].encode("word " * 5000)), True),
    ]
    assert count_tokens(docs.limit(0), MODEL).count() == 0
