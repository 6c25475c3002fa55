"""Language-model scores of whole texts from an Elias-Fano n-gram trie.

Tokens are the words of a text, A-Z in lower case, and one end. The model is a bigram model trained on
all rows of the training side. A word's own probability p(w) is add-one, (c + 1) / (N + V + 1). After
a frequent context, a word that makes up at least 1 / ``FREQUENT`` of all tokens or the start of a
text, it is interpolated with the bigram's share, (1 - l) c(vw) / c(v) + l p(w); after any other
context v, (c(vw) + m p(w)) / (c(v) + m). Both sum to one. The counts of frequent words, of which
there cannot be more than ``FREQUENT``, are known everywhere.

Every term then depends on one word and what stands before it, or on one word alone, so the model is
cut into shards by word; what follows a frequent word or is one is cut by both. Texts are hashed and
packed by numpy, a packet per shard and few million tokens, and sent once. The task of a shard sums
the counts, builds its trie in an anonymous memory map and looks all its tokens up: the first level
has the words, the second, for each word, the words before it. Both are Elias-Fano sequences
(low bits beside a unary list of high bits); a pair is found by searching the successor of its number
relative to the range of its word. Smoothed probabilities are kept as 16-bit steps of log10. A lost
task is run again from the packets; no file is left behind. A last, small shuffle adds the shards'
parts for each text.

Null and empty texts are a single end token. Rows with equal or null keys stay apart and get a
result each. An empty table gives an empty result; with no training rows all counts are 0. Further
columns of a table are ignored. Words are told apart by 64-bit hashes, those before them by 40 bits.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.llm.bytes import LOWER, blocks, flat_texts, hashed_words, mixed
from headersieve.llm.texts import bound_batches
from headersieve.session import materialize

FREQUENT = 5000
INTERPOLATED = 0.5
PRIOR_MASS = 500.0
LEAST_SHARDS = 96
SHARD_BYTES = 8 << 20
PACKET_TOKENS = 1_000_000
PACKET_TEXTS = 30_000
BLOCK_BYTES = 4 << 20
STEP = 1 / 2048

START, END = np.uint64(0x51A27), np.uint64(0xE11D)
_BEFORE_BITS = np.uint64(40)
_BEFORE_MASK = np.uint64((1 << 40) - 1)


class EliasFano:
    """A rising sequence of numbers in a memory map: low bits as such, high bits in unary."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        # A third as many low bits as would be least would do; whole bytes keep numpy's reads simple.
        self.low_bits = 8 * max(0, (max(top // max(n, 1), 1).bit_length() - 1) // 8)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        unary = np.zeros(n + (int(high[-1]) if n else 0) + 1, dtype=np.uint8)
        unary[high + np.arange(n)] = 1
        packed = np.packbits(unary)
        planes = self.low_bits // 8
        self.count, self.unary_bits = n, len(unary)
        self._map = mmap.mmap(-1, max(1, len(packed) + planes * n))
        whole = np.frombuffer(self._map, dtype=np.uint8)
        whole[: len(packed)] = packed
        for k in range(planes):
            whole[len(packed) + k * n : len(packed) + (k + 1) * n] = (values >> np.uint64(8 * k)).astype(np.uint8)
        self._high = whole[: len(packed)]
        self._low = [whole[len(packed) + k * n : len(packed) + (k + 1) * n] for k in range(planes)]
        # Where each value of the high bits begins: the zeros of the unary list end them.
        zeros = np.flatnonzero(np.unpackbits(self._high, count=self.unary_bits) == 0)
        self._begin = np.concatenate(([0], zeros - np.arange(len(zeros)))).astype(np.int64)

    def _lows(self, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(at), dtype=np.uint64)
        for k, plane in enumerate(self._low):
            total |= plane[at].astype(np.uint64) << np.uint64(8 * k)
        return total

    def successors(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value not below each wanted number, and whether it is equal."""
        wanted = wanted.astype(np.uint64)
        if not self.count:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        beyond = high >= len(self._begin) - 1
        high = np.minimum(high, len(self._begin) - 2)
        low = wanted & np.uint64((1 << self.low_bits) - 1)
        begin, end = self._begin[high], self._begin[high + 1]
        stop = end.copy()
        while len(open_ := np.flatnonzero(begin < end)):
            middle = (begin[open_] + end[open_]) // 2
            below = self._lows(middle) < low[open_]
            begin[open_] = np.where(below, middle + 1, begin[open_])
            end[open_] = np.where(below, end[open_], middle)
        equal = (begin < stop) & ~beyond
        inside = np.flatnonzero(equal)
        equal[inside] = self._lows(begin[inside]) == low[inside]
        return np.where(beyond, self.count, begin), equal


@dataclass(frozen=True)
class Totals:
    """N, V, the training texts, and the frequent words (sorted hashes) with their counts."""

    tokens: int
    kinds: int
    texts: int
    words: np.ndarray
    counts: np.ndarray

    def frequent(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is a frequent word, and its count."""
        if not len(self.words):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        return hit, np.where(hit, self.counts[at], 0)


def tokens_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: the range, and hash and text of each token, an end closing each text."""
    data, offsets = flat_texts(texts)
    for begin, end in blocks(offsets, BLOCK_BYTES):
        piece = LOWER[data[offsets[begin] : offsets[end]]]
        hashes, owner, _ = hashed_words(piece, offsets[begin : end + 1] - offsets[begin])
        n = end - begin
        after = np.searchsorted(owner, np.arange(n), side="right")
        yield begin, end, np.insert(hashes, after, END), np.insert(owner, after, np.arange(n))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n`` of training texts, summed over a few million tokens."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": n.astype(np.int64)})

    for batch in batches:
        for _, _, hashes, _ in tokens_of(batch.column("text")):
            held.append(hashes)
            if sum(map(len, held)) >= PACKET_TOKENS:
                yield flush()
    if held:
        yield flush()


def count_totals(training: DataFrame, text: str) -> Totals:
    bound_batches(training.sparkSession)
    counted = training.select(F.col(text).alias("text")).mapInArrow(count_words, "word bigint, n bigint")
    counts = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    row = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count("*").alias("v"),
        F.coalesce(F.max(F.when(F.col("word") == int(END.astype(np.int64)), F.col("n"))), F.lit(0)).alias("texts"),
    ).first()
    # At most FREQUENT words can have so large a share.
    top = counts.where(F.col("n") * FREQUENT >= row["n"]).collect() if row["n"] else []
    words = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    return Totals(row["n"], row["v"], row["texts"], words[order], np.array([r["n"] for r in top], dtype=np.int64)[order])


def _packet(arrays: list[np.ndarray]) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _unpacked(packet: bytes, kinds: tuple) -> list[np.ndarray]:
    lengths = np.frombuffer(packet, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(lengths, kinds, strict=True):
        out.append(np.frombuffer(packet, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


_PAIR_KINDS = (np.uint64, np.uint32, *[np.uint8] * 5, np.uint32, np.uint16)
#: Marks the texts of a packet that are held out, whose numbers stay below it.
_HELD_OUT = np.uint16(1 << 15)
_PART_KINDS = (np.uint16, np.float64, np.float32, np.uint32)


def pack_tokens(shards: int, totals: Totals):
    """The map from texts to packets: ``shard, packet_of, keys, packet``."""
    from pyspark import TaskContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows: list[pa.RecordBatch] = []
        number = tokens = texts = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, tokens, texts
            this = (task << 32) + number
            word = np.concatenate([h for h, _ in held])
            owner = np.concatenate([o for _, o in held])
            before = np.empty_like(word)
            before[1:] = word[:-1]
            first = np.ones(len(word), bool)
            first[1:] = owner[1:] != owner[:-1]
            before[first] = START
            split, _ = totals.frequent(word)
            route = word.copy()
            route[split] = mixed(word[split] ^ mixed(before[split] + np.uint64(1)))
            shard = ((route >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            tail = before & _BEFORE_MASK
            order = np.lexsort((tail, word, shard))
            word, tail, shard, owner = word[order], tail[order], shard[order], owner[order]
            table = pa.Table.from_batches(rows)
            held_out = np.asarray(table.column("held_out").to_numpy(zero_copy_only=False), bool)
            marked = np.arange(texts, dtype=np.uint16) | (held_out.astype(np.uint16) << np.uint16(15))
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                w, t, o = (a[cuts[s] : cuts[s + 1]] for a in (word, tail, owner))
                new_word = np.concatenate(([True], w[1:] != w[:-1]))
                new_pair = new_word | np.concatenate(([True], t[1:] != t[:-1]))
                pairs = np.flatnonzero(new_pair)
                per_pair = np.diff(np.append(pairs, len(w)))
                words = np.flatnonzero(new_word)
                per_word = np.diff(np.append(np.searchsorted(pairs, words), len(pairs)))
                planes = [(t[pairs] >> np.uint64(8 * k)).astype(np.uint8) for k in range(5)]
                parts = [w[words], per_word.astype(np.uint32), *planes, per_pair.astype(np.uint32), marked[o]]
                yield _row(int(s), this, None, _packet(parts))
            sizes = np.bincount(owner, minlength=texts).astype(np.int64)
            keys = table.append_column("n_tokens", pa.array(sizes))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, keys.schema) as stream:
                stream.write_table(keys)
            # The texts' own rows go with the packets, spread over the shards, and are handed on there.
            yield _row(this % shards, this, sink.getvalue().to_pybytes(), None)
            number, tokens, texts = number + 1, 0, 0
            held.clear()
            rows.clear()

        for batch in batches:
            for begin, end, hashes, owner in tokens_of(batch.column("text")):
                if texts and texts + end - begin > PACKET_TEXTS:
                    yield from flush()
                held.append((hashes, owner + texts))
                rows.append(batch.select(["key", "held_out"]).slice(begin, end - begin))
                tokens, texts = tokens + len(hashes), texts + end - begin
                if tokens >= PACKET_TOKENS:
                    yield from flush()
        if texts:
            yield from flush()

    return pack


def _row(shard: int, packet_of: int, keys: bytes | None, packet: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int32()),
            pa.array([packet_of], pa.int64()),
            pa.array([keys], pa.binary()),
            pa.array([packet], pa.binary()),
        ],
        names=["shard", "packet_of", "keys", "packet"],
    )


_ROW = "shard int, packet_of bigint, keys binary, packet binary"


def score_shard(totals: Totals):
    """The map from a shard's packets to the parts of its texts' scores."""
    mass = float(totals.tokens + totals.kinds + 1)

    def score(table: pa.Table) -> pa.Table:
        packets = [(of.as_py(), p.as_py()) for of, p in zip(table["packet_of"], table["packet"], strict=True) if p.is_valid]
        handed = table.filter(pa.compute.is_valid(table["keys"]))
        out = handed.to_batches()
        if packets:
            out += _scored_packets(packets, totals, mass)
        return pa.Table.from_batches(out, schema=_row(0, 0, None, None).schema)

    return score


def _scored_packets(packets: list[tuple[int, bytes]], totals: Totals, mass: float) -> list[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    read = [_unpacked(p, _PAIR_KINDS) for _, p in packets]
    runs = np.concatenate([r[0] for r in read])
    per_word = np.concatenate([r[1] for r in read]).astype(np.int64)
    tail = np.zeros(int(per_word.sum()), dtype=np.uint64)
    for k in range(5):
        tail |= np.concatenate([r[2 + k] for r in read]).astype(np.uint64) << np.uint64(8 * k)
    trained = []
    for r in read:
        per_pair = r[7].astype(np.int64)
        trained.append(np.add.reduceat((r[8] < _HELD_OUT).astype(np.int64), np.cumsum(per_pair) - per_pair))
    trained = np.concatenate(trained)

    words = np.unique(runs)
    first = EliasFano(words)
    place, _ = first.successors(runs)
    at = np.repeat(place, per_word)
    split, counts = totals.frequent(words)
    counts = np.where(split, counts, np.bincount(at, weights=trained, minlength=len(words)).astype(np.int64))
    own = (counts + 1) / mass

    numbers = (at.astype(np.uint64) << _BEFORE_BITS) | tail
    seen = trained > 0
    order = np.argsort(numbers[seen], kind="stable")
    known, begins = np.unique(numbers[seen][order], return_index=True)
    second = EliasFano(known)
    joint = np.add.reduceat(trained[seen][order], begins) if len(known) else np.zeros(0, np.int64)
    # Frequent contexts by the bits that are kept of them; the start of a text is one of them.
    contexts = Totals(
        0,
        0,
        0,
        *_by_tail(np.append(totals.words, START), np.append(totals.counts, totals.texts)),
    )
    often, of_context = contexts.frequent(known & _BEFORE_MASK)
    unit = own[(known >> _BEFORE_BITS).astype(np.int64)]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(
            often & (of_context > 0),
            (1 - INTERPOLATED) * joint / np.maximum(of_context, 1) + INTERPOLATED * unit,
            joint + PRIOR_MASS * unit,
        )
    least = float(np.log10(p).min()) if len(p) else 0.0
    quantised = np.minimum(np.rint((np.log10(p) - least) / STEP), 65535).astype(np.uint16)

    where, found = second.successors(numbers)
    often, of_context = contexts.frequent(tail)
    start_alone = often & (of_context == 0)  # no training text at all
    value = np.log10(np.where(often, np.where(start_alone, 1.0, INTERPOLATED), PRIOR_MASS) * own[at])
    hit = np.flatnonzero(found)
    value[hit] = least + quantised[where[hit]] * STEP
    # A word that is no frequent context also pays, once per use, for what follows it.
    onward = np.where(split | (words == END), 0.0, -np.log10(counts + PRIOR_MASS))
    value += onward[at]
    plain = np.log10(own)[at]
    is_known = (counts > 0)[at]

    out, low = [], 0
    for (of, _), r in zip(packets, read, strict=True):
        high = low + len(r[7])
        number = np.repeat(np.arange(low, high), r[7].astype(np.int64))
        owner = (r[8] & ~_HELD_OUT).astype(np.int64)
        texts = np.unique(owner)
        sums = [np.bincount(owner, weights=x[number])[texts] for x in (plain, value, is_known.astype(float))]
        parts = [texts.astype(np.uint16), sums[0], sums[1].astype(np.float32), np.rint(sums[2]).astype(np.uint32)]
        out.append(_row(0, of, None, _packet(parts)))
        low = high
    return out


def _by_tail(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tails = words & _BEFORE_MASK
    order = np.argsort(tails)
    return tails[order], counts[order]


def add_parts(totals: Totals):
    def add(table: pa.Table) -> pa.Table:
        keys = pa.ipc.open_stream(next(k.as_py() for k in table["keys"] if k.is_valid)).read_all()
        n = len(keys)
        base, score, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        # In a fixed order, so that sums don't depend on which task came first.
        for packet in sorted(p.as_py() for p in table["packet"] if p.is_valid):
            at, part, model, seen = _unpacked(packet, _PART_KINDS)
            base[at] += part
            score[at] += model
            known[at] += seen
        return pa.table(
            {
                "key": keys["key"],
                "held_out": keys["held_out"],
                "n_tokens": keys["n_tokens"],
                "n_known": known,
                "train_tokens": np.full(n, totals.tokens, np.int64),
                "base_score": base,
                "score": score,
            }
        )

    return add


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each text.

    The model is trained on the rows that are not ``held_out``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).alias("text"))
    totals = count_totals(rows.where(~F.col("held_out")), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    bound_batches(spark)
    kind = dict(rows.dtypes)["key"]
    result = f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    packets = rows.mapInArrow(pack_tokens(shards, totals), _ROW)
    parts = packets.repartition(shards, "shard").groupBy("shard").applyInArrow(score_shard(totals), _ROW)
    scored = parts.groupBy("packet_of").applyInArrow(add_parts(totals), result)
    return scored.withColumnRenamed("key", key)
