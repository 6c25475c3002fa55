"""Phrases that occur more often than their parts suggest, counted with an FM-index per shard.

Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs, with A-Z in
lower case; everything is counted per language (null: ``und``). A candidate is a phrase of 2 to ``LONGEST`` words that
occurs ``LEAST`` times or more. Its score is the least of ``floor(SCALE * a / (l + r))`` over its cuts into a
first part and a rest that occur l and r times. A candidate is dropped if one of its extensions by a word to the left
or right has at least ``COVERED`` percent of its occurrences. (A longer phrase that holds it with that many
has such an extension between them, so one word at a time is enough.) Each language's first ``TOP`` are
returned. All arithmetic is in whole numbers; products are decimals, as they may pass 64 bits.

Counting:

1. Texts become *shards* of about ``SHARD_WORDS`` words, a row each: a dictionary of (language, word) and the
   word ids of all pieces, with 0 between pieces. Words are counted.
2. Words below ``LEAST`` can be in no candidate; they turn into 0. Each shard gets an *FM-index* over word ids: the
   Burrows-Wheeler transform of the sequence and of its reverse. Both orders look at ``LONGEST`` words only, since no
   longer phrase is searched. Sorting a shard costs less than to write and read its index, which is larger than the
   texts; so each round builds the index of a shard in its task.
3. A phrase is a pair of intervals of equal width, one in each order. *Extension to the right* by every word
   at once reads the transform of the reverse: the words found in an interval are the extensions, their numbers
   the counts, their ranks the new interval there, and the numbers of smaller words the new interval in the other
   order. *Extension to the left* is the mirror image. Phrases grow to the right and to the left in turn.
4. A phrase is only extended if it may be frequent over all shards, and only to phrases whose other part of one word
   less may be, too. For that, the phrases of each length below ``LONGEST`` are first counted under hashes of ``HASH_BITS`` bits,
   and those that reach ``LEAST`` set bits in a table, of a size fixed by their number and at most 2^``MOST_BITS``. The counts
   move as *packets*: those of a range of hashes, in order, as the distances between them.
   A last round counts the phrases of all lengths that this lets through under their own texts, so
   neither a hash nor a bit that two phrases share changes any number.

Empty and null texts hold nothing; repeated rows count as often as they are there. A piece is never cut, so memory
grows with the longest text. Empty tables give an empty result; columns of other names are not used.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headersieve.llm.bytes import mixed
from headersieve.llm.texts import bound_batches, join_unevenly
from headersieve.session import materialize

LONGEST = 4
LEAST = 30
COVERED = 80
SCALE = 2_000_000
TOP = 2000
UNKNOWN = "und"
SHARD_WORDS = 1 << 19
#: Bytes of a batch that goes to Python; an index is a few megabytes.
BATCH_BYTES = 4 * 1024 * 1024
#: Places of an index that are extended at a time.
PART_ROWS = 1 << 17
#: First bits of a hash that are counted; the others of 64 hold a count up to ``LEAST``, below 256, while hashes are sorted.
HASH_BITS = 40
#: Counts that are packed at a time, and words of the corpus for each range of hashes, of which one task sums all packets.
PACKET_ROWS = 1 << 20
RANGE_WORDS = 1 << 20
LEAST_RANGES = 16
#: A row of a shard is megabytes: it gets a page of its own, for the default is a hundred rows.
SHARD_FILES = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
LEAST_BITS, MOST_BITS = 16, 27
BITS_EACH = 16
#: A language's candidates are ranked in so many parts before the best of all parts are.
PARTS = 64

_END = b".,;:!?\x0a\x0b\x0c\x0d"
_CUT = bytes(10 if c in _END else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BIG = "decimal(38,0)"


class _Numbers(dict):
    """Ids of the words of a language, given out as they come; the dictionary is shared by all languages."""

    def __init__(self, lang: int, words: list[bytes], of: array) -> None:
        self.lang, self.words, self.of = lang, words, of

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.of.append(self.lang)
        self[word] = number = len(self.words)
        return number


@dataclass
class Dictionary:
    """Words with their languages. Stored, they are a few long values, which cost the engine less than many short ones."""

    langs: list[str]
    of: np.ndarray
    words: list[bytes]

    COLUMNS = "langs array<string>, of binary, words binary"

    def stored(self) -> dict[str, pa.Array]:
        return {
            "langs": pa.array([self.langs], pa.list_(pa.string())),
            "of": pa.array([self.of.astype(np.int32).tobytes()], pa.binary()),
            "words": pa.array([b"\n".join(self.words)], pa.binary()),
        }

    @staticmethod
    def read(batch: pa.RecordBatch, k: int) -> Dictionary:
        langs = batch.column("langs")[k].as_py()
        of = np.frombuffer(batch.column("of")[k].as_buffer(), np.int32)
        return Dictionary(langs, of, batch.column("words")[k].as_py().split(b"\n"))

    def where(self, kept: np.ndarray) -> Dictionary:
        return Dictionary(self.langs, self.of[kept], [self.words[k] for k in np.flatnonzero(kept).tolist()])

    def hashes(self) -> np.ndarray:
        digest, begins = xxhash.xxh64_intdigest, [f"{lang}\n".encode() for lang in self.langs]
        return np.fromiter((digest(begins[x] + w) for x, w in zip(self.of.tolist(), self.words)), np.uint64, len(self.words))


def cut_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary, ``sizes``, the words of each of its languages, and ``symbols``, the word ids byte by byte, of each shard."""

    def shard() -> pa.RecordBatch:
        found, ids = Dictionary(list(numbers), np.frombuffer(of, np.int32), words), np.frombuffer(symbols, np.int32)
        n = np.bincount(ids, minlength=len(words) + 1)[1:]
        sizes = np.bincount(found.of, n, minlength=len(found.langs)).astype(np.int64)
        return pa.RecordBatch.from_pydict(found.stored() | {
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "symbols": pa.array([_planes(ids, 4)], pa.binary()),
        })

    words, of, numbers, symbols = [], array("i"), {}, array("i", [0])
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.large_binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            if lang not in numbers:
                numbers[lang] = _Numbers(len(numbers), words, of)
            number = numbers[lang].__getitem__
            for piece in text.as_py().translate(_CUT).split(b"\n"):
                found = piece.split()  # white space of other kinds is a line end above
                if found:
                    symbols.extend(map(number, found))
                    symbols.append(0)
            if len(symbols) > SHARD_WORDS:
                yield shard()
                words, of, numbers, symbols = [], array("i"), {}, array("i", [0])
    if words:
        yield shard()


def _numbers(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32)


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of whole numbers, the first bytes of all before the second of all: that packs well."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    numbers = np.zeros((planes.shape[1], 8), np.uint8)
    numbers[:, :width] = planes.T
    return numbers.view("<u8").ravel()


def read_symbols(value) -> np.ndarray:
    return _from_planes(value.as_buffer(), 4).astype(np.int32)


# Counts under hashes, in packets.

_LOW = np.uint64(64 - HASH_BITS)
_HASH_BYTES = -(-HASH_BITS // 8)


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order and their counts, up to ``LEAST``, of ``keys`` that hold both."""
    keys.sort()
    n = (keys & np.uint64((1 << int(_LOW)) - 1)).astype(np.int64)
    hashes = keys >> _LOW
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[starts], np.minimum(np.add.reduceat(n, starts), LEAST)


def packets(counted: Iterator[tuple[np.ndarray, np.ndarray]], ranges: int) -> Iterator[pa.RecordBatch]:
    """``range, packet`` of 64-bit hashes with their counts; ``ranges`` is a power of two."""

    def packed(keys: list[np.ndarray]) -> pa.RecordBatch:
        hashes, n = _summed(np.concatenate(keys))
        width = HASH_BITS + 1 - ranges.bit_length()
        owner = hashes >> np.uint64(width)
        begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        ends = np.append(begins[1:], len(hashes))
        distances = np.diff(hashes, prepend=np.uint64(0))
        distances[begins] = hashes[begins] & np.uint64((1 << width) - 1)
        found = [_planes(distances[x:y], _HASH_BYTES) + _planes(n[x:y], 1) for x, y in zip(begins.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(owner[begins].astype(np.int64)), pa.array(found, pa.binary())], names=["range", "packet"]
        )

    keys, held = [], 0
    for hashes, n in counted:
        if len(hashes):
            keys.append((hashes >> _LOW << _LOW) | np.minimum(n, LEAST).astype(np.uint64))
            held += len(hashes)
        if held >= PACKET_ROWS:
            yield packed(keys)
            keys, held = [], 0
    if keys:
        yield packed(keys)


def frequent_marks(counts: DataFrame, ranges: int) -> DataFrame:
    """``mark``, the hashes of all packets that are counted ``LEAST`` times or more."""
    width = HASH_BITS + 1 - ranges.bit_length()

    def total(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        keys = []
        for packet in table.column("packet"):
            data = np.frombuffer(packet.as_buffer(), np.uint8)
            cut = len(data) // (_HASH_BYTES + 1) * _HASH_BYTES
            keys.append((np.cumsum(_from_planes(data[:cut], _HASH_BYTES)) << _LOW) | _from_planes(data[cut:], 1))
        hashes, n = _summed(np.concatenate(keys))
        marks = (hashes[n >= LEAST] + np.uint64(key[0].as_py() << width)) << _LOW
        return pa.table({"mark": pa.array(marks.view(np.int64))})

    return counts.groupBy("range").applyInArrow(total, "mark bigint")


def count_words(ranges: int):
    """The map from shards to packets of their words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = Dictionary.read(batch, k)
                n = np.bincount(read_symbols(batch.column("symbols")[k]), minlength=len(found.words) + 1)[1:]
                yield _phrase_hashes([found.hashes()]), n

    return lambda batches: packets(counted(batches), ranges)


# Frequent phrases as a table of bits.


def _phrase_hashes(hashes: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        total = total * _ODD + h
    return mixed(total)


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def bit_table(marks: DataFrame) -> np.ndarray:
    """A table with the bits of ``mark`` set, packed into 64-bit words."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * marks.count()).bit_length()))
    slot = F.shiftrightunsigned("mark", 64 - bits)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
    words = marks.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(mask).alias("mask"))
    table = words.toArrow()  # at most 2^(MOST_BITS - 6) rows
    packed = np.zeros(1 << (bits - 6), np.uint64)
    packed[table["word"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return packed


def _may_be_frequent(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = _slots(hashes, 6 + len(table).bit_length() - 1)
    return (table[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) > 0


# The FM-index.


def _order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of whole numbers in their order, equal ones as they come, and whether each differs from the last."""
    bits = max(1, len(keys).bit_length())
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return order, np.concatenate(([True], np.diff(keys[order]) > 0))[: len(keys)]
    both = (keys.astype(np.int64) << bits) | np.arange(len(keys))  # sorting numbers is faster than sorting places
    both.sort()
    order = both & ((1 << bits) - 1)
    both >>= bits
    return order, np.concatenate(([True], both[1:] != both[:-1]))


def transform(symbols: np.ndarray) -> np.ndarray:
    """The symbols before the rotations of a sequence, in the order of the rotations' first ``LONGEST`` symbols."""
    width, rank = 1, symbols.astype(np.int64)
    while width < LONGEST:
        order, new = _order(rank * (int(rank.max()) + 1) + np.roll(rank, -width))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        width *= 2
    return symbols[order - 1]


@dataclass
class Phrases:
    """Phrases of one length: their words and their intervals in the order of the sequence and of its reverse."""

    words: list[np.ndarray]
    begin: np.ndarray
    mirror: np.ndarray
    n: np.ndarray

    def where(self, kept: np.ndarray | slice) -> Phrases:
        return Phrases([w[kept] for w in self.words], self.begin[kept], self.mirror[kept], self.n[kept])

    def parts(self, most: int) -> Iterator[Phrases]:
        """Parts that occur about ``most`` times in all; a phrase that occurs more often stands alone."""
        ends = np.cumsum(self.n)
        begin = 0
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - self.n[begin] + most, side="right")))
            yield self.where(slice(begin, end))
            begin = end


def _steps(before: np.ndarray) -> np.ndarray:
    """Where the rotation that begins one symbol earlier stands, for each place of the order."""
    steps = np.empty(len(before), np.int32)
    steps[_order(before)[0]] = np.arange(len(before), dtype=np.int32)
    return steps


def _extensions(before: np.ndarray, steps: np.ndarray, begin: np.ndarray, n: np.ndarray):
    """All words found in the intervals: whose, which, how often, the new interval, and how many smaller stand there."""
    owner = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(owner)) - first[owner] + begin[owner]
    word = before[place].astype(np.int64)
    order, new = _order(owner * (int(before.max()) + 1) + word)
    starts = np.flatnonzero(new) if len(order) else order
    at = order[starts]
    count = np.diff(np.append(starts, len(order)))
    real = word[at] > 0  # 0 is the end of a piece
    at, starts, count = at[real], starts[real], count[real]
    return owner[at], word[at], count, steps[place[at]].astype(np.int64), starts - first[owner[at]]


class FmIndex:
    """Both transforms of a shard; phrases are extended by a word to the left or to the right."""

    def __init__(self, before: np.ndarray, after: np.ndarray) -> None:
        self.before, self.after = before, after
        self.earlier, self.later = _steps(before), _steps(after)

    def single(self) -> Phrases:
        counts = np.bincount(self.before)
        begin = np.cumsum(counts) - counts
        return Phrases([np.arange(1, len(counts))], begin[1:], begin[1:], counts[1:])

    def left(self, phrases: Phrases) -> Phrases:
        owner, word, n, begin, smaller = _extensions(self.before, self.earlier, phrases.begin, phrases.n)
        return Phrases([word, *(w[owner] for w in phrases.words)], begin, phrases.mirror[owner] + smaller, n)

    def right(self, phrases: Phrases) -> Phrases:
        owner, word, n, mirror, smaller = _extensions(self.after, self.later, phrases.mirror, phrases.n)
        return Phrases([*(w[owner] for w in phrases.words), word], phrases.begin[owner] + smaller, mirror, n)


def read_index(batch: pa.RecordBatch, k: int, table: np.ndarray) -> tuple[Dictionary, FmIndex] | None:
    """The frequent words of a shard and the index of its texts, in which all other words are 0; None without any."""
    found = Dictionary.read(batch, k)
    kept = _may_be_frequent(table, _phrase_hashes([found.hashes()]))
    if not kept.any():
        return None
    renumbered = np.concatenate(([0], np.cumsum(kept) * kept)).astype(np.int32)
    symbols = renumbered[read_symbols(batch.column("symbols")[k])]
    symbols = symbols[np.concatenate(([True], (symbols[1:] > 0) | (symbols[:-1] > 0)))]
    return found.where(kept), FmIndex(transform(symbols), transform(symbols[::-1]))


def count_phrases(tables, length: int, ranges: int):
    """The map from shards to their phrases whose shorter parts may be frequent.

    Below ``LONGEST`` it gives packets of the phrases of ``length`` words; else ``lang, phrase, words, n``, the
    texts of phrases of all lengths, those shorter than ``LONGEST`` only if they may be frequent themselves.
    """

    def frequent(hashes: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        return _may_be_frequent(tables.value[len(words) - 1], _phrase_hashes([hashes[w] for w in words]))

    def grown(index: FmIndex, hashes: np.ndarray, phrases: Phrases, width: int) -> Iterator[Phrases]:
        """All phrases from ``width`` to ``length`` words from those of ``width - 1``, part by part."""
        for part in phrases.parts(PART_ROWS):
            longer = index.right(part) if width % 2 == 0 else index.left(part)
            if width > 2:  # the other phrase of one word less
                longer = longer.where(frequent(hashes, longer.words[1:] if width % 2 == 0 else longer.words[:-1]))
            if width < length:
                longer = longer.where(frequent(hashes, longer.words))
            yield longer
            if width < length:
                yield from grown(index, hashes, longer, width + 1)

    def indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Dictionary, np.ndarray, FmIndex]]:
        for batch in batches:
            for k in range(batch.num_rows):
                if read := read_index(batch, k, tables.value[0]):
                    yield read[0], np.concatenate(([np.uint64(0)], read[0].hashes())), read[1]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, hashes, index in indexes(batches):
            for phrases in grown(index, hashes, index.single(), 2):
                if len(phrases.words) == length:
                    yield _phrase_hashes([hashes[w] for w in phrases.words]), phrases.n

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, hashes, index in indexes(batches):
            words, langs = pa.array(found.words, pa.binary()).cast(pa.string()), pa.array(found.langs, pa.string())
            yield texts(langs, found.of, words, index.single())
            for phrases in grown(index, hashes, index.single(), 2):
                yield texts(langs, found.of, words, phrases)

    def texts(langs: pa.Array, of: np.ndarray, words: pa.Array, phrases: Phrases) -> pa.RecordBatch:
        parts = [words.take(pa.array(w - 1)) for w in phrases.words]
        width = pa.array(np.full(len(phrases.n), len(parts), np.int32))
        lang = langs.take(pa.array(of[phrases.words[0] - 1]))
        return pa.RecordBatch.from_arrays(
            [lang, pc.binary_join_element_wise(*parts, " "), width, pa.array(phrases.n)],
            names=["lang", "phrase", "words", "n"],
        )

    return written if length == LONGEST else lambda batches: packets(hashed(batches), ranges)


def frequent_phrases(docs: DataFrame, text: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of the phrases of 1 to ``LONGEST`` words that occur ``LEAST`` times; ``lang, n`` of all words."""
    context = docs.sparkSession.sparkContext
    bound_batches(docs.sparkSession, BATCH_BYTES)
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    shards = rows.mapInArrow(cut_shards, f"{Dictionary.COLUMNS}, sizes array<bigint>, symbols binary")
    shards = materialize(shards, "shards", **SHARD_FILES)
    sizes = shards.select(F.explode(F.arrays_zip("langs", "sizes")).alias("of"))
    totals = sizes.groupBy(F.col("of.langs").alias("lang")).agg(F.sum("of.sizes").alias("n"))
    shards = shards.drop("sizes")
    n = totals.agg(F.sum("n")).first()[0] or 0
    ranges = max(LEAST_RANGES, 1 << (n // RANGE_WORDS).bit_length())
    tables = []
    for length in range(1, LONGEST):
        counted = count_phrases(context.broadcast(tables), length, ranges) if tables else count_words(ranges)
        found = frequent_marks(shards.mapInArrow(counted, "range bigint, packet binary"), ranges)
        tables.append(bit_table(materialize(found, "marks")))
    found = shards.mapInArrow(
        count_phrases(context.broadcast(tables), LONGEST, ranges), "lang string, phrase string, words int, n bigint"
    )
    found = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= LEAST)
    return materialize(found, "frequent"), totals


def _part(first: Column | int, words: Column | int) -> Column:
    return F.array_join(F.slice("words", first, words), " ")


def _best(rows: DataFrame, *keys: Column | str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``TOP`` phrases."""
    frequent, totals = frequent_phrases(docs, text, lang)
    candidates = frequent.where("words > 1").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " ", -1))
    counts = frequent.where(F.col("words") < LONGEST).drop("words")
    size = F.size("words")
    extended = candidates.where(size > 2)
    extended = extended.select("lang", "a", F.explode(F.array(_part(1, size - 1), _part(F.lit(2), size - 1))).alias("phrase"))
    extended = extended.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(extended, ["lang", "phrase"], "left")
    kept = kept.where(
        F.col("longer").isNull() | (F.col("longer").cast(_BIG) * 100 < F.col("a").cast(_BIG) * COVERED)
    ).drop("longer")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("first"), _part(F.col("cut") + 1, size).alias("rest"))
    cuts = materialize(cuts, "cuts")
    for part, name in (("first", "l"), ("rest", "r")):
        table = counts.withColumnsRenamed({"phrase": part, "f": name})
        cuts = materialize(join_unevenly(cuts, table, ["lang", part]), "cuts")
    score = F.expr(f"cast({SCALE} as {_BIG}) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min_by(F.struct("score", "l", "r"), F.struct("score", "cut")).alias("best")
    )
    scored = scored.select("lang", "phrase", "a", "best.*")
    best = _best(_best(scored, "lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).drop("rank"), "lang")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
