"""Near-duplicate texts by consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its shingles of five words (all words, if it has fewer). A shingle weighs
its count in the text times the mean inverse document frequency of its words, which is damped to
between 1 and 1 + ``DAMPED``, so that rare words count for more without making an edited word outweigh
the rest. Document frequencies are counted over all texts, in ``BUCKETS`` hashed counters: a table of
fixed size.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples from each set: a shingle is drawn
with probability in proportion to its weight, and two sets draw the same one as often as their
weighted Jaccard similarity says. Random numbers come from tables of 65,536 gamma draws, looked up by a hash of
shingle and sample. Texts that agree on all samples of a band meet in a bucket.

Equal texts (by 128-bit digest) are grouped first, and only one of each group goes on. Each member of a bucket is
compared with the bucket's centre, and those that are not found similar meet again around another centre,
``ROUNDS`` times. What is then left are buckets that still hold several components. Their members are
compared in *blocks* of about ``BLOCK`` texts: a bucket of many blocks becomes one row set for each pair of blocks, in
which all similarities are worked out at once as products of matrices (texts by shingles), exactly. So
every two texts that share a bucket are compared, unless they are of one component already, while the rows that
move grow with the members and blocks of a bucket, not with its pairs; and of the links found only as many as hold their
components together are kept. Buckets with the same members are compared once. A link is a weighted or a plain Jaccard
similarity of ``SIMILAR`` or more. Classes are the connected components of the links, found by spreading the
smallest id; every step is written to the shared folder.

A row's ``class_id`` is the smallest id in its class. Rows with the same id are one node. Texts that
are null or without a word are in no class but their own, and rows without an id have the class null
and are kept. Empty tables give an empty result. Columns of a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from headersieve.llm.bytes import blocks, flat_texts, hashed_words, mixed, windows
from headersieve.llm.texts import NOT_SPACE, bound_batches, whole_runs
from headersieve.session import fresh_path, materialize

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 12, 3
ROUNDS = 3
BUCKETS = 1 << 18
DAMPED = 0.25
BLOCK = 1024
#: Shingles that are put into one product of matrices; those that fewer than one pair in ``RARE`` has are not.
WIDE = 2048
RARE = 128
#: Pairs that are counted one by one at a time.
FLUSH_PAIRS = 1 << 22
BLOCK_BYTES = 1 << 20
FLUSH_BUCKETS = 1 << 21

_DRAWS = np.random.default_rng(20240501)
_R = (_DRAWS.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_LOG_C = np.log(_DRAWS.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_BETA = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_BAND_SEEDS = mixed(np.arange(101, 101 + BANDS, dtype=np.uint64))
_ODD = np.uint64(0xD6E8FEB86659FD93)
_LOW32 = np.uint64(0xFFFFFFFF)


def _buckets(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - 18)).astype(np.int64)


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, n``: in how many texts each bucket of words occurs."""
    total, waiting = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        data, offsets = flat_texts(batch.column("text"))
        for begin, end in blocks(offsets, BLOCK_BYTES):
            words, owner, _ = hashed_words(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
            both = np.unique(owner * np.int64(BUCKETS) + _buckets(words))
            total += np.bincount(both % BUCKETS, minlength=BUCKETS)
            waiting += len(both)
    hit = np.flatnonzero(total)
    if len(hit):
        yield pa.RecordBatch.from_pydict({"bucket": hit, "n": total[hit]})


def fit_weights(docs: DataFrame, text: str) -> np.ndarray:
    """The damped inverse document frequency of each bucket of words."""
    bound_batches(docs.sparkSession)
    counted = docs.select(F.col(text).alias("text")).mapInArrow(count_buckets, "bucket bigint, n bigint")
    table = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    found = np.zeros(BUCKETS)
    found[table["bucket"].to_numpy()] = table["n"].to_numpy()
    every = max(2, docs.count())
    rarity = np.log((every + 1) / (np.minimum(found, every) + 1)) / np.log(every + 1)
    return (1 + DAMPED * rarity).astype(np.float32)


def shingles(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of each different shingle, in the order of text and hash."""
    texts, hashes, weight, _ = counted_shingles(data, offsets, weights)
    return texts, hashes, weight.astype(np.float32)


def counted_shingles(
    data: np.ndarray, offsets: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, weight and number of each different shingle, in the order of text and hash."""
    words, owner, _ = hashed_words(data, offsets)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    hashes, at = windows(words, owner, WIDTH)
    sums = np.concatenate(([0.0], np.cumsum(weights[_buckets(words)].astype(np.float64))))
    mean = (sums[at + WIDTH] - sums[at]) / WIDTH
    texts = owner[at]
    # Texts of fewer words are one shingle.
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    length = np.diff(np.append(first, len(words)))
    short = length < WIDTH
    if short.any():
        place = np.arange(len(words)) - np.repeat(first, length)
        mark = np.add.reduceat(mixed(words + place.astype(np.uint64)), first)[short]
        hashes = np.concatenate([hashes, mixed(mark)])
        mean = np.concatenate([mean, (sums[first + length] - sums[first])[short] / length[short]])
        texts = np.concatenate([texts, owner[first][short]])
    order = np.lexsort((hashes, texts))
    hashes, texts, mean = hashes[order], texts[order], mean[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])))
    begins = np.flatnonzero(new)
    times = np.diff(np.append(begins, len(hashes)))
    return texts[begins], hashes[begins], times * mean[begins], times


def samples(texts: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their ``BANDS * ROWS`` samples as 32-bit marks."""
    begins = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1])))
    log_weight = np.log(weights)
    out = np.empty((len(begins), BANDS * ROWS), dtype=np.uint64)
    for k, seed in enumerate(_SEEDS):
        x = (hashes ^ seed) * _ODD
        x ^= x >> np.uint64(32)
        x *= _ODD
        r, beta = _R[x & np.uint64(0xFFFF)], _BETA[(x >> np.uint64(16)) & np.uint64(0xFFFF)]
        step = np.floor(log_weight / r + beta)
        value = _LOG_C[x & np.uint64(0xFFFF)] - r * (step - beta + 1)
        # As unsigned numbers the bits of floats order like the floats.
        bits = value.view(np.int32).astype(np.int64)
        rank = np.where(bits < 0, ~bits & 0xFFFFFFFF, bits | 0x80000000).astype(np.uint64)
        mark = ((x >> np.uint64(32)) + step.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & _LOW32
        out[:, k] = np.minimum.reduceat((rank << np.uint64(32)) | mark, begins) & _LOW32
    return texts[begins], out


def sign_texts(weights):
    """The map from texts to the keys of their bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            data, offsets = flat_texts(batch.column("text"))
            keys = np.zeros((len(batch), BANDS), dtype=np.uint64)
            some = np.zeros(len(batch), dtype=bool)
            for begin, end in blocks(offsets, BLOCK_BYTES):
                piece = shingles(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], table)
                if not len(piece[0]):
                    continue
                texts, drawn = samples(*piece)
                band = np.zeros((len(texts), BANDS), dtype=np.uint64)
                for row in range(ROWS):
                    band = mixed(band * _ODD + drawn[:, row::ROWS] + _BAND_SEEDS)
                keys[begin + texts], some[begin + texts] = band, True
            flat = pa.array(keys[some].view(np.int64).ravel())
            at = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), lists], names=["id", "digest", "bands"]
            )

    return sign


def similarity(weights):
    """The Arrow function that gives the larger of weighted and plain Jaccard similarity of two texts."""

    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = weights.value
        for left, right in batches:
            out = np.zeros(len(left))
            for i in range(len(left)):
                _, a, x = shingles(*flat_texts(left.slice(i, 1)), table)
                _, b, y = shingles(*flat_texts(right.slice(i, 1)), table)
                both, at, of = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                least = float(np.minimum(x[at], y[of]).sum())
                weighted = least / max(float(x.sum()) + float(y.sum()) - least, 1e-9)
                out[i] = max(weighted, len(both) / max(len(a) + len(b) - len(both), 1))
            yield pa.array(out)

    return similar


def pack_shingles(weights):
    """The map from texts to ``rep, n, shingles, weights, singles``: all shingles of a text as packed numbers.

    A shingle that occurs t times is there t times, told apart by its number; ``singles`` counts the different ones.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_texts(batch.column("text"))
            for begin, end in blocks(offsets, BLOCK_BYTES):
                texts, hashes, weight, times = counted_shingles(
                    data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], weights.value
                )
                if not len(texts):
                    continue
                of = np.repeat(np.arange(len(texts)), times)
                number = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                first = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1])))
                cuts = np.append(first, len(texts))
                long = np.concatenate(([0], np.cumsum(times)))[cuts]
                # The first of equal shingles keeps its hash, so that plain similarities see it.
                marks = np.where(number > 0, mixed(hashes[of] + number.astype(np.uint64)), hashes[of])
                shares = (weight / times)[of]
                rows = [np.lexsort((number[a:b] > 0,)) + a for a, b in zip(long[:-1], long[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(begin + texts[first])),
                        pa.array([marks[r].tobytes() for r in rows], pa.binary()),
                        pa.array([shares[r].tobytes() for r in rows], pa.binary()),
                        pa.array(np.diff(cuts)),
                    ],
                    names=["rep", "shingles", "weights", "singles"],
                )

    return pack


class Packed:
    """Some texts' shingles, numbered over all of them; those that only one text has count for its size alone."""

    def __init__(self, shingles: list[np.ndarray], weights: list[np.ndarray], singles: np.ndarray) -> None:
        length = np.array([len(x) for x in shingles])
        self.singles = singles
        self.sizes = np.array([float(x.sum()) for x in weights])
        text = np.repeat(np.arange(len(shingles)), length)
        place = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
        _, number, found = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
        common = found[number] > 1
        _, self.column = np.unique(number[common], return_inverse=True)
        self.text, self.weight = text[common], np.concatenate(weights)[common]
        self.plain = (place < np.repeat(singles, length))[common]
        order = np.argsort(self.column, kind="stable")
        self.text, self.weight, self.plain, self.column = (x[order] for x in (self.text, self.weight, self.plain, self.column))

    def similar(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the larger of weighted and plain similarity is ``SIMILAR``, for texts ``left`` by ``right``."""
        shape = len(left), len(right)
        sides = []
        for side in (left, right):
            row = np.full(len(self.sizes), -1)
            row[side] = np.arange(len(side))
            held = row[self.text] >= 0
            sides.append((row[self.text[held]], self.column[held], self.weight[held], self.plain[held]))
        columns = int(self.column[-1]) + 1 if len(self.column) else 0
        counts = [np.bincount(side[1], minlength=columns) for side in sides]
        pairs = counts[0] * counts[1]
        # Columns that many texts hold go into matrices, of the others the few pairs are counted.
        dense = pairs * RARE > shape[0] * shape[1]
        least, both = self._products(sides, dense, shape)
        pairs = np.where(dense, 0, pairs)
        (row_a, _, weight, plain_a), (row_b, _, _, plain_b) = sides
        first_a, first_b = (np.cumsum(c) - c for c in counts)
        cuts = np.searchsorted(np.cumsum(pairs), np.arange(0, int(pairs.sum()) + FLUSH_PAIRS, FLUSH_PAIRS))
        for begin, end in zip(cuts[:-1], [*(cuts[1:-1]), columns]):
            n = pairs[begin:end]
            of = np.repeat(np.arange(begin, end), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            a, b = first_a[of] + at // counts[1][of], first_b[of] + at % counts[1][of]
            cell = row_a[a] * shape[1] + row_b[b]
            least += np.bincount(cell, weight[a], minlength=least.size).reshape(shape)
            both += np.bincount(cell, plain_a[a] & plain_b[b], minlength=both.size).reshape(shape)
        weighted = least / np.maximum(self.sizes[left][:, None] + self.sizes[right] - least, 1e-9)
        plain = both / np.maximum(self.singles[left][:, None] + self.singles[right] - both, 1)
        return np.maximum(weighted, plain) >= SIMILAR

    @staticmethod
    def _products(sides, dense: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """What the texts have in common in the dense columns: by weight, and in number of different shingles."""
        least, both = np.zeros(shape), np.zeros(shape)
        number = np.cumsum(dense) - 1
        for begin in range(0, int(dense.sum()), WIDE):
            kept = dense & (number >= begin) & (number < begin + WIDE)
            matrices = []
            for (row, column, weight, plain), size in zip(sides, shape):
                held = kept[column]
                at = row[held], number[column[held]] - begin
                for values in (weight[held], np.ones(int(held.sum())), plain[held]):
                    matrix = np.zeros((size, WIDE))
                    matrix[at] = values
                    matrices.append(matrix)
            # A shingle weighs the same wherever it is, but for rounding.
            least += matrices[0] @ matrices[4].T
            both += matrices[2] @ matrices[5].T
        return least, both


def link_blocks(kind: pa.DataType):
    """The map from members of pairs of blocks, whole and in a row, to links ``a, b`` between their components."""

    def links(run: pa.Table) -> tuple[list, list]:
        singles = run["singles"].to_numpy()
        shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in run["shingles"].combine_chunks()]
        shares = [np.frombuffer(x.as_buffer(), np.float64) for x in run["weights"].combine_chunks()]
        labels = run["label"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block, reps = run["block"].to_numpy(), run["rep"].to_pylist()
        left = np.flatnonzero(block == run["low"][0].as_py())
        right = np.flatnonzero(block == run["high"][0].as_py())
        near = Packed(shingles, shares, singles).similar(left, right) & (labels[left][:, None] != labels[right])
        x, y = (side[k] for side, k in zip((left, right), np.nonzero(near)))
        # One link is enough for each step that brings two components together.
        parent = np.arange(labels.max() + 1 if len(labels) else 0)

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        a, b = [], []
        for i, j in zip(x.tolist(), y.tolist()):
            p, q = root(labels[i]), root(labels[j])
            if p != q:
                parent[p] = q
                a.append(max(reps[i], reps[j]))
                b.append(min(reps[i], reps[j]))
        return a, b

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, ["bucket", "low", "high"]):
            if run.num_rows > 1:
                a, b = links(run)
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return link


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with the ``label`` of their ``rep``, which is itself if no link has it."""
    return nodes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` of the nodes of ``edges`` (``a, b``): the smallest id that each can reach."""
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["id"])
            .groupBy("a")
            .agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "id")
        )
        lower = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = materialize(lower, "labels")
        # A label is an id itself: jumping to its label halves the way that is left.
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moved = lower.join(jump, "label", "left").select("id", "was", F.least("label", "far").alias("label"))
        moved = materialize(moved, "labels")
        labels = moved.select("id", "label")
        if moved.where(F.col("was") != F.col("label")).isEmpty():
            return labels


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, class_size, kept`` of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    weights = spark.sparkContext.broadcast(fit_weights(rows, "text"))
    kind = dict(rows.dtypes)["id"]
    bound_batches(spark)
    signed = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).mapInArrow(
        sign_texts(weights), f"id {kind}, digest string, bands array<bigint>"
    )
    signed = materialize(signed, "signed")
    told = F.col("id").isNotNull() & (F.size("bands") > 0)
    groups = signed.where(told).groupBy("digest").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"))
    groups = materialize(groups, "groups")
    met = groups.select("rep", F.explode("bands").alias("bucket"))
    crowded = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met = materialize(met.join(crowded, "bucket"), "met")

    tried = links = labels = firsts = None
    open_ = met
    for turn in range(ROUNDS):
        order = F.col("rep") if turn == 0 else F.xxhash64("rep", "bucket", F.lit(turn))
        centres = materialize(
            open_.groupBy("bucket").agg(F.min_by("rep", order).alias("centre"), F.count("*").alias("n")).where("n > 1"),
            "centres",
        ).drop("n")
        firsts = centres if firsts is None else firsts
        pairs = (
            open_.join(centres, "bucket")
            .where("rep <> centre")
            .select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b"))
            .distinct()
        )
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            break
        linked = materialize(_verified(rows, pairs, weights), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = linked if links is None else links.unionByName(linked)
        labels = components(links)
        # Members that no link has brought to the component of a centre stay open.
        done = _labelled(centres.withColumnRenamed("centre", "rep"), labels).select("bucket", "label")
        open_ = _labelled(open_, labels).join(done, ["bucket", "label"], "left_anti").select("rep", "bucket")
        open_ = materialize(open_, "open")
    if labels is not None:
        # The first centre of a bucket has met all members. Two others may not have met.
        others = met.join(firsts.withColumnRenamed("centre", "rep"), ["bucket", "rep"], "left_anti")
        labels = _with_blocks(rows, others, labels, links, weights)
    reps = groups.select("digest", "rep")
    if labels is not None:
        reps = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
            "digest", F.coalesce("label", "rep").alias("rep")
        )
    reps = materialize(reps, "classes")
    # Rows that repeat an id under different texts are one node.
    own = signed.where(told).select("id", "digest").join(reps, "digest").groupBy("id").agg(
        F.min("rep").alias("_first"), F.max("rep").alias("_last")
    )
    own = materialize(own, "own")
    split = own.where("_first <> _last").select(F.col("_first").alias("a"), F.col("_last").alias("b"))
    classes = own.select("id", F.col("_first").alias("class_id"))
    if not split.isEmpty():
        joined = components(split).select(F.col("id").alias("class_id"), "label")
        classes = classes.join(joined, "class_id", "left").select("id", F.coalesce("label", "class_id").alias("class_id"))
    found = signed.select("id").join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    return found.select(
        F.col("id").alias(key),
        "class_id",
        F.coalesce(F.col("class_id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def _with_blocks(rows: DataFrame, met: DataFrame, labels: DataFrame, links: DataFrame, weights) -> DataFrame:
    """``labels`` with every link between members ``rep`` of one ``bucket``."""
    met = materialize(_labelled(met, labels), "others")
    each = met.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.min("label").alias("x"), F.max("label").alias("y"),
        F.bit_xor(F.xxhash64("rep")).alias("same"), F.sum(F.xxhash64("rep", F.lit(1)) % (1 << 32)).alias("sum"),
    )
    apart = each.where("x <> y").groupBy("members", "same", "sum").agg(F.min("bucket").alias("bucket"))
    blocks_ = F.ceil(F.col("members") / BLOCK).cast("bigint")
    apart = materialize(apart.select("bucket", blocks_.alias("blocks")), "apart")
    if apart.isEmpty():
        return labels
    placed = met.join(apart, "bucket").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(2)), "blocks"))
    # A member goes to the pairs that its block makes with each block of the bucket.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("bucket", "block", "rep", "label", other).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "label"
    )
    ids = materialize(placed.select(F.col("rep").alias("id")).distinct(), "ids")
    kind = dict(rows.dtypes)["id"]
    packed = _texts(rows, ids).mapInArrow(
        pack_shingles(weights), f"rep {kind}, shingles binary, weights binary, singles bigint"
    )
    packed = materialize(packed, "packed")
    pair = ["bucket", "low", "high"]
    runs = placed.join(packed, "rep").repartition(*pair).sortWithinPartitions(*pair)
    found = materialize(runs.mapInArrow(link_blocks(to_arrow_type(rows.schema["id"].dataType)), f"a {kind}, b {kind}"), "links")
    return labels if found.isEmpty() else components(links.select("a", "b").unionByName(found))


def _verified(rows: DataFrame, pairs: DataFrame, weights) -> DataFrame:
    """The pairs that are similar, by their whole texts."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = _texts(rows, materialize(ids, "ids"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    near = F.arrow_udf(similarity(weights), "double")
    return pairs.join(left, "a").join(right, "b").where(near("left", "right") >= SIMILAR).select("a", "b")


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, text`` of the rows with ``ids``, written anew."""
    spark = rows.sparkSession
    path = fresh_path(spark, "texts")
    # Only the id decides; of rows that repeat one, the longest text stands for it.
    wanted = rows.where(F.col("text").rlike(NOT_SPACE)).join(ids, "id")
    wanted.write.option("compression", "zstd").parquet(path)
    texts = spark.read.parquet(path)
    repeated = texts.groupBy("id").count().where("count > 1")
    if not repeated.isEmpty():
        texts = texts.groupBy("id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    return texts


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class, columns unchanged."""
    dropped = materialize(classify(docs, key, text).where("not kept").select(F.col(key).alias("_id")), "dropped")
    return docs.join(dropped, docs[key] == dropped["_id"], "left_anti")
