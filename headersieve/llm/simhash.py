"""Near-duplicate texts by fingerprints of 64 bits, linked by a self-join of their binary trie.

A text's words are runs of anything but white space, with A-Z in lower case; its features are the shingles
of ``WIDTH`` words, repeats included (the whole sequence, if it has fewer words). A bit of the fingerprint
is 1 if it is set in over half of the shingles' XXH64 values (seed 42). A text without words, or null, has
the fingerprint zero. Fingerprints that differ in at most ``BUDGET`` bits are linked.

The different fingerprints form a binary trie. The join starts with the pair (root, root) and goes down
both sides at once: the four pairs of children of a pair of nodes have the errors of the pair, or one more
if their bits differ, and a pair is given up as soon as it has more than ``BUDGET`` errors.

* The upper part is walked by Spark. A node is *open* if more than ``LEAF`` fingerprints, half a megabyte, (or a
  50,000th of all, if that is more) lie below it. At depth d a fingerprint has 1 + d + d (d - 1) / 2 partners, so
  large leaves keep the copies few; a level has at most 50,000 open nodes, and these are all the driver
  and the tasks ever hold. A pair goes down while one of its nodes is open, however deep that is, so one
  hot prefix is spread over many tasks. Each fingerprint finds by itself the pairs that it belongs to.
* The rest of each pair, two sorted runs of bounded length, is walked in numpy, all pairs of a task at the
  same time, down to nodes of a few fingerprints, which are compared.

A task hands on no more links than are needed to hold its components together, as trees of small degree;
``components`` joins them across tasks.

A row's ``component_id`` is the smallest id that can be reached. Rows without an id are linked like others but never
give their component its name; a component without any id is called null. Rows that repeat an id or a text
each keep their own row. An empty table gives an empty result; columns of other names are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headersieve.llm.bytes import LOWER
from headersieve.llm.near_dup import components
from headersieve.llm.texts import bound_batches, join_unevenly
from headersieve.session import materialize

WIDTH = 3
SEED = 42
BUDGET = 2
LEAF = 1 << 16
MOST_OPEN = 50_000
STEP = 4
DEGREE = 32
FEW = 4
CHUNK = 1 << 16
FRONTIER = 1 << 20
BITS = 64

_LOWER = LOWER.tobytes()
_ONE = np.uint64(1)


def fingerprint(data: bytes) -> int:
    """The fingerprint of one text."""
    words = data.translate(_LOWER).split()  # splits at blank and tab to carriage return
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(WIDTH, len(words))
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(starts), CHUNK):
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], stops[k : k + CHUNK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprint_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, print`` of the texts, the fingerprint as a signed number."""
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.large_binary())
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "print"])


# The upper trie: levels STEP, 2 * STEP, ... as (depth, prefixes that are not empty, open prefixes).
Levels = list[tuple[int, np.ndarray, np.ndarray]]


def open_levels(prints: DataFrame, leaf: int) -> Levels:
    """For each level below an open node, its children that are not empty and those that are open."""
    levels: Levels = []
    rows, parents = prints, None
    for depth in range(STEP, BITS + 1, STEP):
        prefix = F.shiftrightunsigned("print", BITS - depth) if depth < BITS else F.col("print")
        below = rows.select(prefix.alias("prefix"))
        if parents is not None:
            above = F.shiftrightunsigned("prefix", STEP)
            open_ = rows.sparkSession.createDataFrame([(p,) for p in parents], "above bigint")
            # At most MOST_OPEN rows, as each stands for more than that part of all fingerprints.
            below = below.join(F.broadcast(open_), above == F.col("above"), "left_semi")
        counted = below.groupBy("prefix").count().toArrow()  # at most 2^STEP children of each open node
        found = counted["prefix"].to_numpy().view(np.uint64)
        order = np.argsort(found)
        found, n = found[order], counted["count"].to_numpy()[order]
        levels.append((depth, found, found[n > leaf]))
        parents = levels[-1][2].view(np.int64).tolist()
        if not parents or depth == BITS:
            return levels
    return levels


def _is_in(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.searchsorted(found, values)
    return found[np.minimum(at, len(found) - 1)] == values


def route_prints(levels):
    """The map from fingerprints to the pairs of nodes they belong to: ``depth, low, high, print``."""
    masks = np.arange(1 << STEP, dtype=np.uint64)
    ones = np.bitwise_count(masks).astype(np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy().view(np.uint64)
            for k in range(0, len(prints), CHUNK // 16):
                yield from walk(prints[k : k + CHUNK // 16])

    def walk(prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        row = np.arange(len(prints))
        mask, errors = np.zeros(len(prints), np.uint64), np.zeros(len(prints), np.int64)
        known = np.ones(len(prints), bool)  # whether the other node's parent is open, so that its children are known
        for depth, filled, open_ in levels.value:
            parts = []
            for m, more in zip(masks, ones):
                fits = np.flatnonzero(errors + more <= BUDGET)
                parts.append((row[fits], (mask[fits] << np.uint64(STEP)) | m, errors[fits] + more, known[fits]))
            row, mask, errors, known = map(np.concatenate, zip(*parts))
            own = prints[row] >> np.uint64(BITS - depth)
            other = own ^ mask
            held = ~known | _is_in(other, filled)
            row, mask, errors, own, other = row[held], mask[held], errors[held], own[held], other[held]
            known = _is_in(other, open_)
            down = known | _is_in(own, open_)
            if depth == BITS:
                down[:] = False
            last = ~down
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(int(last.sum()), depth, np.int32)),
                    pa.array(np.minimum(own, other)[last].view(np.int64)),
                    pa.array(np.maximum(own, other)[last].view(np.int64)),
                    pa.array(prints[row[last]].view(np.int64)),
                ],
                names=["depth", "low", "high", "print"],
            )
            row, mask, errors, known = row[down], mask[down], errors[down], known[down]
            if not len(row):
                return

    return route


def pair_links(prints: np.ndarray, pairs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Walk pairs of trie nodes down together; the places of all linked fingerprints.

    ``pairs``: by depth, rows of (left begin, left end, right begin, right end, errors): runs of ``prints`` that are sorted and
    share their first ``depth`` bits; a run beside itself stands for the pairs within it.
    """
    entering = dict(pairs)
    front = np.zeros((0, 5), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(done: np.ndarray) -> None:
        for k in range(0, len(done), CHUNK):
            a, b, c, d, _ = done[k : k + CHUNK].T
            n = (b - a) * (d - c)
            of = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            left, right = a[of] + place // (d - c)[of], c[of] + place % (d - c)[of]
            near = (np.bitwise_count(prints[left] ^ prints[right]) <= BUDGET) & (prints[left] != prints[right])
            found.append((left[near], right[near]))

    def descend(front: np.ndarray, depth: int) -> None:
        for depth in range(depth, BITS):
            if depth in entering:
                front = np.concatenate([front, entering.pop(depth)])
            if not len(front):
                if not entering:
                    return
                continue
            a, b, c, d, errors = front.T
            few = (b - a) * (d - c) <= FEW * FEW
            compare(front[few])
            front = front[~few]
            if len(front) > FRONTIER:  # work off the halves one after the other
                descend(front[: len(front) // 2], depth)
                front = front[len(front) // 2 :]
            a, b, c, d, errors = front.T
            ones = np.concatenate(([0], np.cumsum((prints >> np.uint64(BITS - 1 - depth)) & _ONE, dtype=np.int64)))
            left, right = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
            own = a == c
            children = np.concatenate([
                np.stack([a, left, c, right, errors], axis=1),
                np.stack([left, b, right, d, errors], axis=1),
                np.stack([a, left, right, d, errors + 1], axis=1),
                np.stack([left, b, c, right, errors + 1], axis=1)[~own],
            ])
            front = children[(children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= BUDGET)]
        compare(front)  # at the last depth a run is one fingerprint

    compare(entering.pop(BITS, front))
    descend(front, 0)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def spanning_trees(prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that hold the same components together as the links do, of degree ``DEGREE`` + 1 at most."""
    nodes, both = np.unique(np.concatenate([prints[left], prints[right]]), return_inverse=True)
    a, b = both[: len(left)], both[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == was).all():
            break
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1]))) if len(order) else order
    begin = np.repeat(first, np.diff(np.append(first, len(order))))
    place = np.arange(len(order)) - begin
    some = place > 0
    return nodes[order[some]], nodes[order[(begin + (place - 1) // DEGREE)[some]]]


def link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` within rows ``depth, low, high, print`` that come in this order."""
    names = ("depth", "low", "high", "print")

    def linked(depth: np.ndarray, low: np.ndarray, high: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        prints = prints.view(np.uint64)
        key = np.stack([depth.astype(np.int64), low, high], axis=1)
        begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        end = np.append(begin[1:], len(prints))
        depth, low, high = depth[begin].astype(np.int64), low[begin].view(np.uint64), high[begin].view(np.uint64)
        # A node of depth 1 or more has one sign, so its numbers are in order without it as well.
        far = np.array([
            a + np.searchsorted(prints[a:b] >> np.uint64(BITS - d), h) if h != l else a
            for a, b, d, l, h in zip(begin, end, depth.tolist(), low, high)
        ], np.int64).reshape(-1)
        own = low == high
        middle = np.where(own, end, far)
        rows = np.stack([begin, middle, far, end, np.bitwise_count(low ^ high).astype(np.int64)], axis=1)
        rows = rows[(rows[:, 0] < rows[:, 1]) & (rows[:, 2] < rows[:, 3])]
        depth = depth[(begin < middle) & (far < end)]
        left, right = pair_links(prints, [(d, rows[depth == d]) for d in np.unique(depth).tolist()])
        a, b = spanning_trees(prints, left, right)
        return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        more = tuple(batch.column(name).to_numpy() for name in names)
        rows = more if held is None else tuple(map(np.concatenate, zip(held, more)))
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = rows  # the last run may go on in the next batch
        if cut >= CHUNK or (cut and len(rows[0]) >= 4 * CHUNK):
            yield linked(*(x[:cut] for x in rows))
            held = tuple(x[cut:] for x in rows)
    if held is not None and len(held[0]):
        yield linked(*held)


def link_prints(prints: DataFrame, total: int) -> DataFrame:
    """``a, b``: links that hold together what is linked among ``total`` different fingerprints ``print``."""
    spark = prints.sparkSession
    levels = open_levels(prints, max(LEAF, total // MOST_OPEN))
    levels = spark.sparkContext.broadcast(levels)
    routed = prints.select("print").mapInArrow(route_prints(levels), "depth int, low bigint, high bigint, print bigint")
    pair = ["depth", "low", "high"]
    # The bits below the prefix order the fingerprints of a pair like unsigned numbers: those of the lower node first.
    in_low = F.expr(f"shiftrightunsigned(print, {BITS} - depth) = low")
    runs = routed.repartition(*pair).sortWithinPartitions(*pair, in_low.desc(), "print")
    return runs.mapInArrow(link_runs, "a bigint, b bigint").distinct()


def link_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint, component_id`` of each row; the fingerprint as 16 hexadecimal digits."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]
    printed = materialize(rows.mapInArrow(fingerprint_texts, f"id {kind}, print bigint"), "printed")
    prints = printed.groupBy("print").agg(F.min("id").alias("least"))
    prints = materialize(prints, "prints")
    links = materialize(link_prints(prints, prints.count()), "links")
    named = prints.withColumn("label", F.col("print"))
    if not links.isEmpty():
        labels = components(links).withColumnRenamed("id", "print").withColumnRenamed("label", "joined")
        named = prints.join(labels, "print", "left").withColumn("label", F.coalesce("joined", "print")).drop("joined")
        named = materialize(named, "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    table = join_unevenly(named.select("print", "label"), least, ["label"]).select("print", "component_id")
    found = join_unevenly(printed, materialize(table, "components"), ["print"])
    return found.select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
