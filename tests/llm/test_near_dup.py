"""Classes against the components of all similar pairs; samples against exact similarities."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from headersieve.llm import near_dup
from headersieve.llm.bytes import flat_texts
from headersieve.llm.near_dup import BANDS, BUCKETS, ROWS, classify, components, keep_first, samples, shingles

FLAT = np.ones(BUCKETS, np.float32)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sets(text):
    ws = words(text)
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    kept = [(i, sets(t)) for i, t in rows if words(t)]
    holders = {}
    for i, s in kept:
        for x in s:
            holders.setdefault(x, []).append((i, s))
    for i, s in kept:
        for j, o in {j: o for x in s for j, o in holders[x] if j < i}.items():
            if len(s & o) >= 0.8 * len(s | o):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in rows}


def test_samples_agree_as_often_as_sets_do():
    draw = random.Random(1)
    base = [f"w{draw.randrange(500)}" for _ in range(400)]
    for edits in (2, 8, 20):
        other = list(base)
        for _ in range(edits):
            other[draw.randrange(400)] = f"x{draw.random()}"
        flat = flat_texts(pa.array([" ".join(base), " ".join(other)]))
        texts, hashes, weights = shingles(*flat, FLAT)
        a, b = ({h: w for t, h, w in zip(texts, hashes, weights) if t == k} for k in (0, 1))
        least = sum(min(a[h], b[h]) for h in a.keys() & b.keys())
        exact = least / (sum(a.values()) + sum(b.values()) - least)
        _, drawn = samples(texts, hashes, weights)
        assert abs((drawn[0] == drawn[1]).mean() - exact) < 3.5 * (exact * (1 - exact) / (BANDS * ROWS)) ** 0.5 + 0.03


def test_classes_are_those_of_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    draw = random.Random(3)
    base = [f"v{draw.randrange(900)}" for _ in range(200)]
    for i in range(60):  # a large group of near copies, and exact ones
        other = list(base)
        other[draw.randrange(200)] = f"y{i}"
        rows += [(10_000 + i, " ".join(other))]
    rows += [(20_000 + i, " ".join(base)) for i in range(40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, class_id string")
    got = {r.doc_id: r.class_id for r in classify(docs).collect()}
    want = brute(rows)
    together = lambda c: {(i, j) for i in c for j in [c[i]] if i != j}
    missed, extra = together(want) - together(got), together(got) - together(want)
    assert len(missed) <= 0.02 * len(together(want)) and len(extra) <= 0.02 * len(together(want)), (missed, extra)
    assert len({got[i] for i in got if i >= 10_000}) == 1


def test_odd_rows(spark):
    long = "a b c d e f g h i j"
    rows = [(1, None), (2, ""), (3, " \n"), (None, long), (5, long), (4, long), (6, "a b"), (7, "a b"), (8, "b a"), (5, long)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, kept int")
    got = sorted(map(tuple, classify(docs).collect()), key=str)
    want = [(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (4, 4, True), (6, 6, True), (8, 8, True)]
    assert got == sorted([*want, (5, 4, False), (5, 4, False), (7, 6, False)], key=str)
    assert classify(docs.limit(0)).count() == 0
    kept = keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 4, 6, 8}


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (102, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a int, b int")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_blocks_give_exact_similarities(spark, monkeypatch):
    """All pairs at once, in small and large matrices, against sets and counts written out."""
    draw = random.Random(11)
    base = [f"t{draw.randrange(60)}" for _ in range(90)]
    texts = []
    for k in range(70):
        own = list(base[: draw.choice([draw.randrange(4, 91), draw.randrange(75, 91)])])
        for _ in range(draw.randrange(5)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(40)}"
        texts.append(" ".join(own * draw.choice([1, 1, 2])))  # repeated shingles
    texts += ["a b", "a b", "c", texts[0], " ".join(f"z{k}" for k in range(300))]
    table = np.array([1 + (k % 7) / 30 for k in range(BUCKETS)], np.float32)

    class Value:
        value = table

    pack = near_dup.pack_shingles(Value)
    rows = pa.Table.from_batches(pack([pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})]))
    assert rows["rep"].to_pylist() == list(range(len(texts)))
    shingle_lists = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
    shares = [np.frombuffer(x, np.float64) for x in rows["weights"].to_pylist()]
    want = next(near_dup.similarity(Value)([(pa.array([x for x in texts for _ in texts]), pa.array(texts * len(texts)))]))
    want = want.to_numpy().reshape(len(texts), len(texts)) >= near_dup.SIMILAR
    everyone, other = np.arange(len(texts)), ~np.eye(len(texts), dtype=bool)  # a text is not compared with itself
    for wide, rare, flush in ((2048, 128, 1 << 22), (7, 10**9, 5), (64, 0, 1), (3, 4, 50)):
        monkeypatch.setattr(near_dup, "WIDE", wide)
        monkeypatch.setattr(near_dup, "RARE", rare)
        monkeypatch.setattr(near_dup, "FLUSH_PAIRS", flush)
        packed = near_dup.Packed(shingle_lists, shares, rows["singles"].to_numpy())
        assert (packed.similar(everyone, everyone) == want)[other].all() and want.sum() > 120
        assert (packed.similar(everyone[5:20], everyone[30:]) == want[5:20, 30:]).all()


@pytest.mark.parametrize("block", [1024, 13])
def test_one_bucket_is_compared_whole(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)

    def all_meet(weights):
        def sign(batches):
            for batch in batches:
                bands = pa.array([[1]] * len(batch), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("digest"), bands], names=["id", "digest", "bands"]
                )

        return sign

    monkeypatch.setattr(near_dup, "sign_texts", all_meet)
    monkeypatch.setattr(near_dup, "fit_weights", lambda rows, text: FLAT)
    draw, texts = random.Random(7), []
    line = [f"w{k}" for k in range(300)]
    for k in range(40):  # a large group around line[100:200]
        texts.append([*line[100 : 110 + k], f"y{k}", *line[111 + k : 200]])
    # Chains away from it on both sides: each text is similar to its neighbours only.
    texts += [line[100 + d : 200 + d] for d in range(-100, 101, 10)]
    for g in range(25):  # small groups
        own = [f"g{g}_{k}" for k in range(60)]
        texts += [own, [*own[:-1], "end"], [*own[1:], "more"]]
    for g in range(20):  # texts of one template, about 0.7 to each other, some with a partner
        own = [*[f"t{k}" for k in range(80)], *[f"o{g}_{k}" for k in range(14)]]
        texts += [own] if g % 3 else [own, [*own, "tail"]]
    draw.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in classify(docs).collect()}
    assert got == brute(rows) and len(set(got.values())) == 1 + 25 + 20


def test_a_hot_template_makes_rows_by_members_not_by_pairs(spark, monkeypatch):
    """Hundreds of texts of one template, all about 0.7 to each other, in common buckets: few rows, no link lost."""
    draw, made = random.Random(9), []
    monkeypatch.setattr(near_dup, "BLOCK", 100)
    template = [f"t{k}" for k in range(60)]
    texts = [[*template, *(f"o{g}_{k}" for k in range(10))] for g in range(400)]
    texts += [[*texts[g], "tail"] for g in range(0, 400, 40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    real = near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df, label="table": (made.append((label, t := real(df, label))), t)[1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in classify(docs).collect()}
    assert got == brute(rows)
    most = max(table.count() for label, table in made)
    assert most <= 12 * len(rows)


def test_runs_are_whole():
    from headersieve.llm.texts import whole_runs

    draw = random.Random(4)
    keys = sorted((draw.randrange(6), draw.randrange(3)) for _ in range(100))
    table = pa.Table.from_pydict({"a": [k[0] for k in keys], "b": [k[1] for k in keys], "n": list(range(100))})
    for size in (1, 7, 100):
        runs = list(whole_runs(iter([*table.to_batches(max_chunksize=size), pa.RecordBatch.from_pydict({"a": [], "b": [], "n": []})]), ["a", "b"]))
        assert [len(set(zip(r["a"].to_pylist(), r["b"].to_pylist()))) for r in runs] == [1] * len(set(keys))
        assert sum((r["n"].to_pylist() for r in runs), []) == list(range(100))
