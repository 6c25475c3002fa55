"""Fingerprints, links and components against plain Python over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from headersieve.llm import simhash
from headersieve.llm.simhash import fingerprint, link_texts, pair_links, spanning_trees


def plain_print(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    width = min(3, len(ws))
    hashes = [xxhash.xxh64(" ".join(ws[i : i + width]).encode(), seed=42).intdigest() for i in range(len(ws) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Component number of each different fingerprint, by all pairs."""
    nodes = sorted(set(prints))
    parent = {p: p for p in nodes}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(nodes):
        for q in nodes[:i]:
            if (p ^ q).bit_count() <= 2:
                a, b = sorted((root(p), root(q)))
                parent[b] = a
    return {p: root(p) for p in nodes}


def brute(rows):
    prints = [plain_print(text) for _, text in rows]
    roots = plain_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(((i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints)), key=str)


def near(draw, centre, bits):
    for b in draw.sample(range(64), bits):
        centre ^= 1 << b
    return centre


def spread(draw, n):
    """Far ones, a crowd around one, and the ends of the range with their neighbours."""
    centre = draw.getrandbits(64)
    crowd = [near(draw, centre, draw.randrange(7)) for _ in range(n)]
    ends = [near(draw, e, draw.randrange(4)) for e in (0, 2**64 - 1, 1 << 63, 2**63 - 1) for _ in range(n // 8)]
    return list({*crowd, *ends, *(draw.getrandbits(64) for _ in range(n))})


def test_trie_walk_finds_every_link(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    monkeypatch.setattr(simhash, "FEW", 2)
    prints = sorted(spread(random.Random(5), 300))
    array = np.array(prints, np.uint64)
    left, right = pair_links(array, [(0, np.array([[0, len(array), 0, len(array), 0]]))])
    got = sorted(tuple(sorted((int(array[a]), int(array[b])))) for a, b in zip(left, right))
    want = [(p, q) for i, q in enumerate(prints) for p in prints[:i] if (p ^ q).bit_count() <= 2]
    assert set(got) == set(want) and len(want) > 100
    a, b = spanning_trees(array, left, right)
    assert len(a) == len({p for w in want for p in w}) - len({r for p, r in plain_components(prints).items() if any(p in w for w in want)})


@pytest.mark.parametrize("leaf", [1, 5, 1 << 16])
def test_components_at_every_leaf_size(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    prints = spread(random.Random(leaf), 150)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print bigint")
    links = simhash.link_prints(table, len(prints)).collect()
    roots = {p % (1 << 64): p % (1 << 64) for r in links for p in (r.a, r.b)}

    def root(p):
        while roots.get(p, p) != p:
            p = roots[p]
        return p

    for r in links:
        a, b = sorted((root(r.a % (1 << 64)), root(r.b % (1 << 64))))
        assert (r.a % (1 << 64)) != (r.b % (1 << 64))
        roots[b] = a
    assert {p: root(p) for p in prints} == plain_components(prints)


def test_query_equals_all_pairs(spark, sf_dir):
    from headersieve.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_simhash"](spark, sf_dir).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60_000)) + " \v\f Ünï code İ"
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "A b"), (5, "a  B"), (4, "a b"), (4, "a b"), (9, "one"), (4, "other words here now"),
            (7, long), (6, long.upper().replace("Ü", "ü")), (None, "only without an id"), (8, long + " x")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, fingerprint string")
    got = link_texts(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert link_texts(docs.limit(0)).count() == 0


def test_fingerprint_of_long_texts_is_summed_in_parts(monkeypatch):
    text = " ".join(f"w{k % 91}" for k in range(1000))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert fingerprint(text.encode()) == plain_print(text)
