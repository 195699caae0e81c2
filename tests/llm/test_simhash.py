import random

import numpy as np
import pytest
import xxhash

from tests.llm.cases import documents, edge_texts, nothing, rows, some_texts
from textloom.llm import simhash
from textloom.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def classes(ids, roots):
    by = {}
    for i, r in zip(ids, roots, strict=True):
        by.setdefault(r, []).append(-1 if i is None else i)
    return sorted(sorted(v) for v in by.values())


def test_equals_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly box " * 8
    near = [base + w for w in ("", "x", "y z", "x y", "end")]
    texts = some_texts(40) + near + edge_texts()
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    want = [brute_fingerprint(r[1]) for r in rows(texts)]
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64) for r in got) == sorted((str(r[0]), f) for r, f in zip(rows(texts), want, strict=True))
    ids = [r[0] for r in rows(texts)]
    assert classes([r["doc_id"] for r in got], [r["root"] for r in got]) == classes(ids, brute_components(want))
    for r in got:
        own = [x["doc_id"] for x in got if x["root"] == r["root"] and x["doc_id"] is not None]
        assert r["component_id"] == min(own, default=None)


def test_every_pair_within_three_bits_shares_a_list():
    rng = random.Random(1)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        assert any((a ^ b) & simhash._mask(t) % 2**64 == 0 for t in simhash.TRIPLES)


def test_long_lists_are_worked_off_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(5)
    centre = rng.getrandbits(63)
    fps = {centre}
    while len(fps) < 150:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) if rng.random() < 0.9 else rng.getrandbits(62))
    fps = sorted(fps)
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    got = classes(fps, [roots.get(f, f) for f in fps])
    assert got == classes(fps, brute_components(fps))


@pytest.mark.parametrize("at_once", [1 << 18, 50])
def test_tally_finds_the_linked_pairs_of_each_list(monkeypatch, at_once):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    lists, triples, fps = [], [], []
    for k in range(40):
        t = k % len(simhash.TRIPLES)
        mask = np.uint64(simhash._mask(simhash.TRIPLES[t]) % 2**64)
        base = rng.integers(0, 2**63, 3).astype(np.uint64)
        base = (base & ~mask) | (base[0] & mask)
        for f in {int(b) ^ int(rng.integers(0, 2)) << int(p) ^ 1 << int(q) for b in base for p, q in rng.integers(0, 64, (6, 2))}:
            if (f ^ int(base[0])) & int(mask) == 0:
                lists.append(k), triples.append(t), fps.append(f)
    lists, triples, fps = np.array(lists), np.array(triples), np.array(fps, dtype=np.uint64)
    got = {tuple(p) for pairs in simhash.linked_pairs(lists, triples, fps) for p in pairs.T.tolist()}
    n = len(fps)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if lists[i] == lists[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert got == want and len(want) > 50


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**20, 300)).astype(np.uint64)
    a, b = np.array([(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3]).T
    u, v = simhash.forest(a, b, fps)
    assert len(u) < len(fps)
    root = {int(a): int(b) for a, b in zip(u, v, strict=True)}
    want = brute_components([int(f) for f in fps])
    assert len({root.get(int(f), int(f)) for f in fps}) == len(set(want))


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_keep_one_of_each_group(spark, broadcast_bytes):
    docs = documents(spark, ["a b c d e f g"] * 6 + ["another text altogether, quite unlike"] + [None, ""])
    kept = simhash.keep_one(docs, broadcast_bytes=broadcast_bytes).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["0", "6", "7", "None"]
    assert kept[0].asDict().keys() == docs.first().asDict().keys()


def test_empty_table(spark):
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    assert simhash.keep_one(nothing(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 201), (201, 200)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}
