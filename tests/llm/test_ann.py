import math

import numpy as np
import pytest

from textloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, v string, shard int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q, x in good.items():
        if q % every == 0:
            near = sorted((-float(x @ y), i) for i, y in good.items() if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_over_shards(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * rng.choice([0.3, 1.0])).tolist()) for i in range(900)]
    got, want = found(ann.nearest_in(vectors(spark, rows), every=10, k=10, shard=250)), brute(rows, 10, 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    for q in want:
        true = {i: s for i, s in brute(rows, 899, 10)[q]} if q < 20 else dict(want[q])
        for i, s in got[q]:
            assert i not in true or abs(true[i] - s) < 1e-9


def test_copies_ties_and_odd_rows(spark):
    same = [1.0, 2.0, 3.0, 0.5]
    rows = [(i, same) for i in range(60)] + [(100, None), (120, []), (140, [0.0] * 4), (160, [float("nan"), 1.0, 1.0, 1.0]), (180, [None, 1.0, 1.0, 1.0]), (200, [float("inf"), 1.0, 1.0, 1.0]), (None, same), (220, [1.0, 1.0]), (221, [2.0, 1.0]), (0, same), (240, [-1.0, 0.0, 0.0, 0.0])]
    got, want = found(ann.nearest_in(vectors(spark, rows), every=20, k=5, shard=30)), brute(rows, 5, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


@pytest.mark.parametrize("size", [1e25, 1e-30, 1e200, 1e-200, 1.0])
def test_vectors_of_any_size_take_part(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * size).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.nearest_in(table, every=20, k=5, shard=50))
    x = np.array([v for _, v in rows])
    assert sorted(got) == list(range(0, 120, 20))
    for q in got:
        assert len(got[q]) == 5
        if 1e-160 < size < 1e100:  # else products overflow, or vanish
            scores = x @ x[q]
            want = sorted((-scores[i], i) for i in range(120) if i != q)[:5]
            assert [i for i, _ in got[q]] == [i for _, i in want]
            assert np.allclose([s for _, s in got[q]], [-s for s, _ in want], rtol=1e-12, atol=0)


def test_large_and_small_vectors_side_by_side(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * (1e20 if i < 40 else 1.0)).tolist()) for i in range(120)]
    got = found(ann.nearest_in(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=5))
    x = np.array([v for _, v in rows])
    for q in got:
        assert [i for i, _ in got[q]] == sorted((i for i in range(120) if i != q), key=lambda i: (-float(x[i] @ x[q]), i))[:5]


def test_several_vectors_under_one_id(spark):
    rows = [(0, [2.0, 0.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])]
    got = found(ann.nearest_in(vectors(spark, rows), every=20, k=5, shard=2))
    # the query is the least vector of id 0, [1, 5]
    assert got == {0: [(1, 5.0), (2, 3.0)]}


def test_queries_in_several_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ann, "BLOCKS", 2)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 + i % 2).tolist()) for i in range(200)]
    got, want = found(ann.nearest_in(vectors(spark, rows), every=4, k=4, shard=60)), brute(rows, 4, 4)
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.97 * 4 * len(want)


def test_a_batch_may_exceed_a_nodes_room():
    # one node is near all others: its list keeps the nearest
    x = np.vstack([np.ones((1, 8)) * 9, np.random.default_rng(4).normal(size=(3000, 8))])
    g = ann.Graph.build(x)
    links = g.levels[0][1]
    assert (links < len(x)).all() and (links != np.arange(len(x))[:, None]).all()
    for row in links[:50]:
        own = row[row >= 0].tolist()
        assert len(own) == len(set(own)) > 0
    ids, _ = g.search(x[::30], 10)
    true = np.argsort(-(x[::30] @ x.T), axis=1)[:, :10]
    assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 0.97


@pytest.mark.parametrize("n", [1, 2, 3, 70])
def test_small_graphs_are_exact(n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    ids, scores = ann.Graph.build(x).search(x, 5)
    for row, q in zip(ids, x, strict=True):
        want = np.argsort(-(x @ q))[:5]
        assert [i for i in row.tolist() if i >= 0] == want.tolist()


def test_empty_table(spark):
    assert ann.nearest_in(vectors(spark, [(20, [1.0])]).limit(0)).count() == 0
    assert ann.nearest_in(vectors(spark, [(20, [1.0])])).count() == 0
