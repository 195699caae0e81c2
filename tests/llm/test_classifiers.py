import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import documents, edge_texts, nothing, rows, some_texts
from textloom.llm import quality, toxicity


def prose(rng, n=60):
    words = ["The", "of", "harbour", "was", "quiet", "and", "a", "boat", "lay", "in", "the", "morning", "light", "while", "gulls", "cried", "over", "it"]
    out = []
    for i in range(n):
        out.append(rng.choice(words) + ("." if i % 9 == 8 else ""))
    return " ".join(out) + "."


def junk(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w for w in ["buy", "now", "cheap", "pills"] for _ in range(25))
    if kind == 1:
        return " | ".join(rng.choice(["home", "about", "login", "contact", "search"]) for _ in range(60))
    return " ".join(rng.choice(["abc", "def", "ghi"]) + rng.choice(["###", "$$$", "%%%"]) for _ in range(80))


def test_quality_on_held_out_truth(spark):
    rng = random.Random(1)
    truth = [i % 5 != 0 for i in range(400)]
    docs = spark.createDataFrame([(i, prose(rng) if good else junk(rng), 1.0) for i, good in enumerate(truth)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in quality.classify(docs).collect()}
    assert all(got[i]["predicted"] == 1 for i, good in enumerate(truth) if good)
    assert sum(got[i]["predicted"] == 0 for i, good in enumerate(truth) if not good) >= 0.9 * truth.count(False)


def test_quality_edges(spark):
    texts = some_texts(20) + edge_texts()
    docs = documents(spark, texts)
    got = quality.classify(docs)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(rows(texts))
    assert {r["predicted"] for r in got.where("doc_id = 20 or doc_id = 21").collect()} == {1}
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.classify(nothing(spark)).count() == 0 and quality.keep_good(nothing(spark)).count() == 0


def test_quality_of_short_texts(spark):
    rng = random.Random(4)
    texts = [prose(rng) if i % 5 else junk(rng) for i in range(400)]
    texts += [prose(rng, 4) for _ in range(20)] + ["That*** atly.###", "home | login | contact |", "abc### def$$$ ghi%%%", "", " \n", None]
    got = {r["doc_id"]: r for r in quality.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i]["predicted"] == 1 for i in range(400, 420))
    assert [got[i]["predicted"] for i in range(420, 426)] == [0, 0, 0, 1, 1, 1]
    votes = quality.votes(b"home | login | contact |")
    assert votes[3] == quality.JUNK and all(votes[k] == quality.ABSTAIN for k in (1, 4, 5, 6, 7))


def test_quality_sample_keeps_the_share_of_copies(spark, monkeypatch):
    rng = random.Random(7)
    texts = [prose(rng) if i % 5 else junk(rng) for i in range(800)]
    sizes, hot = [], []
    fit_scorer = quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda x, y: sizes.append(len(x)) or hot.append(int((x == copy).all(1).sum())) or fit_scorer(x, y))
    for k in range(6):
        text = prose(rng)
        copy = quality.features(text.encode())
        docs = spark.createDataFrame(list(enumerate(texts + [text] * 800)), "doc_id long, text string")
        quality.fit(docs.union(docs.limit(50)), sample=200)
    assert all(120 < n < 280 for n in sizes), sizes
    assert all(0.3 < h / n < 0.7 for h, n in zip(hot, sizes, strict=True)), (hot, sizes)


def test_label_model_finds_each_kind_of_junk():
    g, j, a = quality.GOOD, quality.JUNK, quality.ABSTAIN
    patterns = np.array([[g, g, g], [j, g, g], [g, j, g], [g, g, j], [a, a, a]])
    q = quality.fit_label_model(patterns, np.array([900.0, 40, 40, 40, 10]))
    assert q[0] > 0.8 and (q[1:4] < 0.5).all() and q[4] > 0.5


def test_toxicity_on_the_held_out_fold(spark):
    rng = random.Random(2)
    bad = ["vileword", "nastyterm", "gruffen", "gruffig", "grufflich"]
    texts, labels = [], []
    for i in range(600):
        words = prose(rng, 40).split()
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([(i, t, 9.0, "z") for i, t in enumerate(texts)], "doc_id long, text string, score double, toxic string")
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    # labels of the held-out fold are wrong, and must not matter
    given = [(i, 1 - t if i in set(held) else t, 1) for i, t in labels] + [(5, None, 1), (7, 9, 1), (None, 1, 1)]
    got = {r["doc_id"]: r for r in toxicity.classify(docs, spark.createDataFrame(given, "doc_id long, toxic int, quality int")).collect()}
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_by_how_densely_a_family_occurs(spark):
    rng = random.Random(5)
    family = [f"ächlich{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts, labels = [], []
    for i in range(1000):
        toxic = i % 4 == 0
        words = prose(rng, 60).split()
        for _ in range(rng.randint(4, 7) if toxic else rng.random() < 0.2):
            words.insert(rng.randrange(len(words)), rng.choice(family))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert len(got) > 100 and all(r["predicted"] == labels[r["doc_id"]][1] for r in got)


def test_a_row_counts_by_its_mass():
    x, y = np.eye(3, dtype=np.float32), np.array([0.1, 0.9, 0.5])
    again = [0, 0, 1, 2, 2, 2]
    assert np.allclose(quality.fit_scorer(x, y, mass=np.array([2.0, 1, 3])), quality.fit_scorer(x[again], y[again]), atol=1e-3)


def test_toxicity_edges(spark):
    docs = documents(spark, some_texts(20) + edge_texts())
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels).count() == docs.count()
    none = toxicity.classify(docs, labels.limit(0))
    assert none.where(F.col("score") != 0).count() == 0
    assert toxicity.classify(nothing(spark), labels).count() == 0


def test_correlated_voters_count_for_less():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    one = np.where(y, rng.random(2000) < 0.7, rng.random(2000) < 0.01)
    votes = np.stack([one, one, one, np.where(y, rng.random(2000) < 0.7, rng.random(2000) < 0.01)], axis=1).astype(float)
    q = toxicity.label_model(votes, y.astype(int))
    assert ((q > 0.5) == votes.any(axis=1)).mean() > 0.95
