"""Small documents with what operators must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, score double, fp long, n_lines long, c0 string"


def some_texts(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "epsilon.", "ZETA", "eta", "thêta", "iota", "kappa;", "lambda", "mu"]
    texts = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "  Shared LINE here\t")
        texts.append("\n".join(lines))
    return texts


def edge_texts():
    return [None, "", " \n\t", "one", "two words", "\n\n", "é" * 10, "ab " * 20000, "same text twice", "same text twice", "x\ny\nx"]


def rows(texts):
    out = [(i, t, "en", "s", None if t is None else len(t), 7, 0.5, 3, 9, "c") for i, t in enumerate(texts)]
    return out + [out[-1], (None, "null id here", None, None, None, None, None, None, None, None)]


def documents(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
