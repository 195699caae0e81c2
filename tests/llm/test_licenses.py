import random

import pytest

from tests.llm.cases import documents, edge_texts, nothing, rows, some_texts
from textloom.llm import licenses


def brute(text, templates=licenses.TEMPLATES, threshold=0.8):
    words = licenses.words_of(text or "")
    found = []
    for n, (name, template) in enumerate(templates):
        t = licenses.words_of(template)
        b = set(zip(t, t[1:]))
        best = (0.0, 0)
        for at in range(max(1, len(words) - len(t) + 1)):
            w = words[at : at + len(t)]
            a = set(zip(w, w[1:]))
            if a:
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice > best[0]:
                    best = (dice, at)
        if best[0] >= threshold:
            found.append((-best[0], n, name, best[1]))
    return [(name, -d, at) for d, _, name, at in sorted(found)]


def variants():
    rng = random.Random(4)
    out = []
    for _, template in licenses.TEMPLATES:
        words = template.split()
        for cut in range(4):
            w = list(words)
            for _ in range(cut * max(1, len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(["foo", "the", "of"])
            out.append(" ".join(["pre"] * rng.randint(0, 9) + w + ["post", "and"] * rng.randint(0, 9)))
    return out


def test_scanner_equals_brute_force():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    texts = variants() + some_texts(20) + ["All rights reserved. " * 5, "Released under the MIT License. All rights reserved.", "licensed", ""]
    assert [scanner.scan(t) for t in texts] == [brute(t) for t in texts]
    assert sum(bool(scanner.scan(t)) for t in texts) >= 15


def test_column(spark):
    texts = variants() + edge_texts()
    got = licenses.scan_licenses(documents(spark, texts)).collect()
    want = sorted(((r[0], (brute(r[1]) or [(None,)])[0][0]) for r in rows(texts)), key=repr)
    assert sorted(((r["doc_id"], r["license"]) for r in got), key=repr) == want


def test_empty_table_and_wrong_template(spark):
    assert licenses.scan_licenses(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.Scanner([("x", "word")])
