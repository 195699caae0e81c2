import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import documents, edge_texts, nothing, rows, some_texts
from textloom.llm import decontamination


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(ws):
    if len(ws) < 5:
        return {" ".join(ws)} if ws else set()
    return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(docs, items):
    out = []
    for doc, text in docs:
        for item, passage in items:
            s, d = shingles(words(passage)), shingles(words(text))
            if s and len(s & d) / len(s) >= 0.8 - 1e-9:
                out.append((doc, item, len(s), len(s & d)))
    return sorted(out, key=repr)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_equals_brute_force(spark):
    cut = " ".join(ITEM.split()[:12])
    changed = ITEM.replace("fourteen", "fifteen")
    texts = [*some_texts(30), f"before. {ITEM.upper()}! after", "pre " * 3000 + ITEM, cut, changed, ITEM.replace("seven", "sieben"), "two words", *edge_texts()]
    items = [(0, ITEM), (1, None), (2, ""), (3, "Two, words"), (4, some_texts(30)[4]), (4, some_texts(30)[4]), (5, "no such passage is in any of the texts at all"), (None, ITEM)]
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, item long, s int")
    got = decontamination.contaminated(documents(spark, texts), bench).collect()
    want = brute([(r[0], r[1]) for r in rows(texts)], items)
    assert sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got), key=repr) == want
    assert len(want) > 6


def test_shuffled_sketches_find_the_same(spark, request):
    docs = documents(spark, [*some_texts(20), f"x {ITEM} y"])
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*some_texts(5), ITEM, "one"])], "item_id long, text string")
    want = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    found = decontamination.contaminated(docs, bench, broadcast_bytes=0)
    assert "BroadcastExchange" not in found._jdf.queryExecution().toString()
    # row numbers of a table that isn't a file are those of its stored copy
    assert sorted((tuple(r)[1:] for r in found.collect()), key=repr) == sorted((w[1:] for w in want), key=repr)


def test_a_document_reaches_the_partitions_that_it_can_hold(spark):
    for n_item in (1, 2, 3, 4, 7, 8, 9, 31, 32, 33, 1000):
        least = -(-8 * n_item // 10) + decontamination.WORDS - 1  # words of a text that holds just enough
        got = spark.range(1).select(decontamination.reach(F.lit(least), 0.8).alias("r")).first()["r"]
        assert got >= int(np.log2(n_item))
    items = spark.createDataFrame([(0, ITEM), (1, "a b c d e f"), (2, None)], "item_id long, text string")
    index = decontamination.sketched_items(items, 0.8, "item_id", "text")
    found = index.select("part", F.explode("sketch").alias("h"))
    bound = decontamination.bounds(found)
    assert bound == sorted(bound) and bound[0] == -(1 << 63) and bound[-1] == max(r["h"] for r in found.collect())


def test_clean_documents_stay(spark):
    texts = [*some_texts(10), f"x {ITEM} y", None, ""]
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    kept = decontamination.drop_contaminated(documents(spark, texts), bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows(texts) if r[0] != 10)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    assert decontamination.contaminated(nothing(spark), bench).count() == 0
    assert decontamination.contaminated(documents(spark, some_texts(5)), bench.limit(0)).count() == 0
