import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, edge_texts, nothing, rows, some_texts
from textloom.llm import line_dedup
from textloom.llm.common import numbered

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))


def brute(texts, least):
    lines = [(t or "").split("\n") for t in texts]
    seen = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    out = []
    for ls in lines:
        kept = [x for x in ls if not key(x) or seen[key(x)] < least]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("few_keys", [line_dedup.FEW_KEYS, 0])
def test_equals_brute_force(spark, few_keys):
    texts = some_texts() + edge_texts()
    docs = documents(spark, texts)
    got = line_dedup.dedup_lines(docs, batches=3, min_docs=4, few_keys=few_keys).collect()
    want = [(r[0], *b) for r, b in zip(rows(texts), brute([r[1] for r in rows(texts)], 4), strict=True)]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got), key=repr) == sorted(want, key=repr)
    assert {"lang", "rid", "c0"} <= set(got[0].asDict())


def test_runs_are_levelled_and_compacted(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    docs = documents(spark, some_texts(40))
    for k in range(4):
        runs.ingest(docs.where(F.col("doc_id") % 4 == k))
    assert [p.rpartition("level=")[2].split("/")[0] for p in runs.runs()] == ["2"]
    again = line_dedup.LineRuns(spark, root=runs.root, min_docs=3)
    assert again.frequent().count() == runs.frequent().count() > 0


def test_runs_are_merged_without_shuffle_or_sort(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=9)
    for k in range(3):
        runs.ingest(documents(spark, some_texts(20, seed=k)))
    keys = line_dedup.line_keys(numbered(documents(spark, some_texts(20))).select("rid", F.col("c1").alias("text")))
    with line_dedup._sorted_buckets(spark):
        news = runs.news(keys)._jdf.queryExecution().executedPlan().toString()
        two = line_dedup._merged(*(runs._run(p) for p in runs.runs()[:2]))._jdf.queryExecution().executedPlan().toString()
    # the batch's own keys move once, and are sorted once; the runs not at all
    assert news.count("SortMergeJoin") == 3 and news.count("Exchange ") == 1 and news.count("Sort [") == 1
    assert two.count("SortMergeJoin") == 1 and "Exchange" not in two and "Sort [" not in two


def test_clashing_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(i, "same line\nown " + str(i), 777, 9, "k", "t", 3) for i in range(4)], "doc_id long, text string, n_lines int, n_chars int, kept_text string, TEXT string, rid int")
    got = line_dedup.cut_lines(docs, min_docs=3).orderBy("doc_id")
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert [tuple(r) for r in got.collect()] == [(i, f"own {i}", 777, 5, "k", "t", 3) for i in range(4)]


def test_known_keys_are_not_added_again(spark):
    docs = documents(spark, ["hot"] * 5)
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=9)
    runs.ingest(docs)
    runs.ingest(docs)
    assert runs.counts().where("docs > 6").count() == 0


def test_empty_table(spark):
    assert line_dedup.dedup_lines(nothing(spark)).count() == 0


def test_empty_text_is_one_empty_line(spark):
    r = line_dedup.dedup_lines(documents(spark, [None]), min_docs=1).where("doc_id = 0").first()
    assert (r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) == (1, 0, hashlib.sha256(b"").hexdigest())
