import hashlib
import os

import pytest

import corpus_pipeline
from tests.llm.test_decontamination import ITEM

DATA = "/root/testdata/sf0.001"


def write(spark, path, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    def text(i):
        # words of their own, so that documents are far apart
        return " ".join(hashlib.md5(f"{i}-{k}".encode()).hexdigest()[: 3 + k % 5] + ("." if k % 10 == 9 else "") for k in range(40))

    docs = [(i, text(i) + ("\nThe same last line." if i < 12 else ""), "en", "s", 0) for i in range(30)]
    docs += [(40 + i, text(99), "en", "s", 0) for i in range(4)]
    docs += [(50, f"{text(50)}\n{ITEM}", "en", "s", 0), (51, None, None, None, None), (52, "", "en", "s", 0)]
    write(spark, tmp_path, docs)
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == kept.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(kept.count())
    ids = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert "last line" not in ids[0]
    assert set(ids) & {40, 41, 42, 43} == {40}
    assert 50 not in ids and len({51, 52} & set(ids)) == 1
    assert set(range(30)) <= set(ids)
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == set(ids)


def test_texts_of_ten_copies_are_emptied(spark, tmp_path):
    def text(i):
        return "\n".join(" ".join(hashlib.md5(f"{i}-{j}-{k}".encode()).hexdigest()[: 3 + k % 5] for k in range(20)) + "." for j in range(3))

    docs = [(i, text(i), "en", "s", 0) for i in range(20)]
    docs += [(100 + i, text(100), "en", "s", 0) for i in range(12)] + [(200 + i, text(200), "en", "s", 0) for i in range(9)]
    write(spark, tmp_path, docs)
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cut = corpus_pipeline.line_stage(spark, given, str(tmp_path))
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert {i for i, t in got.items() if not t.strip()} == set(range(100, 112))
    assert all(got[i] == t for i, t, *_ in docs if not 100 <= i < 112)
    cut.write.parquet(f"{tmp_path}/cut")
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{tmp_path}/cut"), str(tmp_path)).collect()}
    assert left == {*range(20), 100, 200}


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_runs_on_the_small_tables(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100
