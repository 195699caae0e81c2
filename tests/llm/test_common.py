"""Row numbers, stored tables and the operators on a cluster whose size changes."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tests.llm.cases import some_texts
from tests.llm.test_decontamination import ITEM
from textloom.llm import common, decontamination, line_dedup, simhash, token_counts

#: Splits of files follow these.
SPLITS = {"spark.sql.files.openCostInBytes": "100", "spark.sql.files.maxPartitionBytes": "4k"}


@pytest.fixture
def files(spark, tmp_path):
    texts = [f"{t} number {i}\nthe line of all" for i, t in enumerate(some_texts(200))]
    texts[7] += " " + ITEM
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).write.option("parquet.block.size", 2048).parquet(f"{tmp_path}/docs")
    return f"{tmp_path}/docs"


def replanned(spark, monkeypatch, run):
    """The rows of ``run``, each of whose stored steps is planned for another number of cores."""
    steps = []
    stored = common.stored

    def other(*args, **options):
        steps.append(0)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(2 if len(steps) % 2 else 11))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9k" if len(steps) % 2 else "3k")
        return stored(*args, **options)

    for name, value in SPLITS.items():
        spark.conf.set(name, value)
    try:
        for module in (line_dedup, simhash, token_counts, decontamination):
            monkeypatch.setattr(module, "stored", other)
        return sorted(map(tuple, run().collect()), key=repr)
    finally:
        for name in [*SPLITS, "spark.sql.leafNodeDefaultParallelism"]:
            spark.conf.unset(name)
        monkeypatch.undo()


OPERATORS = {
    "lines": lambda docs, items: line_dedup.cut_lines(docs, few_keys=0),
    "counts": lambda docs, items: token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), token_counts.new_cache(docs.sparkSession)),
    "near": lambda docs, items: simhash.keep_one(docs),
    "leaks": lambda docs, items: decontamination.drop_contaminated(docs, items),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_the_same_when_the_cluster_changes_between_jobs(spark, files, monkeypatch, name):
    items = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    docs = spark.read.parquet(files)
    want = sorted(map(tuple, OPERATORS[name](docs, items).collect()), key=repr)
    assert len(want) >= 199
    assert replanned(spark, monkeypatch, lambda: OPERATORS[name](spark.read.parquet(files), items)) == want


def test_numbers_of_a_scan_need_no_copy(spark, files):
    docs = spark.read.parquet(files)
    plan = common.numbered(docs.where("doc_id > 3"))._jdf.queryExecution().executedPlan().toString()
    assert "row_index" in plan and "textloom-rows" not in plan
    rows = common.numbered(docs)
    assert rows.select("rid").distinct().count() == 200


@pytest.mark.parametrize("make", [lambda d: d.repartition(3), lambda d: d.union(d), lambda d: d.where(F.rand(3) < 0.5), lambda d: d.withColumn("_metadata", F.lit(1)), lambda d: d.join(d.select("doc_id"), "doc_id"), lambda d: d.select("doc_id", F.explode(F.split("text", " ")))])
def test_numbers_of_other_frames_are_stored(spark, files, make):
    rows = common.numbered(make(spark.read.parquet(files)))
    assert "textloom-rows" in rows._jdf.queryExecution().executedPlan().toString() or "row_index" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.select("rid").distinct().count() == rows.count() > 0
    assert rows.select("rid").exceptAll(rows.select("rid")).count() == 0


def test_scratch_deletes_what_was_stored_within(spark):
    with common.scratch(spark):
        inside = common.stored(spark.range(3), "inside").inputFiles()[0]
    outside = common.stored(spark.range(3), "outside")
    assert outside.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(inside)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
