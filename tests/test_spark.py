import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom import TextChunker, queries, sources, streaming

DATA = "/root/testdata/sf0.001"
TEXTS = [None, "", "Some text\n\nfrom a\ndocument", "é" * 25, "one\ntwo"]


@pytest.fixture(scope="module")
def docs(spark):
    return sources.from_texts(spark, TEXTS)


def test_column_and_explode(spark, docs):
    chunker = TextChunker(10)
    rows = {r["doc_id"]: r["c"] for r in docs.select("doc_id", chunker.column("text").alias("c")).collect()}
    assert rows[0] is None and rows[1] == []
    assert [[tuple(c) for c in rows[i]] for i in (2, 3, 4)] == [[tuple(c) for c in chunker.iterate(t)] for t in TEXTS[2:]]
    flat = chunker.explode(docs).collect()
    assert len(flat) == 7 and flat[0].asDict().keys() == {"doc_id", "chunk_index", "byte_offset", "char_offset", "chunk"}
    assert [r["c"] for r in docs.select(chunker.strings("text").alias("c")).collect()] == [None, *chunker.chunk_all(TEXTS[1:])]
    assert chunker.explode(docs, max_chunks=1).count() == 3


def test_table_function(spark, docs):
    TextChunker(10).register(spark, "cut_text")
    docs.createOrReplaceTempView("d")
    assert spark.sql("SELECT doc_id, c.chunk FROM d, LATERAL cut_text(text) c").count() == 7


def test_plan_is_narrow_and_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b", "en", "unused")], "doc_id long, text string, lang string, other string").write.parquet(path)
    plan = TextChunker(10).explode(spark.read.parquet(path).where("lang = 'en'"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(lang,en)" in plan and "other" not in plan
    # each document is cut once
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_callback_error_fails_the_query(spark, docs):
    def bad(text):
        raise RuntimeError("no size")

    chunker = TextChunker(10).with_config(sizer=queries.TextChunker(5).config.with_sizer(type("S", (), {"size": lambda self, t: bad(t)})()).sizer)
    with pytest.raises(Exception, match="no size"):
        chunker.explode(docs).count()


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    sources.from_texts(spark, TEXTS * 5).repartition(4).write.parquet(source)
    stream = streaming.read_documents(spark, source, "doc_id long, text string", files_per_trigger=2)
    streaming.write_chunks(stream, TextChunker(10), out, str(tmp_path / "state")).awaitTermination()
    want = TextChunker(10).explode(spark.read.parquet(source))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert [r["text"] for r in sources.from_files(spark, str(tmp_path / "*.txt")).collect()] == ["one\ntwo"]
    spark.createDataFrame([(1, "x", 2)], "doc_id long, body string, z int").write.json(str(tmp_path / "t"))
    assert sources.from_table(spark, str(tmp_path / "t"), "body", "json").columns == ["doc_id", "text"]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.project(", ".join(names)).fetchall(), key=repr)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def pack_lines(text, size):
    """Lines of words packed greedily; of a line that doesn't fit as many words as do."""
    chunks, lines = [], text.split("\n")
    while lines:
        if len(lines[0]) <= size:
            n = max(k for k in range(1, len(lines) + 1) if len("\n".join(lines[:k])) <= size)
            chunks.append("\n".join(lines[:n]))
            lines = lines[n:]
        else:
            words = lines[0].split(" ")
            n = max(k for k in range(1, len(words) + 1) if len(" ".join(words[:k])) <= size)
            chunks.append(" ".join(words[:n]))
            lines[0] = " ".join(words[n:])
    return chunks


def test_lines_beyond_the_capacity_are_packed_too(spark, tmp_path):
    rng = random.Random(6)

    def line(n):
        return " ".join("".join(rng.choices("abcdé", k=rng.randint(2, 9))) for _ in range(n))

    texts = ["\n".join(line(rng.choice([3, 20, 60, 70, 150, 400])) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    assert sum(max(map(len, t.split("\n"))) > queries.LINES for t in texts) > 30
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.QUERIES["line_packing_all"](spark, str(tmp_path)).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {i: pack_lines(t, queries.LINES) for i, t in enumerate(texts)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert queries.QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


def test_native_functions(spark):
    from textloom.operators import native

    text = "\n\n  a \r\n  b 　"
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(native.trim_all(F.col("t")), native.trim_indentation(F.col("t")), native.size_words(F.col("t")), native.is_white(F.col("t")), native.newline_runs(F.col("t")), native.graphemes(F.lit("éa")), native.characters(F.lit("ab")), native.run_level(F.lit("\r\n\n"))).first()
    assert tuple(row) == ("a \r\n  b", "  a \r\n  b", 2, False, ["\n\n", "\r\n"], ["é", "a"], ["a", "b"], 2)
