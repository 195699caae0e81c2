"""Queries with SQL over documents without text, with blank lines and with white space at lines' ends."""

import duckdb
import pytest

from textloom import queries

TEXTS = [
    None,
    "",
    " ",
    "\n",
    "\n\n\n",
    "a line\nand another",
    " indented\n\ttabbed\nends with one \n",
    "a" * 500 + "\n\n" + "b" * 500,
    "a" * 499 + "\n\n\n" + "b" * 480 + "\n" + "c" * 30,
    "x" * 501,
    "é" * 300 + "\r\n" + "ü" * 300,
    "one　\n two\n" + "w " * 200,
    "a" * 100 + "\n" + "b" * 501 + "\n",
]


@pytest.mark.parametrize("name", ["offset_check", "line_packing", "reassemble_untrimmed", "fixed_windows", "fixed_windows_overlap"])
def test_query_equals_sql_on_odd_documents(spark, tmp_path, name):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path))
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.project(", ".join(names)).fetchall(), key=repr)


def test_offsets_that_are_wrong_are_told():
    from textloom.operators.chunkers import Chunk, _all_there

    text = "é one two"
    assert _all_there(text, [Chunk(0, 0, 0, "é one"), Chunk(1, 3, 2, "one two")])
    assert not _all_there(text, [Chunk(0, 2, 2, "one")])
    assert not _all_there(text, [Chunk(0, 3, 2, "two")])
    assert not _all_there(text, [Chunk(0, 7, 6, "two"), Chunk(1, 2, 2, "one")])
