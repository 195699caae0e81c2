"""Documents from files, tables and Python lists, as (doc_id, text) and more."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_texts(spark: SparkSession, texts: Iterable[str | None]) -> DataFrame:
    """(doc_id, text) of a list, numbered from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def from_table(spark: SparkSession, path: str, text_col: str = "text", file_format: str = "parquet", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the text of a table; no other column is read."""
    return spark.read.format(file_format).load(path).select(*keep, F.col(text_col).alias("text"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file is a document."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
