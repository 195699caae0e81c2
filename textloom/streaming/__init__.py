"""Chunking of streams.

A document's chunks depend on that document alone, so a stream is chunked by the
same column as a table, in append mode, without state or watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.chunkers import TextChunker


def read_documents(spark: SparkSession, path: str, schema: str, file_format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the rows of the files that come into ``path``."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def write_chunks(docs: DataFrame, chunker: TextChunker, path: str, checkpoint: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> StreamingQuery:
    """Chunks of all that there is now, appended to the Parquet table ``path``."""
    chunks = chunker.explode(docs, text, keep)
    return chunks.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
