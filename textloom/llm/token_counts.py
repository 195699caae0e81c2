"""Operator 5: token counts through a digest cache.

The cache is a table (content digest, tokenizer digest, n_tokens), in a folder a
tokenizer, so that only the counts of the tokenizer in use are read.  A content
digest is taken of the normalised text, a tokenizer digest of the tokenizer's
file.  ``count_tokens`` joins the digests to the stored counts, encodes each
distinct missing text once, appends the new counts and returns a count a row.

Nulls count as empty text; empty text has no tokens.  Repeated rows and
repeated or null ids each get their own row of the result.  An empty table gives
an empty result.  Texts are encoded whole, whatever their length.  Other columns
are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import RID, new_path, pick_numbered, spread_join, stored, trimmed, utf8
from textloom.llm.tokenizing import encoder, file_digest, splits_at_white_space

CACHE_SCHEMA = "content_hi long, content_lo long, tokenizer string, n_tokens long"


def normalises(tokenizer_path: str) -> bool:
    """Whether texts that differ only in A-Z case or white-space runs count alike."""
    if not tokenizer_path.endswith(".json"):
        return False
    with open(tokenizer_path, encoding="utf-8") as f:
        return splits_at_white_space(json.load(f))


def normal_form(text: bytes, loose: bool) -> bytes:
    """The content that is digested; texts of one normal form have one count.

    A text with a non-ASCII byte or a ``<`` (special strings) keeps its case.
    """
    if not loose:
        return text
    return b" ".join((text.lower() if text.isascii() and b"<" not in text else text).split())


def digest(text: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(text)
    return _signed(d >> 64), _signed(d & (1 << 64) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@trimmed
def _digests(batches: Iterator[pa.RecordBatch], loose: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [len(t) for t in utf8(batch.column("text"))]
        pairs = [digest(normal_form(t, loose)) for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
            names=["rid", "doc_id", "n_bytes", "content_hi", "content_lo"],
        )


@trimmed
def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = encoder(path).count
    for batch in batches:
        n = [count(t) for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("content_hi"), batch.column("content_lo"), pa.array(n, pa.int64())], names=["content_hi", "content_lo", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    ``cache``: folder of the cache, made where it is missing and added to.
    """
    spark, key = docs.sparkSession, ["content_hi", "content_lo"]
    version = file_digest(tokenizer_path)
    rows = pick_numbered(docs, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    seen = stored(rows.mapInArrow(partial(_digests, loose=normalises(tokenizer_path)), f"rid {RID}, doc_id {id_type}, n_bytes long, content_hi long, content_lo long"), "digests")
    distinct = stored(seen.groupBy(*key).agg(F.min("rid").alias("rid"), F.count("*").alias("n")), "distinct")

    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select(*key, "n_tokens")
    misses = distinct.join(known, key, "left_anti").select("rid", *key)
    texts = rows.select("rid", "text").join(misses, "rid")
    texts.mapInArrow(partial(_counts, path=tokenizer_path), "content_hi long, content_lo long, n_tokens long").select(*key, F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)

    known = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy(*key).agg(F.max("n_tokens").alias("n_tokens"))
    counts = distinct.select(*key, "n").join(known, key)
    total = seen.count()
    return spread_join(seen, counts, key, "n", total, F.xxhash64("rid")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; none where the folder is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def new_cache(spark: SparkSession) -> str:
    return new_path(spark, "token-cache")
