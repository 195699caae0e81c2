"""Operator 1: line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, docs) of the 128-bit hashes of line keys: in how many
documents of some batches the key occurs.  It lies in buckets by hash, sorted
within each, so runs meet bucket by bucket in merge joins, without a shuffle.
``ingest`` adds one batch: its keys are merge-anti-joined to those that the runs
already show in enough documents (nothing more need be known of them), and the
others become a new run of level 0.  When a level has ``fanout`` runs, they are
merged into one of the next level.  ``drop_lines`` then takes from each document
the lines whose key the runs show in at least ``min_docs`` documents: where these
keys are few (``FEW_KEYS``, counted) they are sent to the texts, else the lines'
hashes are joined to them, hot keys being salted.

A line's key is the line without white space at its ends, A-Z lower-cased.

Defined cases: null text counts as empty and is one empty line; lines whose key
is shorter than ``min_chars`` stay.  Each row counts as one document, repeated
rows and ids too.  Texts of any length are taken whole.  An empty table gives an
empty result.  ``drop_lines`` keeps the input's columns but those named exactly
like a column that it adds; other spellings stay beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import RID, WHITE, drop_path, new_path, numbered, originals, pick, spread_join, stored, trimmed, utf8

RUN_SCHEMA = "h1 bigint, h2 bigint, docs bigint"
KEY = ["h1", "h2"]
#: Up to so many frequent keys (16 bytes each) are sent to the texts.
FEW_KEYS = 1 << 17
#: With this, Spark trusts that a bucket of one file is sorted.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE.encode()).lower()


def key_digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def _long_enough(key: bytes, min_chars: int) -> bool:
    return bool(key) and (min_chars <= 1 or len(key.decode("utf-8")) >= min_chars)


def _row_keys(min_chars: int):
    """rid, h1, h2 of each distinct key of a row, in slices of bounded size."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, at, digests = batch.column("rid"), [], []
            for i, text in enumerate(utf8(batch.column("text"))):
                keys = {k for k in map(line_key, _lines(text)) if _long_enough(k, min_chars)}
                digests += map(key_digest, keys)
                at += [i] * len(keys)
                if len(at) > 50_000:
                    yield pa.RecordBatch.from_arrays([rid.take(pa.array(at)), *_halves(digests)], names=["rid", *KEY])
                    at, digests = [], []
            if at:
                yield pa.RecordBatch.from_arrays([rid.take(pa.array(at)), *_halves(digests)], names=["rid", *KEY])

    return run


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """rid, h1, h2: a row for each distinct key of a row; ``docs``: rid and text."""
    return docs.select("rid", "text").mapInArrow(_row_keys(min_chars), f"rid {RID}, h1 long, h2 long")


class LineRuns:
    """The store: runs under ``root``/level=L/run=N, found again by their names."""

    def __init__(self, spark: SparkSession, root: str | None = None, min_docs: int = 10, min_chars: int = 1, fanout: int = 2):
        self.spark, self.root = spark, root or new_path(spark, "line-runs")
        self.min_docs, self.min_chars, self.fanout = min_docs, min_chars, fanout

    def runs(self, level: int | None = None) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/level={'*' if level is None else level}/run=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(s.getPath().getParent().toString() for s in found or [])

    @staticmethod
    def _buckets(path: str) -> int:
        return int(path.rpartition("=")[2])

    @staticmethod
    def _name(path: str) -> str:
        return "textloom_run_" + md5(path.rpartition(":")[2].encode()).hexdigest()

    def _run(self, path: str) -> DataFrame:
        by = ", ".join(KEY)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(path)} ({RUN_SCHEMA}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self._buckets(path)} BUCKETS LOCATION '{path}'")
        return self.spark.table(self._name(path))

    def counts(self, level: int | None = None) -> DataFrame:
        """docs by key, over the runs: they are merged two by two."""
        runs = [self._run(path) for path in self.runs(level)]
        return reduce(_merged, runs) if runs else self.spark.createDataFrame([], RUN_SCHEMA)

    def frequent(self) -> DataFrame:
        """The keys found in at least ``min_docs`` documents so far."""
        return self.counts().where(F.col("docs") >= self.min_docs)

    def ingest(self, docs: DataFrame, text_col: str = "text") -> None:
        """One batch of documents."""
        no_rid = F.struct(F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("row"))
        self.ingest_keys(line_keys(pick(docs, text=text_col).withColumn("rid", no_rid), self.min_chars))

    def ingest_keys(self, keys: DataFrame) -> None:
        """One batch's ``line_keys``: anti-join to the runs, a run of its own, compaction."""
        with _sorted_buckets(self.spark):
            self._write(self.news(keys), 0)
            level = 0
            while len(old := self.runs(level)) >= self.fanout:
                self._write(self.counts(level), level + 1)
                for path in old:
                    self._drop(path)
                level += 1

    def news(self, keys: DataFrame) -> DataFrame:
        """What a batch adds: docs by key, without the keys that the runs show in
        enough documents.  The batch is shuffled and sorted once and merged with
        one run after the other, which lie sorted in their buckets."""
        new, known = keys.groupBy(*KEY).agg(F.count("*").alias("docs")), F.lit(0)
        for i, path in enumerate(self.runs()):
            new = _left_merge(new, self._run(path), f"known{i}")
            known = known + F.coalesce(f"known{i}", F.lit(0))
        return new.where(known < self.min_docs).select(*KEY, "docs")

    def _write(self, keys: DataFrame, level: int) -> None:
        made = [int(p.rpartition("run=")[2].partition("-")[0]) for p in self.runs()]
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{self.root}/level={level}/run={1 + max(made, default=-1)}-buckets={buckets}"
        keys.select(*KEY, "docs").write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(self._name(path))

    def _drop(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")
        drop_path(self.spark, path)

    def drop(self) -> None:
        """Deletes the store."""
        for path in self.runs():
            self._drop(path)
        drop_path(self.spark, self.root)


def _beside(run: DataFrame, name: str) -> DataFrame:
    return run.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("docs").alias(name)).hint("merge")


def _same_key() -> Column:
    return (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))


def _left_merge(keys: DataFrame, run: DataFrame, name: str) -> DataFrame:
    return keys.join(_beside(run, name), _same_key(), "left").drop("g1", "g2")


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(_beside(b, "more"), _same_key(), "full")
    none = F.lit(0)
    return both.select(F.coalesce("h1", "g1").alias("h1"), F.coalesce("h2", "g2").alias("h2"), (F.coalesce("docs", none) + F.coalesce("more", none)).alias("docs"))


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SORTED_BUCKETS)
    spark.conf.set(SORTED_BUCKETS, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_BUCKETS, before)


def _cut(text: bytes, gone: set[bytes], min_chars: int) -> tuple[bytes, int, int]:
    lines = _lines(text)
    kept = lines
    if gone:
        keys = list(map(line_key, lines))
        dropped = {k for k in set(keys) if _long_enough(k, min_chars) and key_digest(k) in gone}
        if dropped:
            kept = [x for x, k in zip(lines, keys, strict=True) if k not in dropped]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


STRIPPED = "struct<kept_text: string, n_lines: long, n_dropped: long>"


def _stripped(rows: list[tuple[bytes, int, int]]) -> pa.Array:
    texts, n_lines, n_dropped = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["kept_text", "n_lines", "n_dropped"])


def _strip_all(text: Column, gone: np.ndarray, min_chars: int) -> Column:
    """Strips the lines of few frequent keys, the digests in ``gone``."""
    octets = gone.tobytes()

    @trimmed
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hot = {octets[i : i + 16] for i in range(0, len(octets), 16)}
        for texts in batches:
            yield _stripped([_cut(t, hot, min_chars) for t in utf8(texts)])

    return F.arrow_udf(run, STRIPPED)(text)


def _strip_each(text: Column, gone: Column, min_chars: int) -> Column:
    """Strips from each text the lines of its own list of digests."""

    @trimmed
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            hot = ({np.array([g["h1"], g["h2"]], dtype=">i8").tobytes() for g in x or []} for x in lists.to_pylist())
            yield _stripped([_cut(t, h, min_chars) for t, h in zip(utf8(texts), hot, strict=True)])

    return F.arrow_udf(run, STRIPPED)(text, gone)


def drop_lines(docs: DataFrame, runs: LineRuns, text_col: str = "text", few_keys: int = FEW_KEYS) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped."""
    done, added = _with_stripped(docs, stored(runs.frequent(), "frequent"), runs.min_chars, text_col, few_keys)
    own = [c for c, name in zip(originals(docs), docs.columns, strict=True) if name not in ("kept_text", "n_lines", "n_dropped")]
    return done.select(*own, *(F.col(f"{added}.{c}").alias(c) for c in ("kept_text", "n_lines", "n_dropped")))


def _with_stripped(docs: DataFrame, frequent: DataFrame, min_chars: int, text_col: str, few_keys: int) -> tuple[DataFrame, str]:
    """``docs`` with columns c0, c1, ... and the struct ``r`` of the stripped text."""
    at = docs.columns.index(text_col)
    if frequent.count() <= few_keys:
        hot = frequent.select(*KEY).toArrow()
        gone = np.stack([hot.column(k).to_numpy() for k in KEY], axis=1).astype(">i8")
        plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
        return plain.withColumn("r", _strip_all(F.col(f"c{at}"), gone, min_chars)), "r"
    plain = numbered(docs)
    keys = stored(line_keys(plain.select("rid", F.col(f"c{at}").alias("text")), min_chars).join(frequent.select(*KEY), KEY, "left_semi"), "line-keys")
    seen = keys.groupBy(*KEY).agg(F.count("*").alias("docs"))
    gone = spread_join(keys, seen, KEY, "docs", keys.count(), F.xxhash64("rid")).groupBy("rid").agg(F.collect_list(F.struct(*KEY)).alias("gone"))
    return plain.join(gone, "rid", "left").withColumn("r", _strip_each(F.col(f"c{at}"), F.col("gone"), min_chars)), "r"


def frequent_keys(docs: DataFrame, batches: int = 4, min_docs: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """The frequent keys of ``docs``, taken as ``batches`` deliveries, stored."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs=min_docs, min_chars=min_chars)
    plain = numbered(docs).select("rid", F.col(f"c{docs.columns.index(text_col)}").alias("text"))
    path = new_path(spark, "line-keys")
    keys = line_keys(plain, min_chars).withColumn("batch", F.pmod(F.xxhash64("rid"), F.lit(batches)).cast("int"))
    keys.select(*KEY, "batch").write.mode("append").partitionBy("batch").parquet(path)
    for b in range(batches):
        held = spark.read.schema("h1 long, h2 long, batch int").parquet(path).where(F.col("batch") == b)
        runs.ingest_keys(held)
    found = stored(runs.frequent(), "frequent")
    runs.drop()
    drop_path(spark, path)
    return found


def dedup_lines(docs: DataFrame, batches: int = 4, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", few_keys: int = FEW_KEYS) -> DataFrame:
    """All of ``docs`` as ``batches`` deliveries, then cleaned (see ``drop_lines``)."""
    done, added = _with_stripped(docs, frequent_keys(docs, batches, min_docs, min_chars, text_col), min_chars, text_col, few_keys)
    own = [c for c, name in zip(originals(docs), docs.columns, strict=True) if name not in ("kept_text", "n_lines", "n_dropped")]
    return done.select(*own, *(F.col(f"{added}.{c}").alias(c) for c in ("kept_text", "n_lines", "n_dropped")))


def cut_lines(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", batches: int = 4, min_docs: int = 10, min_chars: int = 1, few_keys: int = FEW_KEYS) -> DataFrame:
    """``docs`` as they were, with the frequent lines cut from the text; the column
    ``chars_col``, where there is one, gets the length of each text that was cut.
    Null texts stay null.  All other columns stay, whatever their names."""
    done, added = _with_stripped(docs, frequent_keys(docs, batches, min_docs, min_chars, text_col), min_chars, text_col, few_keys)
    cut, out = F.col(f"{added}.n_dropped") > 0, originals(docs)
    at = docs.columns.index(text_col)
    out[at] = F.when(cut, F.col(f"{added}.kept_text")).otherwise(F.col(f"c{at}")).alias(text_col)
    if chars_col in docs.columns:
        at = docs.columns.index(chars_col)
        kind = docs.schema[at].dataType
        out[at] = F.when(cut, F.length(f"{added}.kept_text").cast(kind)).otherwise(F.col(f"c{at}")).alias(chars_col)
    return done.select(*out)
