"""What the operators of this subpackage share.

* ``pick`` takes input columns by exact name and position, so that extra
  columns, even of clashing names, never disturb an operator.
* ``numbered`` gives each row a number that is the same in every job, whatever
  the number of executors or the size of a split.
* ``stored`` cuts lineage by writing a table into the shared folder and
  reading it again: it survives the loss of any executor.
* ``spread_join`` joins rows to a table of unique keys when one key may hold a
  third of the rows.
* ``trimmed`` gives a worker's free memory back when its task ends.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space: \x20 and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A key with more than 1 / HEAVY_SHARE of all rows is heavy; so there are
#: fewer than HEAVY_SHARE heavy keys, whatever the input.
HEAVY_SHARE = 1024
#: A heavy key's rows are dealt over so many sub-keys.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with only the columns ``out=name``; the first of equal names counts."""
    missing = [name for name in columns.values() if name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{df.columns.index(name)}").alias(out) for out, name in columns.items()))


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """Each text of a batch as UTF-8, nulls as empty; one at a time, so that a
    batch isn't held twice."""
    for text in texts.cast(pa.binary()):
        yield text.as_py() or b""


def free_memory() -> None:
    """Gives free memory of this process back to the system: workers live on
    between tasks, and several of them share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def trimmed(run: Callable) -> Callable:
    """``run`` (a generator function over batches), freeing memory at its end."""

    @functools.wraps(run)
    def whole(*args, **options):
        try:
            yield from run(*args, **options)
        finally:
            free_memory()

    return whole


#: Folders written within the innermost ``scratch``.
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, and
    where that is unset, a folder of the warehouse, which they share too."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/textloom"
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path; it goes when the application ends, or before."""
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.mkdirs(where)  # only what exists can be marked
    files.deleteOnExit(where)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that was stored within; its results must be stored
    in a table that was begun outside."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_path(spark, path)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Plans of these nodes alone keep each row of a file one row.
ROWS_OF_FILES = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def _plain_scan(plan: JavaObject) -> bool:
    """Whether a plan is a scan, at most filtered and projected, without chance."""
    if plan.nodeName() not in ROWS_OF_FILES and not plan.nodeName().startswith("Relation"):
        return False
    below = plan.children()
    return plan.deterministic() and below.size() <= 1 and all(_plain_scan(below.apply(i)) for i in range(below.size()))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... and ``rid``, a struct of two longs
    that tells rows apart and is the same in every job.

    For a scan of Parquet files it is the file's hash and the row's place in the
    file, which no change of splits or executors moves.  Anything else is stored
    with the numbers it has then.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    if _plain_scan(df._jdf.queryExecution().analyzed()):
        try:
            return plain.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("rid"))
        except AnalysisException:  # a scan of other files
            pass
    rid = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    return stored(plain.withColumn("rid", rid), "rows")


#: The type of ``rid`` in the schema of a map function.
RID = "struct<file: long, row: long>"


def pick_numbered(df: DataFrame, **columns: str) -> DataFrame:
    """``pick`` with ``rid`` first."""
    missing = [name for name in columns.values() if name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    return numbered(df).select("rid", *(F.col(f"c{df.columns.index(name)}").alias(out) for out, name in columns.items()))


def originals(df: DataFrame) -> list[Column]:
    """The columns of ``numbered(df)`` under their own names again."""
    return [F.col(f"c{i}").alias(name) for i, name in enumerate(df.columns)]


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this code wrote, through Spark's own file system."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def drop_stored(df: DataFrame) -> None:
    """Deletes the table behind a ``stored`` frame that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/textloom-" in path:
            drop_path(df.sparkSession, path)


#: Up to so many bytes of row numbers are broadcast, at ROW_BYTES each.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64


def without_rows(numbered_rows: DataFrame, dropped: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows whose ``rid`` isn't in ``dropped`` (stored, distinct).  Where these are
    few, counted, they are sent to the rows, so that texts don't move; else both are
    shuffled by ``rid``, which is never skewed."""
    few = dropped.count() * ROW_BYTES <= broadcast_bytes
    return numbered_rows.join(F.broadcast(dropped) if few else dropped, "rid", "left_anti")


def hash_row(share: float, *columns: str) -> Column:
    """Whether a row is in a sample of ``share`` that is the same in every attempt."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < int(share * (1 << 40)) + (share >= 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def spread_join(rows: DataFrame, unique: DataFrame, on: list[str], count: str, total: int, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``unique`` (one row a key, with the key's row count in
    ``count``), no task getting more than a share of a heavy key.

    Heavy keys (more than total / HEAVY_SHARE rows, so fewer than HEAVY_SHARE of
    them) are salted: their rows by ``salt``, a hash that is the same in every
    attempt, and their one row of ``unique`` is repeated SALTS times.
    """
    limit = max(1, total // HEAVY_SHARE)
    heavy = unique.where(F.col(count) > limit).select(*on, F.lit(True).alias("__heavy"))
    marked = rows.join(F.broadcast(heavy), on, "left")
    salted = marked.withColumn("__salt", F.when(F.col("__heavy"), F.pmod(salt, F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("__heavy")
    dealt = unique.withColumn("__salt", F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(dealt, [*on, "__salt"], how).drop("__salt")
