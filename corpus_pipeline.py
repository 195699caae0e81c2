"""The corpus pipeline: ``documents`` in, packed training sequences out.

Each stage works on all that the one before kept, written as Parquet and read
again.  All but the last return the columns of ``documents``:

1. quality classifier: documents that the weakly supervised scorer rejects go;
2. line dedup: lines found in ten documents or more go from every document, and
   n_chars follows;
3. SimHash near-dedup: of each group the document of smallest id stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. packing: the pieces of the packed sequences.

Null texts count as empty in every stage and stay null where nothing is cut from
them; very long texts are taken whole.  Repeated rows and repeated or null ids are
rows of their own in every stage: each counts as a document for the lines, and near
duplicates of one id leave its first row.  Of equal texts that of the smallest id
stays.  Extra columns stay as they are, whatever their names, those like a column
that an operator adds included.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, line_dedup, packing, quality, simhash
from textloom.llm.common import drop_path, new_path, scratch, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.cut_lines(docs, "text", "n_chars", min_docs=10, min_chars=1)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The first and the last stage learn and pack, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; what a stage stored for itself, and
    its input, go when its result is stored."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
