"""Operator 6: benchmark decontamination by MinHash containment search.

Which documents hold a benchmark item, that is at least ``threshold`` of its
distinct five-word shingles?  Words are the runs of letters and digits,
lower-cased; a shingle is five words joined by spaces.

Items are partitioned by size: partition p has those of 2^p to 2^(p+1) - 1
distinct shingles.  An item of n shingles that is contained misses at most
floor((1 - t) n) of them, so a document that contains it holds one of its
floor((1 - t) n) + 1 shingles of smallest hash: its MinHash sketch, whose size
goes with the partition.  A document is searched partition by partition: only
those whose smallest items its own words can hold (its reach), and there only by
shingle hashes up to the largest in the partition's sketches (the partition's
bound).  What it finds in the sketches are candidates, verified by exact shingle
containment, on strings.  So nothing is missed, and hash collisions cost only a
verification.

All of it is DataFrame operations.  Sketches, and the shingles of the items that
are verified, are broadcast where they have at most ``BROADCAST_BYTES`` (summed
before); beyond, both sides are shuffled, salted, and without texts: these are
joined again to the candidates alone.

Defined cases: null or empty texts have no words and match nothing.  An item of
one to four words is one shingle, found only in a document of those same words
alone.  Repeated rows and repeated or null ids each count for themselves; equal
(document row, item row) pairs give a row each.  Texts of any length are searched
whole; ties can't arise.  Empty tables give an empty result.  Extra columns are
ignored, and stay in ``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_BYTES, SALTS, numbered, originals, pick_numbered, stored, without_rows

WORDS = 5
THRESHOLD = 0.8
#: Size partitions: an item has fewer than 2 ** 31 shingles.
PARTS = 31


def words(text: Column) -> Column:
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(split, lambda w: w != "")


def shingles(ws: Column) -> Column:
    """The distinct shingles of an array of words; fewer words are one shingle."""
    n = F.size(ws)
    many = F.transform(F.sequence(F.lit(1), n - (WORDS - 1)), lambda i: F.array_join(F.slice(ws, i, WORDS), " "))
    one = F.when(n > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(n >= WORDS, many).otherwise(one))


def sketched_items(items: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """item row, item_id, distinct shingles, their number, size partition, sketch."""
    rows = pick_numbered(items, item_id=id_col, text=text_col).withColumnRenamed("rid", "item")
    rows = rows.withColumn("ws", words(F.col("text"))).withColumn("s", shingles(F.col("ws"))).where(F.size("s") > 0)
    n = F.size("s")
    most = F.floor(n * F.lit(1 - threshold) + F.lit(1e-9)).cast("int") + 1
    hashes = F.array_sort(F.transform("s", lambda s: F.xxhash64(s)))
    return rows.select("item", "item_id", "s", n.alias("n_item"), F.floor(F.log2(n.cast("double"))).cast("int").alias("part"), (F.size("ws") < WORDS).alias("short"), F.slice(hashes, F.lit(1), most).alias("sketch"))


def reach(n_words: Column, threshold: float) -> Column:
    """The last size partition of which a text of so many words can hold an item:
    it has at most n_words - 4 shingles, of which ``threshold`` n must be the item's."""
    most = F.greatest((n_words - (WORDS - 1)) / F.lit(threshold) + F.lit(1e-6), F.lit(1.0))
    return F.least(F.floor(F.log2(most)), F.lit(PARTS - 1)).cast("int")


def bounds(sketches: DataFrame) -> list[int]:
    """For each reach, the largest hash in the sketches of the partitions within it;
    the smallest long where there are none."""
    found = {r["part"]: r["h"] for r in sketches.groupBy("part").agg(F.max("h").alias("h")).collect()}  # PARTS rows at most
    out = [-(1 << 63)]
    for p in range(PARTS):
        out.append(max(out[-1], found.get(p, out[-1])))
    return out[1:]


def _probes(docs: DataFrame, bound: list[int], threshold: float) -> DataFrame:
    """A row a shingle of the documents of five words and more, up to the bound of
    their reach: its hash.

    The five shifted word arrays are zipped and inlined, so a shingle is hashed
    in generated code without an array of its own.
    """
    n = F.size("ws")
    shifted = F.arrays_zip(*(F.slice("ws", F.lit(k + 1), F.greatest(n - (WORDS - 1), F.lit(0))).alias(f"w{k}") for k in range(WORDS)))
    most = F.element_at(F.array(*(F.lit(b) for b in bound)), reach(F.col("n_words"), threshold) + 1)
    sized = docs.select("rid", "ws", n.alias("n_words")).withColumn("most", most)
    out = sized.select("rid", "n_words", "most", F.inline(shifted).alias(*(f"w{k}" for k in range(WORDS))))
    hashed = out.select("rid", reach(F.col("n_words"), threshold).alias("reach"), "most", F.xxhash64(F.concat_ws(" ", *(f"w{k}" for k in range(WORDS)))).alias("h"))
    return hashed.where(F.col("h") <= F.col("most")).select("rid", "reach", "h")


def _brief_pairs(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of a document and an item of fewer than five words."""
    alone = docs.where(F.size("ws").between(1, WORDS - 1)).withColumn("h", F.xxhash64(F.array_join("ws", " ")))
    return alone.join(sketches, "h").select("rid", "item")


def _salted(df: DataFrame, salt: Column) -> DataFrame:
    return df.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int"))


def _each_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rid (document row), doc_id, item_id, n_item, n_shared, containment."""
    return _contaminated(numbered(docs), docs.columns.index(id_col), docs.columns.index(text_col), items, threshold, item_id_col, item_text_col, broadcast_bytes)


def _contaminated(plain: DataFrame, id_at: int, text_at: int, items: DataFrame, threshold: float, item_id_col: str, item_text_col: str, broadcast_bytes: int) -> DataFrame:
    index = stored(sketched_items(items, threshold, item_id_col, item_text_col), "sketches")
    strings = F.aggregate("s", F.lit(0).cast("long"), lambda total, s: total + F.octet_length(s) + 40)
    size = index.agg(F.sum(F.size("sketch") * F.lit(64)).alias("sketches"), F.sum(strings).alias("shingles"), F.count_if("short").alias("short")).first()
    small = (size["sketches"] or 0) <= broadcast_bytes

    rows = plain.select("rid", F.col(f"c{id_at}").alias("doc_id"), F.col(f"c{text_at}").alias("text"))
    split = rows.withColumn("ws", words(F.col("text")))
    sketches = index.select("item", "part", "n_item", "short", F.explode("sketch").alias("h"))
    long = sketches.where(~F.col("short")).select("item", "part", "h")
    probes = _probes(split, bounds(long), threshold)
    brief = sketches.where("short").select("item", "h")
    if small:
        found = probes.join(F.broadcast(long), "h")
    else:
        found = _salted(probes, F.xxhash64("rid")).join(_each_salt(long), ["h", "salt"])
    pairs = found.where(F.col("part") <= F.col("reach")).select("rid", "item")
    if size["short"]:
        pairs = pairs.union(_brief_pairs(split, F.broadcast(brief) if small else brief))
    pairs = stored(pairs.distinct(), "candidates")

    # the texts of the candidates alone; a pair is some 100 bytes where broadcast
    some = F.broadcast(pairs) if pairs.count() * 100 <= broadcast_bytes else pairs
    texts = rows.join(some, "rid")
    shingled = index.select("item", "item_id", "s", "n_item")
    if (size["shingles"] or 0) <= broadcast_bytes:
        both = texts.join(F.broadcast(shingled), "item")
    else:
        both = _salted(texts, F.xxhash64("rid")).join(_each_salt(shingled), ["item", "salt"])
    # bound by a lambda, so that the text is split into words once
    held = F.transform(F.array(words(F.col("text"))), shingles)[0]
    shared = F.size(F.array_intersect(F.col("s"), held))
    checked = both.select("rid", "doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    return checked.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold - 1e-9)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    plain = numbered(docs)
    bad = _contaminated(plain, docs.columns.index(id_col), docs.columns.index(text_col), items, threshold, item_id_col, item_text_col, broadcast_bytes)
    bad = stored(bad.select("rid").distinct(), "contaminated")
    return without_rows(plain, bad, broadcast_bytes).select(*originals(docs))
