"""Operator 4: SimHash near-duplicates by a byte-position inverted index.

A fingerprint is eight positional bytes.  Two fingerprints at 3 or fewer bits
differ in at most three bytes, so at least five positional bytes are shared: the
guaranteed number of matches.  The index lists fingerprints under triples of
positional bytes, chosen so that any five bytes hold one of the triples (all
triples of the first four bytes and all of the last four).  Single bytes would
have lists of a 256th of all fingerprints, so pairs in number quadratic; a triple
starts the count at three.  Within a list the other positional bytes have postings
of their own; the postings that a pair shares are tallied, pairs under five are
dropped and the others verified bit by bit.  Only a spanning forest of the links
is given out, which keeps the components; lists of more than ``BLOCK`` are worked
off in pairs of blocks, so memory is bounded and no link is lost.

Exact copies share a fingerprint and take one place in the index.

Defined cases: null text counts as empty; texts without words have fingerprint
zero and are linked like any other; fewer than three words are one shingle.
Repeated rows and repeated ids each get a row.  Null ids are kept, but name a
component only if it has no other id (then it is null).  An empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_BYTES, RID, numbered, originals, spread_join, stored, trimmed, utf8, without_rows
from textloom.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Bytes that two linked fingerprints share at least.
SHARED_BYTES = 8 - MAX_BITS
#: Any five of eight positions hold three of the first four or of the last four.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Fingerprints of one list that are compared at a time, twice.
BLOCK = 512


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of one UTF-8 text, as a signed integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    if min(hashes) == max(hashes):
        return int(np.uint64(hashes[0]).astype(np.int64))
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(octets), 8192):
        ones += np.unpackbits(octets[i : i + 8192], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@trimmed
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t) for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(values, pa.int64())], names=["rid", "doc_id", "fp"])


def _fingerprinted(plain: DataFrame, id_at: int, text_at: int) -> DataFrame:
    """rid, doc_id and fp (signed) of each row of a numbered frame."""
    rows = plain.select("rid", F.col(f"c{id_at}").alias("doc_id"), F.col(f"c{text_at}").alias("text"))
    return rows.mapInArrow(_fingerprints, f"rid {RID}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    return int(np.array([sum(255 << 8 * p for p in positions)], dtype=np.uint64).view(np.int64)[0])


def postings(distinct: DataFrame) -> DataFrame:
    """The lists: triple, its bytes, block pair, and fp.

    A list of more than BLOCK is split into blocks, and each fingerprint goes to
    the pairs of blocks that its own is in, so that any two meet.  Long lists are
    found by a count that is combined before it is shuffled; the hot ones are
    salted while their rows are marked.
    """
    places = F.array(*(F.struct(F.lit(k).cast("byte").alias("triple"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("octets")) for k, t in enumerate(TRIPLES)))
    index = distinct.select("fp", F.explode(places).alias("p")).select("p.*", "fp")
    long = index.groupBy("triple", "octets").count().where(F.col("count") > BLOCK)
    blocks = F.ceil(F.col("count") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.least(b, F.col("own")) * F.col("blocks") + F.greatest(b, F.col("own")))
    total = len(TRIPLES) * distinct.count()
    marked = spread_join(index, long, ["triple", "octets"], "count", total, F.xxhash64("fp"), "left").withColumn("blocks", F.coalesce(blocks, F.lit(1))).withColumn("own", own)
    return marked.select("triple", "octets", F.explode(pairs).alias("blocks"), "fp")


#: Pairs that are tallied at a time.
PAIRS_AT_ONCE = 1 << 18


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, the keys being sorted, and the end."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.append(np.flatnonzero(new), len(new))


def _pairs(order: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """All (lesser, greater) pairs within each run of ``order``, in slices."""
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    after = end - np.arange(len(order)) - 1
    done = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS_AT_ONCE, "right")) - 1)
        n = after[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        both = np.stack([order[a], order[b]])
        both.sort(axis=0)
        yield both
        at = to


def linked_pairs(lists: np.ndarray, triples: np.ndarray, fps: np.ndarray) -> Iterator[np.ndarray]:
    """The linked pairs (positions) within each list, by a tally of shared bytes.

    ``lists``: the list of each fingerprint (unsigned), in runs; ``triples``: its
    positions.  The members of a list share its triple; for each of the other five
    positions an inverted index groups them by their byte, each posting that two
    share counts one, and pairs that reach SHARED_BYTES are verified bit by bit.
    """
    octets = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
    inside = np.array([[p in t for p in range(8)] for t in TRIPLES])[triples]
    starts = _starts(lists)
    least = SHARED_BYTES - len(TRIPLES[0])
    # lists are tallied together as long as their pairs are few
    pairs = np.concatenate([[0], np.cumsum(np.diff(starts) * (np.diff(starts) - 1) // 2)])
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(pairs, pairs[at] + PAIRS_AT_ONCE, "right")) - 1)
        lo, hi = starts[at], starts[to]
        tally: list[np.ndarray] = []
        for p in range(8):
            rows = np.flatnonzero(~inside[lo:hi, p]) + lo
            order = rows[np.lexsort((octets[rows, p], lists[rows]))]
            if len(order):
                tally += [a * len(fps) + b for a, b in _pairs(order, _starts(lists[order], octets[order, p]))]
        met, times = np.unique(np.concatenate(tally), return_counts=True) if tally else (np.empty(0, np.int64), np.empty(0, np.int64))
        met = met[times >= least]
        a, b = met // len(fps), met % len(fps)
        close = np.bitwise_count(fps[a] ^ fps[b]) <= MAX_BITS
        yield np.stack([a[close], b[close]])
        at = to


def forest(a: np.ndarray, b: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that span the pairs of ``a``, ``b``."""
    nodes, at = np.unique(np.concatenate([fps[a], fps[b]]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


@trimmed
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each list, the rows coming sorted by list."""
    held: np.ndarray | None = None

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists = np.cumsum(np.concatenate([[False], np.any(rows[1:, :3] != rows[:-1, :3], axis=1)]))
        alone = np.bincount(lists)[lists] < 2
        rows, lists = rows[~alone], lists[~alone]
        fps = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
        for a, b in linked_pairs(lists, rows[:, 0], fps) if len(rows) else ():
            if len(a):
                u, v = (x.view(np.int64) for x in forest(a, b, fps))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        if not len(rows):
            continue
        held = rows if held is None else np.concatenate([held, rows])
        last = np.flatnonzero(np.any(held[:, :3] != held[-1, :3], axis=1))
        if len(last):
            yield from linked(held[: last[-1] + 1])
            held = held[last[-1] + 1 :]
    if held is not None:
        yield from linked(held)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) of distinct fingerprints that keep every component."""
    lists = postings(distinct).repartition("triple", "octets", "blocks").sortWithinPartitions("triple", "octets", "blocks")
    return lists.select("triple", "octets", "blocks", "fp").mapInArrow(_links, "u long, v long")


def _near_duplicates(plain: DataFrame, id_at: int, text_at: int) -> DataFrame:
    seen = stored(_fingerprinted(plain, id_at, text_at), "fingerprints")
    distinct = stored(seen.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "n", "root", "component_id")
    return spread_join(seen, classes, ["fp"], "n", seen.count(), F.xxhash64("rid")).select("rid", "doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, fp, root (smallest fingerprint of the component) and
    component_id of each row."""
    return _near_duplicates(numbered(docs), docs.columns.index(id_col), docs.columns.index(text_col))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: its smallest
    id's first row (of null ids, any one row that is the same in every attempt).
    All columns stay, whatever their names."""
    plain = numbered(docs)
    marked = stored(_near_duplicates(plain, docs.columns.index(id_col), docs.columns.index(text_col)), "near-duplicates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    kept = marked.groupBy("root").agg(first).select(F.col("first.rid").alias("rid"))
    dropped = stored(marked.select("rid").join(kept, "rid", "left_anti"), "duplicates")
    return without_rows(plain, dropped, broadcast_bytes).select(*originals(docs))
