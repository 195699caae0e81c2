"""Operator 8: sum-of-squares online packing into training windows.

Each task packs the documents of its partition in order, holding an array
``level`` with the number of partially filled windows of each fill level.  A
document of more than a window is cut into full windows and a remainder.  A
remainder (or shorter document) of s ids goes to the fill level h, or into a new
window (h = 0), for which the sum of squares of ``level`` becomes smallest.
What is still open at the partition's end, or when ``OPEN_WINDOWS`` are open, is
poured together: the windows' pieces, cut where a window fills, so that at most
one window a pouring stays short; it is as long as its pieces where that is a
power of two, else padded.

Memory: the ids of the open windows (at most OPEN_WINDOWS), the level array and
one document.  Sequence ids are the partition's number times 2**36 plus a count;
a task that is run again writes the same pieces.

A null text counts as empty: its document is the end id alone.  Repeated rows
and repeated or null ids are packed as documents of their own.  An empty table
gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textloom.llm.common import pick, trimmed, utf8
from textloom.llm.tokenizing import encoder

OPEN_WINDOWS = 4096
SEQUENCES_A_TASK = 1 << 36


class Packer:
    """Packs pieces (document, start, ids, document's length) online.

    ``out`` gets (document, start, length, crc, doc_tokens, sequence, offset).
    """

    def __init__(self, window: int, first: int = 0, open_windows: int = OPEN_WINDOWS):
        self.window, self.sequence, self.most = window, first, open_windows
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.at: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        """One document: its ids as little-endian unsigned 32-bit integers."""
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.close([(doc, start, ids[4 * start : 4 * (start + self.window)], total)])
            start += self.window
        if start < total:
            self.place((doc, start, ids[4 * start :], total), total - start)

    def best_level(self, size: int) -> int:
        """The fill level whose choice makes the sum of squares smallest; ties
        go to the fullest window."""
        last = self.window - size
        n = self.level
        # moving one window from level h to h + size changes the sum by
        # 2 (n[h + size] - n[h]) + 2; a window that fills up is counted no more,
        # and a new one comes from level 0, which isn't counted
        change = 2 * (n[size : self.window + 1] - n[: last + 1]) + 2
        change[last] = 1 - 2 * n[last]
        change[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1 if size < self.window else 0
        return int(last - np.argmin(change[::-1]))

    def place(self, piece: tuple, size: int) -> None:
        h = self.best_level(size)
        if h:
            pieces = self.at[h].pop()
            self.level[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.window:
            self.close(pieces)
            return
        self.at[h + size].append(pieces)
        self.level[h + size] += 1
        self.n_open += 1
        if self.n_open > self.most:
            self.pour()

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def pour(self) -> None:
        """Fills windows from the open ones, fullest first, cutting pieces."""
        held: list[tuple] = []
        room = self.window
        for pieces in (p for level in reversed(self.at) for p in level):
            for doc, start, ids, total in pieces:
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    held.append((doc, start, part, total))
                    start, room = start + len(part) // 4, room - len(part) // 4
                    if not room:
                        self.close(held)
                        held, room = [], self.window
        if held:
            self.close(held)
        self.level[:] = 0
        self.at = [[] for _ in range(self.window + 1)]
        self.n_open = 0


@trimmed
def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    packer = Packer(window, TaskContext.get().partitionId() * SEQUENCES_A_TASK)
    ids, end, kind = encoder(path).ids, end_id.to_bytes(4, "little"), None

    def rows() -> pa.RecordBatch:
        columns = list(zip(*packer.out, strict=True))
        packer.out = []
        types = [kind, *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        kind = batch.column("doc_id").type
        for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
            packer.add(doc, ids(text) + end)
        if packer.out:
            yield rows()
    packer.pour()
    if packer.out:
        yield rows()


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_pack, path=tokenizer_path, window=window, end_id=end_id), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
