"""Operator 3: approximate nearest neighbours by inner product.

Vectors are dealt by hash over shards of about ``SHARD`` distinct vectors.  Each
shard gets a hierarchical navigable small-world graph, stored as one row of flat
arrays: the vectors, and for each level its nodes and their neighbours in an
array of fixed width.  A query descends the levels of every shard and searches
the lowest with a beam; the shards' results are merged.

A graph grows by insertion.  Nodes come in batches, each at most as large as the
graph so far: the new nodes search the graph for their nearest, level by level, as
a query does, and look at the others of their batch besides.  A node's neighbours
are chosen from what it finds by the usual rule (a candidate is taken if it is
nearer to the node than to those taken before), links are made both ways, and a
list that is full gives up its farthest for a nearer one.  So building takes about
the same time a vector whatever the shard's size.

Inner product is turned into nearness of directions for building: each vector gets
one more coordinate that makes all of a shard equally long.  Graphs compare in
single precision, after scaling by the shard's largest component (a query by its
own), so vectors of any size take part; scores are inner products of the original
vectors in double precision, infinite where these overflow.

Equal vectors share a node, which holds their smallest ids, as many as an answer
can show (k + 1, the query's own being left out), so copies neither crowd the
graph nor drop out of an answer.

Queries go to the shards in blocks: a row holds the ids and vectors of up to
``QUERY_BLOCK`` queries.  Memory: a shard's vectors and graph, and ``BLOCKS`` blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither as queries nor as candidates; vectors are
compared with those of their own length; rows with a null id take no part.  Rows
that share the query's id are its own.  A repeated row counts once.  Of several
vectors under one id each is a candidate, and the best counts; the id's query is
the least of them, compared component by component.  Ties go to the smaller id.
Scores that are no number (infinities of both signs) come last.  An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import pick, stored, trimmed

SHARD = 25_000
LINKS = 16
#: The lowest level's lists are this wide.
LOWEST_LINKS = 40
#: Nodes that are found for a new node, and others of its batch.
FOUND = 64
OWN_BATCH = 16
FIRST = 256
BATCH = 2048
BEAM = 160
#: Nodes of a query's beam that are followed at a time.
STEP = 4
ENTRIES = 8
QUERY_BLOCK = 1024
#: Blocks that a task takes at a time.
BLOCKS = 64
QUERIES_AT_ONCE = 256


def _rank_in_group(group: np.ndarray) -> np.ndarray:
    """Position of each element in its run of equal values (``group`` is sorted)."""
    first = np.concatenate([[True], group[1:] != group[:-1]])
    starts = np.flatnonzero(first)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, best first."""
    if ids.shape[1] > k:
        at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _diverse(x: np.ndarray, near: np.ndarray, score: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (row, node, score) of each row to its diverse nearest ones; ``near``:
    candidates, nearest first, -1 where none."""
    there = near >= 0
    c = x[near]
    between = c @ c.transpose(0, 2, 1)
    taken = np.zeros(near.shape, dtype=bool)
    for j in range(near.shape[1]):
        far = ~np.any(taken[:, :j] & (between[:, j, :j] >= score[:, j, None]), axis=1)
        taken[:, j] = there[:, j] & far & (taken.sum(1) < width)
    # room that is left goes to the nearest of the others
    order = np.argsort(np.where(there, ~taken, 2), axis=1, kind="stable")[:, :width]
    r = np.repeat(np.arange(len(near)), order.shape[1])
    j = order.ravel()
    fits = there[r, j]
    r, j = r[fits], j[fits]
    return r, near[r, j], score[r, j]


class Graph:
    """One shard: vectors and, from the lowest level up, (nodes, neighbours).

    ``nodes`` are rows of ``vectors`` in the order of their insertion; neighbours
    are positions in ``nodes``.
    """

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels
        #: What the beam compares; what it finds is scored in double precision.
        self.near = _equally_long(vectors)
        self.coarse = [self.near[nodes] for nodes, _ in levels]
        #: Nodes of each level that are in the graph so far.
        self.size = [len(nodes) for nodes, _ in levels]

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        rng, n = np.random.default_rng(seed), len(vectors)
        order = rng.permutation(n)
        height = np.floor(-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(LINKS)).astype(int)
        levels, level = [], 0
        while level == 0 or (height >= level).sum() > 1:
            nodes = order[height >= level].astype(np.int32) if level else order.astype(np.int32)
            levels.append((nodes, np.full((len(nodes), LINKS if level else LOWEST_LINKS), -1, dtype=np.int32)))
            level += 1
        height = np.minimum(height, level - 1)
        graph = cls(vectors, levels)
        graph.size = [0] * level
        score = [np.full(links.shape, -np.inf, dtype=np.float32) for _, links in levels]
        done = 0
        while done < n:
            to = min(n, done + max(FIRST, min(BATCH, done)))
            graph._insert(order[done:to], height[done:to], score)
            done = to
        return graph

    def _insert(self, rows: np.ndarray, height: np.ndarray, score: list[np.ndarray]) -> None:
        """Adds a batch, the next of every level's nodes."""
        x = self.near[rows]
        found = self._descend(x, FOUND, FOUND)
        for level in range(len(self.levels)):
            own = np.flatnonzero(height >= level)
            size, c = self.size[level], self.coarse[level]
            if len(own):
                new = np.arange(size, size + len(own))
                alike = x[own] @ x[own].T
                np.fill_diagonal(alike, -np.inf)
                near, near_score = _best(np.broadcast_to(new, alike.shape), alike, OWN_BATCH if size else FOUND)
                if size:
                    ids, s = found[level]
                    near, near_score = np.concatenate([ids[own], near], 1), np.concatenate([s[own], near_score], 1)
                near = np.where(near_score > -np.inf, near, -1)
                near, near_score = _best(near, near_score, FOUND)
                for i in range(0, len(own), 256):
                    r, b, s = _diverse(c, near[i : i + 256], near_score[i : i + 256], self.levels[level][1].shape[1] // 2)
                    a = new[r + i]
                    self._link(level, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s]), score[level])
                self.size[level] = size + len(own)

    def _link(self, level: int, a: np.ndarray, b: np.ndarray, s: np.ndarray, score: np.ndarray) -> None:
        """Adds links from a to b; a full list gives up its farthest for a nearer one."""
        links = self.levels[level][1]
        _, first = np.unique(a.astype(np.int64) * len(links) + b, return_index=True)
        first = first[~(links[a[first]] == b[first, None]).any(1)]
        a, b, s = a[first], b[first], s[first]
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        rank = _rank_in_group(a)
        for k in range(min(links.shape[1], int(rank.max(initial=-1)) + 1)):
            at = rank == k
            i, j, v = a[at], b[at], s[at]
            worst = score[i].argmin(1)
            better = v > score[i, worst]
            links[i[better], worst[better]] = j[better]
            score[i[better], worst[better]] = v[better]

    def _descend(self, queries: np.ndarray, k: int, beam: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level, the k best nodes (positions, -1 where none) and their scores."""
        out: list[tuple[np.ndarray, np.ndarray]] = [None] * len(self.levels)  # type: ignore[list-item]
        parts: list[list] = [[] for _ in self.levels]
        for i in range(0, len(queries), QUERIES_AT_ONCE):
            q = queries[i : i + QUERIES_AT_ONCE]
            entries = None
            for level in range(len(self.levels) - 1, -1, -1):
                if not self.size[level]:
                    continue
                if entries is None:
                    entries = np.zeros((len(q), 1), dtype=np.int64)
                ids, scores = _best(*self._beam(level, q, entries, beam), k)
                ids = np.where(scores > -np.inf, ids, -1)
                if ids.shape[1] < k:
                    pad = ((0, 0), (0, k - ids.shape[1]))
                    ids, scores = np.pad(ids, pad, constant_values=-1), np.pad(scores, pad, constant_values=-np.inf)
                parts[level].append((ids, scores))
                if level:
                    entries = np.where(ids[:, :ENTRIES] >= 0, self.below(level)[ids[:, :ENTRIES]], -1)
        for level, found in enumerate(parts):
            if found:
                out[level] = tuple(np.concatenate(p) for p in zip(*found, strict=True))
        return out

    def below(self, level: int) -> np.ndarray:
        """Where a level's nodes are in the level below."""
        place = np.empty(len(self.vectors), dtype=np.int64)
        nodes = self.levels[level - 1][0]
        place[nodes] = np.arange(len(nodes))
        return place[self.levels[level][0]]

    def _beam(self, level: int, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes (positions in the level, -1 beyond) and scores of each query."""
        links, x = self.levels[level][1], self.coarse[level]
        q, rows = len(queries), np.arange(len(queries))[:, None]
        seen = np.zeros((q, self.size[level] + 1), dtype=bool)
        seen[:, -1] = True  # where -1 points
        seen[rows, entries] = True
        ids = entries
        scores = np.where(ids >= 0, np.einsum("qd,qkd->qk", queries, x[ids]), -np.inf)
        open_ = ids >= 0
        while True:
            # the STEP best nodes whose neighbours weren't looked at yet
            live = np.where(open_, scores, -np.inf)
            step = min(STEP, live.shape[1])
            best = np.argpartition(-live, step - 1, axis=1)[:, :step]
            going = np.flatnonzero(np.take_along_axis(live, best, 1).max(1) > -np.inf)
            if not len(going):
                return ids, scores
            best = best[going]
            use = np.take_along_axis(open_[going], best, 1)
            open_[going[:, None], best] = False
            near = np.where(use[:, :, None], links[ids[going[:, None], best]], -1).reshape(len(going), -1)
            near[seen[going[:, None], near]] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = -np.sort(-near, axis=1)
            near = near[:, : max(1, int((near >= 0).sum(1).max()))]
            seen[going[:, None], near] = True
            fresh = near >= 0
            s = np.where(fresh, (x[near] @ queries[going][:, :, None])[:, :, 0], -np.inf)
            all_ids, all_scores = np.concatenate([ids[going], near], 1), np.concatenate([scores[going], s], 1)
            all_open = np.concatenate([open_[going], fresh], 1)
            if all_ids.shape[1] > beam:
                best = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
                all_ids, all_scores, all_open = (np.take_along_axis(a, best, 1) for a in (all_ids, all_scores, all_open))
            if all_ids.shape[1] > ids.shape[1]:
                grow = all_ids.shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, grow)), constant_values=-1)
                scores = np.pad(scores, ((0, 0), (0, grow)), constant_values=-np.inf)
                open_ = np.pad(open_, ((0, 0), (0, grow)))
            ids[going, : all_ids.shape[1]], scores[going, : all_ids.shape[1]], open_[going, : all_ids.shape[1]] = all_ids, all_scores, all_open

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``vectors`` (-1 where none) and scores, best first."""
        scaled = queries / np.abs(queries).max(1, keepdims=True)
        coarse = np.hstack([scaled, np.zeros((len(queries), 1))]).astype(np.float32)
        # all that the beam holds is scored exactly, so single precision costs no rank
        ids, _ = self._descend(coarse, max(beam, k), max(beam, k))[0]
        found = np.where(ids >= 0, self.levels[0][0][ids], -1)
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.einsum("qd,qkd->qk", queries, self.vectors[found])
        order = np.lexsort((_ordered(scores), found >= 0), axis=1)[:, ::-1][:, :k]
        return np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)


def _ordered(scores: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(scores), -np.inf, scores)


def _equally_long(vectors: np.ndarray) -> np.ndarray:
    """The vectors scaled by their largest component, with one more coordinate."""
    x = vectors / np.abs(vectors).max()
    square = (x * x).sum(1)
    return np.hstack([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]]).astype(np.float32)


INDEX_SCHEMA = "dim int, shard int, vectors binary, ids binary, ends binary, nodes array<binary>, links array<binary>"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def _distinct(k: int):
    """Distinct vectors of a batch as bytes, each with its k + 1 smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, set[int]] = {}
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held.setdefault((np.array(v, dtype=np.float64) + 0.0).tobytes(), set()).add(vec_id)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(s)[: k + 1] for s in held.values()], pa.list_(pa.int64()))], names=["v", "ids"])

    return run


def _build(table: pa.Table) -> pa.Table:
    order = np.argsort(np.array(table.column("v").to_pylist(), dtype=object), kind="stable")  # the same in every attempt
    vectors = [table.column("v")[int(i)].as_py() for i in order]
    ids = [table.column("ids")[int(i)].as_py() for i in order]
    x = np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)
    g = Graph.build(x, seed=table.column("shard")[0].as_py())
    row = [table.column("dim")[0].as_py(), table.column("shard")[0].as_py(), x.tobytes(), np.concatenate(ids).astype(np.int64).tobytes(), np.cumsum([len(i) for i in ids]).astype(np.int64).tobytes(), [n.tobytes() for n, _ in g.levels], [t.tobytes() for _, t in g.levels]]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    return pa.table({n: pa.array([v], t) for n, v, t in zip(["dim", "shard", "vectors", "ids", "ends", "nodes", "links"], row, types, strict=True)})


def _search(k: int, beam: int):
    def run(index: pa.Table, blocks: pa.Table) -> Iterator[pa.RecordBatch]:
        if not index.num_rows or not blocks.num_rows:
            return
        row = {c: index.column(c)[0].as_py() for c in index.column_names}
        x = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
        levels = [(np.frombuffer(n, dtype=np.int32), np.frombuffer(t, dtype=np.int32).reshape(-1, LINKS if i else LOWEST_LINKS)) for i, (n, t) in enumerate(zip(row["nodes"], row["links"], strict=True))]
        graph, ids, ends = Graph(x, levels), np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["ends"], dtype=np.int64)
        for block in range(blocks.num_rows):
            names = np.frombuffer(blocks.column("query_ids")[block].as_py(), dtype=np.int64).tolist()
            q = np.frombuffer(blocks.column("v")[block].as_py()).reshape(len(names), -1)
            out_q, out_i, out_s = [], [], []
            for i in range(0, len(q), QUERIES_AT_ONCE):
                found, scores = graph.search(q[i : i + QUERIES_AT_ONCE], k + 1, beam)
                for name, nodes, values, ordered in zip(names[i : i + QUERIES_AT_ONCE], found, scores, _ordered(scores), strict=True):
                    best: dict[int, tuple] = {}
                    for node, s, o in zip(nodes.tolist(), values.tolist(), ordered.tolist(), strict=True):
                        for m in ids[ends[node - 1] if node else 0 : ends[node]].tolist() if node >= 0 else ():
                            if m != name:
                                best.setdefault(m, (-o, m, s))
                    for _, m, s in sorted(best.values())[:k]:
                        out_q.append(name)
                        out_i.append(m)
                        out_s.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    def whole(index: pa.Table, blocks: pa.Table) -> pa.Table:
        return pa.Table.from_batches(run(index, blocks), pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return whole


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    rows = pick(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda a: a != 0))


def build_index(rows: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """A row a shard (INDEX_SCHEMA), stored; ``rows`` from ``usable``."""
    held = rows.mapInArrow(_distinct(k), "v binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    # in two steps, so that no task gathers the id lists of all copies of a vector
    held = held.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("v", "part").agg(ids.alias("ids")).groupBy("v").agg(ids.alias("ids"))
    distinct = stored(held.withColumn("dim", (F.octet_length("v") / 8).cast("int")), "vectors")
    sizes = distinct.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards"))
    dealt = distinct.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")).drop("shards")
    # as many tasks as shards: small in bytes, long to build
    tasks = max(1, sizes.agg(F.sum("shards")).first()[0] or 0)
    return stored(dealt.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, INDEX_SCHEMA), "graphs")


@trimmed
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries as blocks: those of one length, ids and vectors as bytes."""

    def out(dim: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], dtype=np.int64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([ids], pa.binary()), pa.array([b"".join(r[1] for r in rows)], pa.binary())], names=["dim", "n", "query_ids", "v"])

    held: dict[int, list] = {}
    for batch in batches:
        for query_id, v in zip(batch.column("query_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            rows = held.setdefault(len(v), [])
            rows.append((query_id, (np.array(v, dtype=np.float64) + 0.0).tobytes()))
            if len(rows) == QUERY_BLOCK:
                yield out(len(v), held.pop(len(v)))
    for dim, rows in held.items():
        yield out(dim, rows)


def query_blocks(queries: DataFrame) -> DataFrame:
    """dim, n, query_ids, v: the queries (query_id, v as array of double) in blocks, stored."""
    return stored(queries.mapInArrow(_blocks, "dim int, n long, query_ids binary, v binary"), "queries")


def nearest(index: DataFrame, blocks: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score; ``blocks``: from ``query_blocks``.

    Every shard gets every block of its length; a task has one shard and about
    BLOCKS blocks, so what is copied for a further task is a shard for each
    BLOCKS * QUERY_BLOCK queries.
    """
    groups = max(1, -(-blocks.count() // BLOCKS))
    # a row a vector length
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    dealt = blocks.join(F.broadcast(shards), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("group", F.pmod(F.xxhash64("query_ids"), F.lit(groups)).cast("int"))
    copies = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = ["dim", "shard", "group"]
    found = copies.groupBy(*key).cogroup(dealt.select(*key, "query_ids", "v").groupBy(*key)).applyInArrow(_search(k, beam), FOUND_SCHEMA)
    order = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    # one exchange, by query, serves both steps
    merged = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max_by("score", order).alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(order.desc(), "vec_id")
    return merged.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_in(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``."""
    rows = usable(vectors, id_col, vector_col)
    index = build_index(rows, k, shard)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return nearest(index, query_blocks(queries), k)
