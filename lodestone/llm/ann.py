"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_k
from ..session import stored
from .vectors import matrix, usable

# The tree is fitted on this many vectors at most (by hash of the key); every vector is indexed.
SAMPLE = 50_000
BRANCHES = 16
# Leaves have about this many vectors, but there are at most MAX_LEAVES.
LEAF, MAX_LEAVES = 256, 4_096
ROUNDS = 8
# Queries (at most) on which the number of leaves to visit is calibrated against brute force, and the recall asked of it.
CALIBRATION, RECALL = 128, 0.95
# Rows of either side of a leaf that meet in one task.
CUT = 4_096
# Pairs found that a task holds before it keeps only the best of each query.
HELD = 500_000


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


class Tree:
    """Centres and children of every node; a node without children is a leaf."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        leaves = max(1, min(MAX_LEAVES, math.ceil(rows / LEAF), len(sample) // 8))
        self.centres: list[np.ndarray | None] = [None]
        self.children: list[list[int]] = [[]]
        todo = [(0, np.arange(len(sample)), leaves)]
        while todo:
            node, members, share = todo.pop()
            k = min(BRANCHES, share)
            if k < 2 or len(np.unique(sample[members[:1_000]], axis=0)) < k:
                continue
            centres = _kmeans(sample[members], k, rng)
            near = nearest(sample[members], centres)
            self.centres[node] = centres
            for i in range(k):
                inside = members[near == i]
                self.children[node].append(len(self.children))
                self.centres.append(None)
                self.children.append([])
                if len(inside) >= 8:
                    todo.append((self.children[node][i], inside, round(share * len(inside) / len(members))))
        self.counts: dict[int, int] = {}
        self.dim = sample.shape[1]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls to, going to the nearest centre at each level."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, members = todo.pop()
            if not self.children[node]:
                out[members] = node
                continue
            near = nearest(x[members], self.centres[node])
            todo.extend((child, members[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any())
        return out

    def leaves(self, query: np.ndarray) -> Iterator[int]:
        """Leaves best bin first: always the open node whose centre has the largest inner product with the query."""
        queue = [(-math.inf, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield node
                continue
            for child, score in zip(self.children[node], (self.centres[node] @ query).tolist()):
                heapq.heappush(queue, (-score, child))

    def visits(self, query: np.ndarray, leaves: int, enough: int) -> list[int]:
        """The first ``leaves`` leaves that hold vectors, and more until they hold ``enough``."""
        out, seen = [], 0
        for leaf in self.leaves(query):
            if self.counts.get(leaf):
                if len(out) >= leaves and seen >= enough:
                    break
                out.append(leaf)
                seen += self.counts[leaf]
        return out


def _best(q: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(row of q, row of x, score): each query's ``k`` best of ``x`` without its own id, ties to the smaller id."""
    for start in range(0, len(q), 512):
        scores = q[start: start + 512] @ x.T
        scores[query_ids[start: start + 512, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(scores, start):
            some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
            some = some[np.isfinite(row[some])]
            order = some[np.lexsort((ids[some], -row[some]))][:k]
            yield np.full(len(order), i), order, row[order]


class _Merged:
    """The ``k`` best found so far of every query that a task has met."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.limit = k, [], 0, HELD

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.limit:
            self._shrink()

    def _shrink(self) -> None:
        query, vec, score = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.parts, self.size = [(query[keep], vec[keep], score[keep])], int(keep.sum())
        self.limit = self.size + HELD

    def full(self) -> bool:
        """Whether so many queries have been met that what is found must leave."""
        return self.size > 4 * HELD

    def take(self) -> pa.RecordBatch:
        if self.parts:
            self._shrink()
        columns = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.parts, self.size, self.limit = [], 0, HELD
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["query_id", "vec_id", "score"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches recut into one batch for each value of the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.stack([np.asarray(batch.column(i)) for i in range(keys)], axis=1)
        starts = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1), batch.num_rows]
        for low, high in zip(starts, starts[1:]):
            here = tuple(code[low])
            if held and here != at:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            at = here
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _brute_force(index: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, leaf, score) of a few queries against all vectors; one scan, k rows a query and batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, leaf = matrix(batch.column(2), q.shape[1]), np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, b, s in _best(q, ids, x, own, k):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(own[b]), pa.array(leaf[b]), pa.array(s)],
                                                 names=["query_id", "vec_id", "leaf", "score"])

    found = index.select("id", "leaf", "vec").mapInArrow(run, "query_id bigint, vec_id bigint, leaf int, score double")
    return top_k(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def build(df: DataFrame, key: str, vector: str, queries: Column, k: int, recall: float = RECALL) -> tuple[Tree | None, DataFrame, int]:
    """(tree, index (id, leaf, vec, asks), leaves to visit). ``queries`` marks the rows that ask."""
    base = usable(df, key, vector)
    sizes = base.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return None, base, 0
    dim, rows = sizes[0].dim, sizes[0]["count"]
    held = base.filter(F.col("dim") == dim).select("id", "vec", queries.alias("asks"))
    sample = held.select("vec", F.xxhash64("id").alias("h")).orderBy("h", "vec").limit(SAMPLE)
    tree = Tree(matrix([r.vec for r in sample.toLocalIterator()], dim), rows)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = pa.array(tree.leaf_of(matrix(batch.column(1), dim)))
            yield pa.RecordBatch.from_arrays([batch.column(0), leaf, batch.column(1), batch.column(2)], names=["id", "leaf", "vec", "asks"])

    index = stored(held.mapInArrow(assign, "id bigint, leaf int, vec binary, asks boolean"), "ann-index")
    tree.counts = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # at most one row a leaf
    picked = index.filter("asks").select("id", "vec", F.xxhash64("id", F.lit(1)).alias("h")).orderBy("h").limit(CALIBRATION).collect()
    if not picked:
        return tree, index, 0
    ids, q = np.array([r.id for r in picked]), matrix([r.vec for r in picked], dim)
    truth: dict[int, list[int]] = {}
    for r in _brute_force(index, ids, q, k).collect():
        truth.setdefault(r.query_id, []).append(r.leaf)
    needed = []
    for i, query in zip(ids.tolist(), q):
        place = {leaf: n for n, leaf in enumerate(tree.visits(query, len(tree.counts), 0), 1)}
        needed.extend(place[leaf] for leaf in truth.get(i, ()))
    needed.sort()
    return tree, index, needed[math.ceil(recall * len(needed)) - 1] if needed else 0


def search(df: DataFrame, key: str, vector: str, queries: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found to each row that ``queries`` marks, by inner product.

    Scores are inner products of the vectors as they are, in double precision; ties go to the smaller id. A query never
    finds rows of its own id; all candidates come back if there are fewer than ``k``. Rows without a key, and vectors
    that are null, empty, zero or hold null or non-finite numbers, take no part, nor do those of another length than
    most. Each row is a candidate of its own, so a repeated id can be found more than once; of repeated query ids one
    (of smallest vector) asks. Other columns are not read. An empty table gives no rows.

    The tree is fitted on a bounded sample, every vector is put into a leaf, and the number of leaves that queries
    visit is widened until a bounded set of them reaches ``recall`` against brute force over all vectors. Queries then
    go to their leaves by inner product, best bin first, and meet each leaf's vectors in cuts of bounded size; a task
    sends on the best of each query over all cuts that it has read.
    """
    tree, index, leaves = build(df, key, vector, queries, k, recall)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if tree is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = index.sparkSession.sparkContext.broadcast(tree)  # at most MAX_LEAVES centres

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for start in range(0, len(raw), 256):
                some = raw[start: start + 256]
                goals = [found.visits(v, leaves, k + 1) for v in matrix(some, found.dim)]
                at = np.repeat(np.arange(start, start + len(some)), [len(g) for g in goals])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)), pa.array(np.concatenate(goals).astype(np.int32)),
                    batch.column(1).take(pa.array(at))], names=["id", "leaf", "vec"])

    asks = index.filter("asks").groupBy("id").agg(F.min("vec").alias("vec"))
    sent = stored(asks.mapInArrow(visit, "id bigint, leaf int, vec binary"), "ann-visits")
    crowd = index.groupBy("leaf").agg(F.count("*").alias("n")).join(
        sent.groupBy("leaf").agg(F.count("*").alias("asked")), "leaf").select(
        "leaf", F.ceil(F.col("n") / CUT).cast("int").alias("cuts"), F.ceil(F.col("asked") / CUT).cast("int").alias("ask_cuts"))
    crowd = F.broadcast(crowd)  # at most MAX_LEAVES rows
    cut = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    vectors = index.join(crowd, "leaf").select(
        "leaf", cut(F.col("cuts"), 0).alias("i"), every(F.col("ask_cuts")).alias("j"), F.lit(False).alias("asking"), "id", "vec")
    asking = sent.join(crowd, "leaf").select(
        "leaf", every(F.col("cuts")).alias("i"), cut(F.col("ask_cuts"), 1).alias("j"), F.lit(True).alias("asking"), "id", "vec")

    dim = tree.dim

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Merged(k)
        for run in _runs(batches, 3):
            side, ids = np.asarray(run.column(3)), np.asarray(run.column(4))
            q, c = np.flatnonzero(side), np.flatnonzero(~side)
            if len(q) and len(c):
                x = matrix(run.column(5), dim)
                for rows, found, scores in _best(x[q], ids[q], x[c], ids[c], k):
                    best.add(ids[q][rows], ids[c][found], scores)
            if best.full():
                yield best.take()
        yield best.take()

    keys = ["leaf", "i", "j"]
    met = vectors.union(asking).repartition(*keys).sortWithinPartitions(*keys)
    found = met.mapInArrow(meet, "query_id bigint, vec_id bigint, score double")
    ranked = top_k(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
