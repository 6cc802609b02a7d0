"""Approximate nearest neighbours on proximity graphs: shards of bounded size, a walk from neighbour to neighbour in each.

Vectors are dealt by hash to shards of about ``SHARD``. A vector is linked with the nearest of its own shard, so building
compares it with a bounded number of others, whatever the number of vectors. A query walks through every shard; a block of
queries and a shard meet in one task, which holds both and nothing else. Distances are squared L2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import dense
from .ranking import hash_order
from ..session import stored

DEGREE = 16
# Links (at most) by which a vertex is left in a search.
SAMPLE = 32
SHARD = 8_192
# Vertices of a shard where a search may enter, and the nearest of them where it does.
ENTRIES = 64
ENTERED = 16
# Queries that meet a shard in one task, and those that walk through it together.
BLOCK_QUERIES = 2_048
WALKERS = 256
BEAMS = (32, 64, 128, 256, 512, 1_024, 2_048)

BUILT = "shard int, chunk_id bigint, nearest array<bigint>, distances array<double>, neighbors array<bigint>"
FOUND = "query_id bigint, chunk_id bigint, distance double, looked bigint"


@dataclass(frozen=True)
class Graph:
    """``edges(chunk_id, neighbor_id, distance)`` of the nearest found, ``links(shard, chunk_id, neighbors)`` as searched."""

    edges: DataFrame
    links: DataFrame


def _nearest(x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the ``degree`` others nearest to each row, nearest first."""
    n = len(x)
    k = min(degree, n - 1)
    norm = (x * x).sum(axis=1)
    places, gaps = np.zeros((n, k), np.int64), np.zeros((n, k))
    for lo in range(0, n if k else 0, WALKERS):
        rows = np.arange(lo, min(lo + WALKERS, n))
        d = norm[None, :] - 2.0 * (x[rows] @ x.T)
        d[rows - lo, rows] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        exact = np.round(((x[rows, None, :] - x[near]) ** 2).sum(axis=2), dense.DIGITS)
        order = np.lexsort((near, exact), axis=1)
        places[rows], gaps[rows] = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
    return places, gaps


def _both_ways(places: np.ndarray, gaps: np.ndarray, most: int) -> list[np.ndarray]:
    """The links of each vertex: its own, then the nearest ways back that are not among them, ``most`` at most."""
    n, k = places.shape
    to, at = np.repeat(np.arange(n), k), places.ravel()
    back = ~(places[at] == to[:, None]).any(axis=1)
    at, to, gap = at[back], to[back], gaps.ravel()[back]
    order = np.lexsort((to, gap, at))
    to, first = to[order], np.searchsorted(at[order], np.arange(n + 1))
    return [np.concatenate((places[i], to[first[i]:first[i + 1]][:max(most - k, 0)])) for i in range(n)]


def build(vectors: DataFrame, degree: int = DEGREE, sample: int = SAMPLE, seed: int = 0, shard: int = SHARD) -> Graph:
    """Graphs of the ``degree`` nearest neighbours that each of ``vectors(chunk_id, embedding)`` has in its shard.

    Shards hold about ``shard`` vectors each. Of rows that share an id one is kept. For searching, an edge is followed both
    ways; of the ways back a vertex keeps the nearest, so that none has more than ``sample`` links (or ``degree``, if more).
    """
    rows = stored(_distinct(vectors), "graph-vectors")
    n_shards = max(-(-rows.count() // shard), 1)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(n_shards)).cast("int"))

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk_id")
        ids = group.column("chunk_id").to_numpy()
        places, gaps = _nearest(dense._matrix(group.column("embedding")), degree)
        return pa.table({
            "shard": group.column("shard"), "chunk_id": ids, "nearest": pa.array(list(ids[places]), pa.list_(pa.int64())),
            "distances": pa.array(list(gaps), pa.list_(pa.float64())),
            "neighbors": pa.array([ids[of] for of in _both_ways(places, gaps, sample)], pa.list_(pa.int64()))})

    built = stored(dealt.groupBy("shard").applyInArrow(link, BUILT), "graph-links")
    edges = built.select("chunk_id", F.inline(F.arrays_zip(F.col("nearest").alias("neighbor_id"), F.col("distances").alias("distance"))))
    return Graph(edges.toDF("chunk_id", "neighbor_id", "distance"), built.select("shard", "chunk_id", "neighbors"))


def _distinct(vectors: DataFrame) -> DataFrame:
    """One vector of each id; rows without a vector are left out."""
    return vectors.filter("embedding is not null").groupBy(F.col("chunk_id").cast("bigint").alias("chunk_id")).agg(
        F.min("embedding").alias("embedding"))


def _tables(rows: np.ndarray, values: tuple[np.ndarray, ...], n: int, width: int, empty: tuple) -> list[np.ndarray]:
    """Values that are sorted by row as one table each: the first ``width`` of each of ``n`` rows, the rest filled."""
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = place < width
    out = []
    for value, fill in zip(values, empty):
        table = np.full((n, width), fill, dtype=value.dtype)
        table[rows[kept], place[kept]] = value[kept]
        out.append(table)
    return out


def _walk(q: np.ndarray, x: np.ndarray, links: np.ndarray, doors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, distances, looked) of the ``beam`` nearest that each of ``q`` comes by, nearest first, -1 where it found fewer.

    A query enters at the nearest of ``doors``. In each step the vertices among its ``beam`` nearest that were not opened yet
    are opened together: the distances of their linked vertices (``links``, -1 for none) that it has not seen are looked at.
    It ends when the ``beam`` nearest are opened. ``looked``: distances looked at, those of the doors included.
    """
    n, size = len(q), len(x)
    x_norm, q_norm = (x * x).sum(axis=1), (q * q).sum(axis=1)
    d = x_norm[None, doors] + q_norm[:, None] - 2.0 * (q @ x[doors].T)
    order = np.argsort(d, axis=1, kind="stable")[:, :min(beam, ENTERED)]
    gaps, spots = np.full((n, beam), np.inf), np.full((n, beam), -1)
    gaps[:, :order.shape[1]], spots[:, :order.shape[1]] = np.take_along_axis(d, order, 1), doors[order]
    opened = spots < 0
    seen = np.zeros(n * size, bool)
    seen[(np.arange(n)[:, None] * size + doors[None, :]).ravel()] = True
    looked = np.full(n, len(doors))
    while True:
        row, col = np.nonzero(~opened)
        if not len(row):
            return spots, gaps, looked
        opened[row, col] = True
        near = links[spots[row, col]]
        pairs = (row[:, None] * size + near)[near >= 0]
        pairs = np.unique(pairs[~seen[pairs]])
        seen[pairs] = True
        row, spot = np.divmod(pairs, size)
        looked += np.bincount(row, minlength=n)
        gap = x_norm[spot] + q_norm[row] - 2.0 * np.einsum("ij,ij->i", x[spot], q[row])
        better = gap < gaps[row, -1]
        row, spot, gap = row[better], spot[better], gap[better]
        order = np.lexsort((spot, gap, row))
        row = row[order]
        width = min(int(np.bincount(row, minlength=1).max()), beam)
        fresh, at = _tables(row, (gap[order], spot[order]), n, width, (np.inf, -1))
        gaps, spots = np.concatenate((gaps, fresh), axis=1), np.concatenate((spots, at), axis=1)
        opened = np.concatenate((opened, at < 0), axis=1)
        best = np.argsort(gaps, axis=1, kind="stable")[:, :beam]
        gaps, spots, opened = (np.take_along_axis(t, best, 1) for t in (gaps, spots, opened))


def search(
    queries: DataFrame, vectors: DataFrame, links: DataFrame, k: int, beam: int, exclude_self: bool = False, entries: int = ENTRIES
) -> DataFrame:
    """(query_id, rank, chunk_id, distance, visited): the k nearest found, and the distances looked at for that query.

    In each shard a query keeps the ``beam`` nearest that it has seen and enters at the nearest of ``entries`` vertices.
    """
    wide = max(beam, k + exclude_self)
    asked = queries.filter("embedding is not null").groupBy(F.col("query_id").cast("bigint").alias("query_id")).agg(
        F.min(F.col("embedding").cast("array<double>")).alias("asked"))
    asked = stored(asked, "graph-asked")
    n_blocks = max(-(-asked.count() // BLOCK_QUERIES), 1)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    # One row a shard; every shard is met by all blocks.
    shards = links.select(F.col("shard").alias("met")).distinct()
    left = asked.crossJoin(F.broadcast(shards)).select("query_id", "asked", F.col("met").alias("shard"), "block").groupBy("shard", "block")
    rows = links.join(_distinct(vectors), "chunk_id").select("shard", "chunk_id", "neighbors", F.col("embedding").alias("stored"))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).groupBy("shard", "block")

    def meet(these: pa.Table, those: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64()), ("looked", pa.int64())])
        if not these.num_rows or not those.num_rows:
            return schema.empty_table()
        those = those.sort_by("chunk_id")
        ids, x = those.column("chunk_id").to_numpy(), dense._matrix(those.column("stored"))
        near = those.column("neighbors").combine_chunks()
        to, sizes = near.flatten().to_numpy(), np.diff(near.offsets.to_numpy())
        # A link to a vector that is gone leads nowhere.
        place = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        ways, = _tables(np.repeat(np.arange(len(ids)), sizes), (np.where(ids[place] == to, place, -1),), len(ids), int(sizes.max()), (-1,))
        doors = np.sort(np.random.default_rng(0).permutation(len(ids))[:entries])
        asking, q = these.column("query_id").to_numpy(), dense._matrix(these.column("asked"))
        out = []
        for lo in range(0, len(q), WALKERS):
            some = asking[lo:lo + WALKERS]
            spots, gaps, looked = _walk(q[lo:lo + WALKERS], x, ways, doors, wide)
            real = spots >= 0
            if exclude_self:
                real &= ids[spots] != some[:, None]
            real &= np.cumsum(real, axis=1) <= k
            row, col = np.nonzero(real)
            spot = spots[row, col]
            exact = np.round(((x[spot] - q[lo + row]) ** 2).sum(axis=1), dense.DIGITS)
            # The looks of a query in this shard stand in its first row.
            first = np.diff(row, prepend=-1) != 0
            out.append(pa.table([some[row], ids[spot], exact, np.where(first, looked[row], 0)], schema=schema))
        return pa.concat_tables(out)

    found = left.cogroup(right).applyInArrow(meet, FOUND)
    of_query = W.partitionBy("query_id")
    ranked = found.withColumn("visited", F.sum("looked").over(of_query)).withColumn(
        "rank", F.row_number().over(of_query.orderBy("distance", "chunk_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "distance", "visited")


def recall_of(found: DataFrame, true: DataFrame) -> float:
    """Share of the true (query_id, chunk_id) pairs that are among those found."""
    hits = true.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    n, n_hits = hits.agg(F.count("*"), F.count("hit")).head()
    return n_hits / n if n else 1.0


def calibrate_beam(
    queries: DataFrame, vectors: DataFrame, links: DataFrame, k: int, recall: float, exclude_self: bool = False
) -> int:
    """The narrowest of ``BEAMS`` that finds ``recall`` of the true neighbours of at most ``dense.CALIBRATION`` queries by hash."""
    few = stored(queries.select("query_id", "embedding").orderBy(hash_order(F.col("query_id"), 0), "query_id").limit(
        dense.CALIBRATION).dropDuplicates(["query_id"]), "graph-calibration")
    true = stored(dense.search_exact(few, vectors, k, exclude_self), "graph-true")
    for beam in BEAMS:
        if beam >= k and recall_of(search(few, vectors, links, k, beam, exclude_self), true) >= recall:
            return beam
    return BEAMS[-1]
