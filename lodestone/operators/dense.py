"""Dense vectors: hashed text vectors, exact and approximate nearest neighbours, and the chunk table.

Searches scan the vectors once in Arrow blocks. Each task keeps its k best chunks per query and only those are
shuffled, so the traffic is (queries · k · tasks) rows however many vectors there are. Distances are squared L2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from . import infer
from .ranking import BROADCAST_ROWS, at_most, broadcast_if, hash_order, top_k
from ..config import IndexConfig
from ..functions.text import let, run_counts, words
from ..session import stored

DIGITS = 6
# A query matrix of at most this size is sent to every executor; larger query sets are joined block by block.
QUERY_BYTES = 64 << 20
# Rows of either side that meet in one group of the block join. Each side is copied once per block of the other, so few
# large blocks keep the shuffle small.
BLOCK_VECTORS = 32_768
# Queries and vectors of one distance matrix.
BLOCK_QUERIES = 2_048
STEP = 4_096
# Queries and codes of one sum of table entries; codes that a task holds, with their vectors, before it reads them.
CODE_QUERIES = 256
CODE_STEP = 2_048
CODE_ROWS = 1 << 17
# Queries (at most) on which the number of cells to probe is calibrated against brute force.
CALIBRATION = 128

NOBODY = np.zeros(0, np.int64)
RESULT = "query_id bigint, chunk_id bigint, distance double"


# ---- text vectors ----------------------------------------------------------------------------------------------


def hash_bucket(token: Column, dim: int) -> Column:
    """Bucket of a token by the first 32 bits of its MD5, equal in every engine."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim


def _buckets(text: str, dim: int) -> Column:
    """(bucket, n) counts of the hashed words of a text, as an array inside the row."""
    hashed = F.transform(words(text), lambda t: hash_bucket(t, dim).cast("int"))
    return run_counts(hashed, "bucket", "n")


def _length(counts: Column) -> Column:
    return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, b: s + b["n"] * b["n"]))


def hashed_weights(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, bucket, weight): hashed word counts of unit length, the model-free encoder, in long form."""
    unit = lambda counts: let(_length(counts), lambda length: F.transform(
        counts, lambda b: F.struct(b["bucket"].alias("bucket"), (b["n"] / length).alias("weight"))
    ))
    return df.select(key, F.inline(let(_buckets(text, dim), unit)))


def hashed_vectors(df: DataFrame, key: str, text: str, dim: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, embedding) with the hashed vectors as arrays; text without words has the zero vector. No shuffle."""
    return _hashed(df.select(key, *keep, words(text).alias("_terms")), dim)


def hashed_counts(df: DataFrame, key: str, counts: str, dim: int) -> DataFrame:
    """The vectors of ``hashed_vectors`` out of the counted words ``array<struct<term, tf>>`` of each row."""
    return _hashed(df.select(key, F.col(f"{counts}.term").alias("_terms"), F.col(f"{counts}.tf").alias("_times")), dim)


def _hashed(df: DataFrame, dim: int) -> DataFrame:
    """``df`` with ``embedding`` in the place of ``_terms`` and, where a term counts more than once, ``_times``."""
    kept = [f for f in df.schema.fields if f.name not in ("_terms", "_times")]
    timed = "_times" in df.columns

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                n, lists = batch.num_rows, batch.column("_terms")
                terms = lists.flatten().dictionary_encode()
                buckets = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in terms.dictionary.to_pylist()], np.int64)
                row = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                cell = row * dim + buckets[terms.indices.to_numpy(zero_copy_only=False)] if len(row) else row
                times = batch.column("_times").flatten().to_numpy() if timed else None
                counts = np.bincount(cell, weights=times, minlength=n * dim).astype(np.float64).reshape(n, dim)
                length = np.sqrt((counts * counts).sum(axis=1))
                x = counts / np.where(length > 0, length, 1.0)[:, None]
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), vectors], names=[*(f.name for f in kept), "embedding"])

    return df.mapInArrow(embed, T.StructType([*kept, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def embed(df: DataFrame, key: str, text: str, encoder: infer.Factory, batch_size: int = 16) -> DataFrame:
    """(key, embedding) by an injected encoder of text batches."""
    rows = df.select(key, F.col(text).alias("_text"))
    return infer.run(rows, encoder, "_text", "embedding", "array<float>", batch_size).drop("_text")


# ---- block kernel ----------------------------------------------------------------------------------------------


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as one float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("an embedding is NULL; filter such rows or embed their text")
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


class _Best:
    """The k nearest chunks of each query seen so far in one task, a row of places per query.

    Taking in a block costs one look at each of its pairs; only the queries that a block brings a nearer chunk are
    sorted again, whatever the number of queries.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool) -> None:
        self.ids, self.q, self.k, self.exclude_self = query_ids, queries, k, exclude_self
        n = len(query_ids)
        self.q_norm = (queries * queries).sum(axis=1)
        self.chunk, self.dist = np.zeros((n, k), np.int64), np.full((n, k), np.inf)

    def add(self, chunk_ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Offer vectors ``x`` to the queries ``rows`` (all of them by default)."""
        if rows is None:
            rows = np.arange(len(self.ids))
        norm = (x * x).sum(axis=1)
        # A distance matrix has at most BLOCK_QUERIES · STEP numbers, whatever the query set.
        for at in range(0, len(rows), BLOCK_QUERIES):
            some = rows[at:at + BLOCK_QUERIES]
            q, q_norm = -2.0 * self.q[some], self.q_norm[some, None]
            for lo in range(0, len(chunk_ids), STEP):
                d = q @ x[lo:lo + STEP].T
                d += norm[None, lo:lo + STEP]
                d += q_norm
                self.offer(chunk_ids[lo:lo + STEP], d, some)

    def offer(self, ids: np.ndarray, d: np.ndarray, rows: np.ndarray) -> None:
        """Take in the distances (rows, ids) of chunks."""
        if self.exclude_self:
            own = np.flatnonzero(np.isin(ids, self.ids[rows]))
            at, col = np.nonzero(self.ids[rows, None] == ids[None, own])
            d[at, own[col]] = np.inf
        # Distances count rounded: what rounding may bring to the limit is looked at, the rest is dropped unrounded.
        limit = self.dist[rows, -1]
        if d.shape[1] > self.k and np.isinf(limit).any():
            limit = np.fmin(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        at, col = np.divmod(np.flatnonzero(d <= (limit + 2 * 10.0 ** -DIGITS)[:, None]), d.shape[1])
        self.take(rows[at], ids[col], d[at, col])

    def take(self, at: np.ndarray, chunk_ids: np.ndarray, d: np.ndarray) -> None:
        """Take in single pairs: the distance of each of ``chunk_ids`` to the query at its place of ``at``."""
        if not len(at):
            return
        kept, place = np.unique(at, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(kept)), self.k), place])
        chunk = np.concatenate([self.chunk[kept].ravel(), chunk_ids])
        dist = np.concatenate([self.dist[kept].ravel(), np.round(np.maximum(d, 0.0), DIGITS)])
        order = np.lexsort((chunk, dist, row))
        # Every row has at least k entries, those not filled yet at an infinite distance.
        first = np.searchsorted(row[order], np.arange(len(kept)))
        best = order[first[:, None] + np.arange(self.k)]
        self.chunk[kept], self.dist[kept] = chunk[best], dist[best]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The chunks found, a bounded number of queries at a time."""
        for at in range(0, len(self.ids), BLOCK_QUERIES):
            row, place = np.nonzero(np.isfinite(self.dist[at:at + BLOCK_QUERIES]))
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(self.ids[at + row], pa.int64()), "chunk_id": pa.array(self.chunk[at + row, place], pa.int64()),
                "distance": pa.array(self.dist[at + row, place], pa.float64())})


def _asking(cells: np.ndarray | None) -> dict[int, np.ndarray]:
    """The queries that look at each cell, of an array with the cells of each query."""
    if cells is None or not cells.size:
        return {}
    order = np.argsort(cells, axis=None, kind="stable")
    cell, first = np.unique(cells.ravel()[order], return_index=True)
    return dict(zip(cell.tolist(), np.split(order // cells.shape[1], first[1:])))


def _merge(local: DataFrame, k: int) -> DataFrame:
    order = [F.asc("distance"), F.asc("chunk_id")]
    return top_k(local, ["query_id"], order, k).select("query_id", "rank", "chunk_id", "distance")


def _query_matrix(queries: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and matrix of the queries if they are within ``QUERY_BYTES``, else None."""
    first = queries.select(F.size("embedding")).head()
    if first is None:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    if not at_most(queries, QUERY_BYTES // (8 * max(first[0], 1))):
        return None
    table = queries.select(F.col("query_id").cast("bigint"), "embedding").toArrow()
    return table.column("query_id").to_numpy(), _matrix(table.column("embedding"))


def _scan(
    vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool,
    decode: Callable[[pa.RecordBatch], np.ndarray], probes: np.ndarray | None = None,
) -> DataFrame:
    """One pass over the vectors with the queries on every executor; ``probes`` lists the cells of each query."""
    sent = vectors.sparkSession.sparkContext.broadcast((query_ids, queries, probes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, cells = sent.value
        best = _Best(ids, q, k, exclude_self)
        asking = _asking(cells)
        for batch in batches:
            chunk_ids, x = batch.column("chunk_id").to_numpy(), decode(batch)
            if cells is None:
                best.add(chunk_ids, x)
                continue
            cell_of = batch.column("cell").to_numpy()
            for cell in np.unique(cell_of):
                here = cell_of == cell
                best.add(chunk_ids[here], x[here], asking.get(cell, NOBODY))
        yield from best.batches()

    return _merge(vectors.mapInArrow(scan, RESULT), k)


def _block_join(
    queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool, decode_column: str,
    decode: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Join of two large sides that carry a ``cell``: every query block of a cell meets every vector block of it.

    Cells are cut into blocks by their counts, so a cell that holds a third of all vectors becomes many equal tasks.
    """
    v_counts = vectors.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("nv"))
    q_counts = queries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("nq"))
    # One row per cell, a number the index sets.
    cut = stored(v_counts.join(q_counts, "cell"), "blocks")

    def block(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    q = queries.join(F.broadcast(cut), "cell").withColumn("bq", block("query_id", "nq")).withColumn("bv", every("nv"))
    v = vectors.join(F.broadcast(cut), "cell").withColumn("bv", block("chunk_id", "nv")).withColumn("bq", every("nq"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(left.column("query_id").to_numpy(), _matrix(left.column("asked")), k, exclude_self)
        if left.num_rows and right.num_rows:
            x = _matrix(right.column("stored"))
            best.add(right.column("chunk_id").to_numpy(), decode(x) if decode else x)
        return pa.Table.from_batches(best.batches(), pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64())]))

    keys = ["cell", "bq", "bv"]
    left = q.select(*keys, F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").alias("asked")).groupBy(*keys)
    right = v.select(*keys, F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col(decode_column).alias("stored")).groupBy(*keys)
    return _merge(left.cogroup(right).applyInArrow(meet, RESULT), k)


# ---- searches --------------------------------------------------------------------------------------------------


def search_exact(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, chunk_id, distance) of the k nearest ``vectors(chunk_id, embedding)``; ties by chunk id.

    ``exclude_self`` leaves out the chunk that has the query's own id.
    """
    vectors = vectors.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding")
    sent = _query_matrix(queries)
    if sent is not None:
        return _scan(vectors, *sent, k, exclude_self, lambda b: _matrix(b.column("embedding")))
    return search_blocks(queries, vectors, k, exclude_self)


def nearest_distance(vectors: DataFrame, few: DataFrame) -> DataFrame:
    """(chunk_id, distance) of each of ``vectors`` to the nearest of ``few(query_id, embedding)``.

    The few travel and the vectors stay, in one pass without a shuffle, if the few are within ``QUERY_BYTES``; else both
    are joined block by block.
    """
    sent = _query_matrix(few)
    if sent is None:
        swapped = vectors.select(F.col("chunk_id").alias("query_id"), "embedding")
        found = search_exact(swapped, few.select(F.col("query_id").alias("chunk_id"), "embedding"), 1)
        return found.select(F.col("query_id").alias("chunk_id"), "distance")
    shared = vectors.sparkSession.sparkContext.broadcast(sent[1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            if not len(x) or not len(q):
                continue
            best = np.full(len(x), np.inf)
            for lo in range(0, len(q), BLOCK_QUERIES):
                some = q[lo:lo + BLOCK_QUERIES]
                d = (x * x).sum(axis=1)[:, None] + (some * some).sum(axis=1)[None, :] - 2.0 * (x @ some.T)
                best = np.minimum(best, d.min(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), pa.array(np.round(np.maximum(best, 0.0), DIGITS))], names=["chunk_id", "distance"]
            )

    rows = vectors.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding")
    return rows.mapInArrow(scan, "chunk_id bigint, distance double")


def search_blocks(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """Exact search for query sets of any size: blocks of queries meet blocks of vectors, each pair in one task."""
    cell = F.lit(0).alias("cell")
    return _block_join(
        queries.select("query_id", "embedding", cell), vectors.select("chunk_id", "embedding", cell), k, exclude_self,
        "embedding",
    )


def fit_centroids(
    vectors: DataFrame, n_centroids: int, n_parts: int = 1, iterations: int = 8, seed: int = 0,
    train_share: float = 1.0,
) -> np.ndarray:
    """Lloyd's k-means for each of ``n_parts`` equal slices of the vectors: array (parts, centroids, slice width).

    All slices are trained in the same pass. A pass sends the centroids out and brings back one row of sums per
    (slice, centroid), whatever the number of vectors. ``train_share`` < 1 trains on a seeded share of them; every
    vector is still indexed.
    """
    rows = vectors.select("chunk_id", "embedding")
    if train_share < 1.0:
        rows = rows.filter(F.pmod(F.xxhash64(F.col("chunk_id"), F.lit(seed)), F.lit(1_000_000)) < int(train_share * 1_000_000))
    start = rows.orderBy(hash_order(F.col("chunk_id"), seed), "chunk_id").limit(n_centroids).toArrow()
    x = _matrix(start.column("embedding"))
    centroids = np.stack(np.split(x, n_parts, axis=1))
    if centroids.shape[1] < n_centroids:
        n_centroids = centroids.shape[1]
    for _ in range(iterations):
        sent = vectors.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            total, count = np.zeros_like(c), np.zeros(c.shape[:2])
            for batch in batches:
                for part, piece in enumerate(np.split(_matrix(batch.column("embedding")), n_parts, axis=1)):
                    near = nearest(piece, c[part])
                    np.add.at(total[part], near, piece)
                    np.add.at(count[part], near, 1.0)
            part, cell = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(part, pa.int32()), "cell": pa.array(cell, pa.int32()),
                "n": pa.array(count[part, cell], pa.float64()),
                "total": pa.array(list(total[part, cell]), pa.list_(pa.float64())),
            })

        width = centroids.shape[2]
        partial = rows.mapInArrow(sums, "part int, cell int, n double, total array<double>")
        merged = partial.groupBy("part", "cell").agg(
            F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(width)]
        ).toPandas()
        moved = centroids.copy()
        moved[merged["part"], merged["cell"]] = (
            merged[[f"s{i}" for i in range(width)]].to_numpy() / merged["n"].to_numpy()[:, None]
        )
        if np.allclose(moved, centroids, atol=1e-7):
            break
        centroids = moved
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row."""
    d = (centroids * centroids).sum(axis=1)[None, :] - 2.0 * (x @ centroids.T)
    return d.argmin(axis=1)


def assign_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors(chunk_id, embedding)`` with the ``cell`` of each; no shuffle. Write it partitioned by ``cell``."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema["embedding"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = nearest(_matrix(batch.column("embedding")), sent.value) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), batch.column("embedding"), pa.array(cells, pa.int32())],
                names=["chunk_id", "embedding", "cell"],
            )

    rows = vectors.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding")
    return rows.mapInArrow(assign, f"chunk_id bigint, embedding {kind}, cell int")


def _by_distance(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cells of each row, nearest first."""
    d = (centroids * centroids).sum(axis=1)[None, :] - 2.0 * (x @ centroids.T)
    return np.argsort(d, axis=1, kind="stable").astype(np.int32)


def calibrate_probes(
    queries: DataFrame, celled: DataFrame, centroids: np.ndarray, k: int, recall: float, exclude_self: bool = False
) -> int:
    """The fewest cells to probe that hold ``recall`` of the true k nearest of at most ``CALIBRATION`` queries.

    The queries are taken by hash of their id. Their true neighbours come from an exact search over all vectors; only
    the cell of each true neighbour, (CALIBRATION · k) rows, comes to the driver.
    """
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding")
    table = asked.orderBy(hash_order(F.col("query_id"), 0), "query_id").limit(CALIBRATION).toArrow()
    # Of several queries with one id the first is taken, as neighbours are told apart by id.
    ids, first = np.unique(table.column("query_id").to_numpy(), return_index=True)
    if not len(ids) or not len(centroids):
        return len(centroids)
    x = _matrix(table.column("embedding"))[first]
    true = _scan(celled, ids, x, k, exclude_self, lambda b: _matrix(b.column("embedding")))
    held = celled.select("chunk_id", "cell").join(F.broadcast(true.select("query_id", "chunk_id")), "chunk_id").toPandas()
    if held.empty:
        return len(centroids)
    order = _by_distance(x, centroids)[np.searchsorted(ids, held["query_id"].to_numpy())]
    place = (order == held["cell"].to_numpy()[:, None]).argmax(axis=1)
    found = np.bincount(place, minlength=len(centroids)).cumsum() / len(place)
    return int(np.argmax(found >= min(recall, 1.0))) + 1


def search_cells(
    queries: DataFrame, celled: DataFrame, centroids: np.ndarray, k: int, n_probe: int, exclude_self: bool = False
) -> DataFrame:
    """Approximate search: each query looks at the vectors of its ``n_probe`` nearest cells, with exact distances."""
    n_probe = min(n_probe, len(centroids))
    sent = _query_matrix(queries)

    def probe(x: np.ndarray) -> np.ndarray:
        return _by_distance(x, centroids)[:, :n_probe]

    if sent is not None:
        cells = probe(sent[1])
        wanted = celled.filter(F.col("cell").isin(*np.unique(cells).tolist()))
        return _scan(wanted, *sent, k, exclude_self, lambda b: _matrix(b.column("embedding")), cells)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = probe(_matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), batch.column("embedding"), pa.array(list(cells), pa.list_(pa.int32()))],
                names=["query_id", "embedding", "cells"],
            )

    kind = queries.schema["embedding"].dataType.simpleString()
    spread = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding").mapInArrow(
        probes, f"query_id bigint, embedding {kind}, cells array<int>"
    ).select("query_id", "embedding", F.explode("cells").alias("cell"))
    return _block_join(spread, celled, k, exclude_self, "embedding")


def encode_pq(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(chunk_id, codes): the nearest codeword of each slice; no shuffle."""
    sent = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = np.split(_matrix(batch.column("embedding")), len(books), axis=1)
            codes = np.stack([nearest(p, b) for p, b in zip(pieces, books)], axis=1).astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), pa.array(list(codes), pa.list_(pa.int16()))], names=["chunk_id", "codes"]
            )

    rows = vectors.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding")
    return rows.mapInArrow(encode, "chunk_id bigint, codes array<smallint>")


def decode_pq(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """Vectors spelled by the codes. Their distance to a query is the asymmetric distance."""
    codes = codes.astype(np.int64)
    return np.concatenate([book[codes[:, i]] for i, book in enumerate(codebooks)], axis=1)


def rescore(
    candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, small: bool = False, few: bool = False
) -> DataFrame:
    """Exact distances of candidate pairs, then the best k. Only the candidates' vectors take part.

    ``small`` says that the caller has bounded the candidates; the vectors are then filtered where they lie. ``few`` says
    that it has bounded the queries; then no pair is shuffled together with its vector.
    """
    gap = F.aggregate(
        F.zip_with(F.col("q"), F.col("x"), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))),
        F.lit(0.0), lambda s, d: s + d,
    )
    pairs = (
        broadcast_if(candidates.select("query_id", "chunk_id"), small)
        .join(vectors.select("chunk_id", F.col("embedding").alias("x")), "chunk_id")
        .join(broadcast_if(queries.select("query_id", F.col("embedding").alias("q")), few), "query_id")
    )
    return _merge(pairs.select("query_id", "chunk_id", F.round(gap, DIGITS).alias("distance")), k)


def search_pq(
    queries: DataFrame, vectors: DataFrame, codes: DataFrame, codebooks: np.ndarray, k: int, rescore_factor: int = 8,
    exclude_self: bool = False,
) -> DataFrame:
    """Approximate search over the codes; the best ``k * rescore_factor`` are scored again with the vectors.

    ``rescore_factor`` 0 returns the approximate distances.
    """
    wide = k * max(rescore_factor, 1)
    sent = _query_matrix(queries)
    if sent is not None:
        found = _scan(codes, *sent, wide, exclude_self, lambda b: decode_pq(_matrix(b.column("codes")), codebooks))
    else:
        cell = lambda df: df.withColumn("cell", F.lit(0))
        found = _block_join(cell(queries), cell(codes), wide, exclude_self, "codes", lambda c: decode_pq(c, codebooks))
    if not rescore_factor:
        return found
    return rescore(found, queries, vectors, k, sent is not None and len(sent[0]) * wide <= BROADCAST_ROWS, sent is not None)


@dataclass(frozen=True)
class CodedCells:
    """Inverted lists: ``codes(chunk_id, cell, codes, embedding)``, one byte for each slice of a vector's rest beyond its cell's centre.

    The vector itself lies beside its code, for the few that are scored exactly.
    """

    codes: DataFrame
    centroids: np.ndarray
    codebooks: np.ndarray


def fit_coded_cells(vectors: DataFrame, config: IndexConfig) -> CodedCells:
    """Cells by k-means, codebooks by k-means over the rests, and the code of every vector; written once."""
    centroids = fit_centroids(vectors, config.n_cells, train_share=config.train_share)[0]
    whole = vectors.schema["embedding"].dataType.simpleString()
    kind = f"chunk_id bigint, embedding array<double>, cell int, whole {whole}"

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                cells = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk_id"), pa.array(list(x - centroids[cells]), pa.list_(pa.float64())), pa.array(cells, pa.int32()),
                     batch.column("embedding")],
                    names=["chunk_id", "embedding", "cell", "whole"])

    rows = vectors.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding")
    rests = stored(rows.mapInArrow(rest, kind), "rests")
    if config.pq_bits > 8:
        raise ValueError("a code is one byte; pq_bits must be at most 8")
    books = fit_centroids(rests, 2 ** config.pq_bits, config.pq_m, train_share=config.train_share)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pieces = np.split(_matrix(batch.column("embedding")), len(books), axis=1)
                codes = np.stack([nearest(p, b) for p, b in zip(pieces, books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk_id"), batch.column("cell"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("whole")],
                    names=["chunk_id", "cell", "codes", "embedding"])

    coded = rests.mapInArrow(encode, f"chunk_id bigint, cell int, codes binary, embedding {whole}")
    return CodedCells(stored(coded, "codes"), centroids, books)


def search_coded_cells(
    queries: DataFrame, vectors: DataFrame, index: CodedCells, k: int, n_probe: int, rescore_factor: int = 8, exclude_self: bool = False
) -> DataFrame:
    """Approximate search over the codes of the ``n_probe`` nearest cells; the best ``k * rescore_factor`` are scored exactly.

    They are the best of each ``CODE_ROWS`` codes that a task reads and are scored there, so only ``k`` rows a query leave a task.

    A query makes one table for each cell it looks at: the distance of each slice to each codeword. A vector's distance
    is a sum of table entries chosen by its bytes; no vector is spelled out. Query sets beyond ``QUERY_BYTES``
    look at the vectors of their cells themselves, block by block.
    """
    sent = _query_matrix(queries)
    n_probe = min(n_probe, len(index.centroids))
    if sent is None:
        return search_cells(queries, assign_cells(vectors, index.centroids), index.centroids, k, n_probe, exclude_self)
    ids, x = sent
    wide = k * max(rescore_factor, 1)
    probes = _by_distance(x, index.centroids)[:, :n_probe] if len(ids) else np.zeros((0, n_probe), np.int32)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, x, probes, index.centroids, index.codebooks))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, probes, centroids, books = shared.value
        best = _Best(ids, x, k, exclude_self)
        asking = _asking(probes)
        norms = (books * books).sum(axis=2)

        def read(cell_of: np.ndarray, chunk_ids: np.ndarray, codes: np.ndarray, whole: np.ndarray) -> None:
            order = np.argsort(cell_of, kind="stable")
            chunk_ids, codes, whole = chunk_ids[order], codes[order], whole[order]
            cells, start = np.unique(cell_of[order], return_index=True)
            for lo in range(0, len(ids), CODE_QUERIES):
                # The place of a vector stands for its id.
                near = _Best(ids[lo:lo + CODE_QUERIES], x[lo:lo + CODE_QUERIES], wide, False)
                for cell, first, end in zip(cells.tolist(), start, [*start[1:], len(order)]):
                    every = asking.get(cell, NOBODY)
                    rows = every[np.searchsorted(every, lo):np.searchsorted(every, lo + CODE_QUERIES)]
                    if not len(rows):
                        continue
                    slices = np.stack(np.split(x[rows] - centroids[cell], len(books), axis=1))
                    # (slice, codeword, query): the entries of one codeword for all queries lie together.
                    table = norms[:, :, None] - 2.0 * books @ slices.transpose(0, 2, 1) + (slices * slices).sum(axis=2)[:, None, :]
                    for at in range(first, end, CODE_STEP):
                        some = slice(at, min(at + CODE_STEP, end))
                        d = table[0][codes[some, 0]]
                        for j in range(1, len(books)):
                            d += table[j][codes[some, j]]
                        if exclude_self:
                            own = np.flatnonzero(np.isin(chunk_ids[some], ids[rows]))
                            which, who = np.nonzero(chunk_ids[some][own, None] == ids[None, rows])
                            d[own[which], who] = np.inf
                        near.offer(np.arange(some.start, some.stop), d.T, rows - lo)
                row, place = np.nonzero(np.isfinite(near.dist))
                found, gap = near.chunk[row, place], near.dist[row, place]
                if rescore_factor:
                    gap = np.concatenate([np.zeros(0)] + [
                        ((x[lo + row[i:i + CODE_ROWS // 8]] - whole[found[i:i + CODE_ROWS // 8]]) ** 2).sum(axis=1)
                        for i in range(0, len(row), CODE_ROWS // 8)])
                best.take(lo + row, chunk_ids[found], gap)

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, len(books))
                held.append((batch.column("cell").to_numpy(), batch.column("chunk_id").to_numpy(), codes, _matrix(batch.column("embedding"))))
                n += batch.num_rows
            if n >= CODE_ROWS:
                read(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            read(*map(np.concatenate, zip(*held)))
        yield from best.batches()

    wanted = index.codes.filter(F.col("cell").isin(*np.unique(probes).tolist())) if len(ids) else index.codes
    return _merge(wanted.mapInArrow(scan, RESULT), k)


def search(
    queries: DataFrame, vectors: DataFrame, k: int, config: IndexConfig | None = None, exclude_self: bool = False
) -> DataFrame:
    """Build and search in one call, by ``config.index_type``."""
    config = config or IndexConfig(index_type="exact")
    if config.index_type == "exact":
        return search_exact(queries, vectors, k, exclude_self)
    if config.index_type == "hnsw":
        centroids = fit_centroids(vectors, config.n_cells, train_share=config.train_share)[0]
        celled = assign_cells(vectors, centroids)
        n_probe = config.n_probe
        if n_probe is None:
            n_probe = calibrate_probes(queries, celled, centroids, k, config.recall, exclude_self)
        return search_cells(queries, celled, centroids, k, n_probe, exclude_self)
    coded = fit_coded_cells(vectors, config)
    n_probe = config.n_probe
    if n_probe is None:
        n_probe = calibrate_probes(queries, assign_cells(vectors, coded.centroids), coded.centroids, k, config.recall, exclude_self)
    return search_coded_cells(queries, vectors, coded, k, n_probe, config.rescore, exclude_self)


# ---- chunk table -----------------------------------------------------------------------------------------------


def chunk_table(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk_id, text_content, metadata, embedding): the stored form of a dense index."""
    metadata = F.struct("source_name", "associated_dates", "chunk_id").alias("metadata")
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id").select(
        "chunk_id", "text_content", metadata, "embedding"
    )


def append_new(rows: DataFrame, path: str) -> None:
    """Append the rows whose chunk id the table at ``path`` does not hold yet; the table is made if it is not there.

    Of several rows with one id the one with the smallest hash of all columns is kept.
    """
    spark = rows.sparkSession
    one = rows.groupBy("chunk_id").agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("r")).select("r.*")
    try:
        stored_ids = spark.read.parquet(path).select("chunk_id")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        one.write.parquet(path)
        return
    one.join(stored_ids, "chunk_id", "left_anti").write.mode("append").parquet(path)


def fetch(ids: DataFrame, chunks: DataFrame, small: bool = False, strict: bool = False) -> DataFrame:
    """``ids`` with the columns of the chunks they name. Ids without a chunk are dropped, or an error if ``strict``.

    ``small`` says that the caller has bounded ``ids``; the chunks are then filtered where they lie.
    """
    if strict:
        named = chunks.withColumn("_there", F.lit(True))
        found = ids.join(named, "chunk_id", "left")
        missing = F.raise_error(F.concat(F.lit("no chunk with id "), F.col("chunk_id").cast("string")))
        return found.filter(F.when(F.col("_there").isNull(), missing.cast("boolean")).otherwise(F.lit(True))).drop("_there")
    return chunks.join(F.broadcast(ids) if small else ids, "chunk_id")
