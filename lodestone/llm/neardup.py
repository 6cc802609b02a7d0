"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import at_most, broadcast_if
from ..session import stored
from .shared import components, mix64
from .vectors import directions, matrix, usable

# Tables of buckets, projections of a bucket and their width. On unit vectors, a pair at cosine 0.9 (distance 0.447) has
# a projection in common with probability 0.82 and a bucket of 12 with 0.095: 40 tables find it with 0.98, a pair at
# 0.95 with 0.9998; unrelated vectors share a bucket with 0.0003.
TABLES, PROJECTIONS, WIDTH = 40, 12, 2.0
SEED = 20_240_229
# Members of a bucket that are compared in one task; larger buckets are cut and all pairs of cuts are compared.
CUT = 2_048
BROADCAST_ROWS = 200_000


def marks(x: np.ndarray) -> np.ndarray:
    """The 32-bit bucket of each unit vector in each table: floor((a.x + b) / width) over Gaussian projections a."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    a = rng.standard_normal((x.shape[1], TABLES * PROJECTIONS))
    b = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), TABLES, PROJECTIONS)
    factors = mix64(np.arange(1, PROJECTIONS + 1, dtype=np.uint64)) | np.uint64(1)
    return (mix64((cells * factors).sum(axis=2, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _pairs(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, table: int, cosine: float, same: bool):
    """Positions of pairs at ``cosine`` or nearer that share no bucket in an earlier table, tile by tile."""
    for i in range(0, len(x), 1_024):
        for j in range(i if same else 0, len(y), 1_024):
            a, b = np.nonzero(x[i: i + 1_024] @ y[j: j + 1_024].T >= cosine)
            a, b = a + i, b + j
            if same:
                a, b = a[a < b], b[a < b]
            for start in range(0, len(a), 1 << 17):
                p, q = a[start: start + (1 << 17)], b[start: start + (1 << 17)]
                fresh = ~(mx[p, :table] == my[q, :table]).any(axis=1)
                yield p[fresh], q[fresh]


def _bucket(rows: list, table: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, label) of a bucket's rows: other vectors newly linked, and the smallest id tied to each in here."""
    ids, counts, sides, vecs, codes = zip(*rows)
    ids, counts, sides = np.array(ids), np.array(counts), np.array(sides)
    x = directions(matrix(list(vecs), dim))
    m = np.frombuffer(b"".join(codes), dtype=np.int32).reshape(len(ids), TABLES)
    two = sides.any()
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1) if two else np.flatnonzero(sides == 0)
    links, label = np.zeros(len(ids), dtype=np.int64), ids.copy()
    for p, q in _pairs(x[left], x[right], m[left], m[right], table, cosine, not two):
        p, q = left[p], right[q]
        links += np.bincount(p, counts[q], len(ids)).astype(np.int64) + np.bincount(q, counts[p], len(ids)).astype(np.int64)
        while (label[p] != label[q]).any():
            least = np.minimum(label[p], label[q])
            old = label.copy()
            np.minimum.at(label, p, least)
            np.minimum.at(label, q, least)
            # Whatever carried a replaced label follows it.
            moved = old != label
            follow = dict(sorted(zip(old[moved].tolist(), label[moved].tolist()), reverse=True))
            label = np.array([follow.get(v, v) for v in label.tolist()])
    return ids, links, label


def near_duplicates(df: DataFrame, key: str, vector: str, cosine: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) of each row: other vectors at ``cosine`` or nearer, and whom they lead to.

    Cosines are taken in double precision and decide alone; hashing finds the pairs to check. Vectors that are null,
    empty, zero or hold null or non-finite numbers, and rows without a key, link with nothing, as do vectors of
    different lengths. Without a link the component is the row's own key. ``kept`` marks the smallest key of each
    component. Rows of one key count as one thing: they share their links and their component. Other columns are not read.

    Equal vectors collapse first and count with their number. A unit vector goes to one bucket per table; buckets are
    read as sorted runs, those of very many members are cut, and each run yields sums and one hub per member, never
    its pairs. A pair counts in the first table that holds it.
    """
    base = usable(df, key, vector)
    once = base.groupBy("dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                codes = marks(directions(matrix(part.column(1), int(dim))))
                listed = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(codes) + 1, dtype=np.int32) * TABLES), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, listed, pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["dim", "vec", "id", "copies", "marks", "codes"])

    signed = stored(once.mapInArrow(
        sign, "dim int, vec binary, id bigint, copies bigint, marks array<int>, codes binary"), "near-signed")
    places = signed.select("dim", F.posexplode("marks").alias("table", "mark"))
    crowds = stored(places.groupBy("dim", "table", "mark").count().filter(F.col("count") > 1), "near-buckets")
    sent = signed.select("dim", "vec", "id", "copies", "codes", F.posexplode("marks").alias("table", "mark")).join(
        broadcast_if(crowds, at_most(crowds, BROADCAST_ROWS)), ["dim", "table", "mark"])
    cuts = F.ceil(F.col("count") / CUT).cast("int")
    own = F.pmod(F.xxhash64("id"), cuts).cast("int")
    # In cut c of several, a row meets the later cuts as side 0 and the earlier as side 1.
    spots = F.transform(F.sequence(F.lit(0), cuts - 1), lambda o: F.struct(
        F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), (own > o).cast("int").alias("side")))
    spread = sent.withColumn("spot", F.explode(spots)).select(
        "dim", "table", "mark", "spot.i", "spot.j", "spot.side", "id", "copies", "vec", "codes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = [], None, []

        def done() -> pa.RecordBatch:
            ids, links, label = (np.concatenate(c) for c in zip(*out))
            out.clear()
            some = links > 0
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(label[some])], names=["id", "links", "hub"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            rows = list(zip(*(batch.column(i).to_pylist() for i in (6, 7, 5, 8, 9))))
            for k, r in zip(keys, rows):
                if k != at:
                    if len(held) > 1:
                        out.append(_bucket(held, at[1], at[0], cosine))
                    held, at = [], k
                held.append(r)
            if out:
                yield done()
        if len(held) > 1:
            out.append(_bucket(held, at[1], at[0], cosine))
            yield done()

    order = ["dim", "table", "mark", "i", "j"]
    found = stored(spread.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        compare, "id bigint, links bigint, hub bigint"), "near-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    twice = base.groupBy("id").agg(F.min("vec").alias("a"), F.max("vec").alias("b")).filter("a <> b").select("id")
    classes = base.join(once.select("dim", "vec", F.col("id").alias("first"), "copies"), ["dim", "vec"])
    tied = classes.join(twice, "id", "left_semi").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    groups = components(found.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).union(tied), "near-groups")
    groups = stored(groups, "near-groups")
    placed = (
        classes.join(links.withColumnRenamed("id", "first"), "first", "left")
        .join(groups.select(F.col("node").alias("first"), "component"), "first", "left")
        .select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    )
    # Rows that take no part: one for each row that ``usable`` left out.
    counted = df.select(F.col(key).alias("id")).groupBy("id").agg(F.count("*").alias("rows"))
    taking = base.groupBy("id").agg(F.count("*").alias("part"))
    alone = counted.join(taking, counted.id.eqNullSafe(taking.id), "left").select(
        counted.id, F.explode(F.when(F.col("rows") > F.coalesce("part", F.lit(0)), F.sequence(F.lit(1).cast("bigint"), F.col("rows") - F.coalesce("part", F.lit(0))))).alias("one")
    ).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return placed.union(alone).select(
        F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
