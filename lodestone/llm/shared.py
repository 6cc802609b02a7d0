"""Helpers of the training-text operators: table access, Arrow mapping, word hashing and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

# Byte classes: white space is 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_rows(df: DataFrame, each: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``each`` over the rows of every task as dictionaries; results leave in Arrow batches of about 8 MB of payload."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for i in range(batch.num_rows):
                    yield {n: c[i].as_py() for n, c in zip(batch.schema.names, columns)}

        held: list[dict] = []
        weight = 0
        for row in each(rows()):
            held.append(row)
            weight += 64 + sum(8 * len(v) if not isinstance(v, (str, bytes)) else len(v) for v in row.values() if hasattr(v, "__len__"))
            if weight > 8 << 20 or len(held) >= 10_000:
                yield pa.RecordBatch.from_pylist(held, schema=target)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=target)

    return df.mapInArrow(run, kind)


def task_row_prefix() -> int:
    """Distinct high bits for each task of a stage; a repeated task over the same split gets the same ones."""
    return TaskContext.get().partitionId() << 34


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Bytes that are hashed at once.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_HELD: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _HELD.get(base)
    if held is None or len(held) <= n:
        held = np.full(max(n, PIECE + 4_096) + 1, base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 2 * PIECE:
            _HELD[base] = held
    return held[: n + 1]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased texts, and the words of each text.

    All texts go through array operations together: a polynomial hash modulo 2^64 over per-byte random values, taken
    for each word as a difference of prefix sums. Equal words have equal hashes; among ten billion distinct words
    fewer than three pairs are expected to share one.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts, words, low = [], [], 0
    while low < len(joined):
        high = min(low + PIECE, len(joined))
        while not SPACE[joined[high - 1]]:  # the last byte is a blank; a word is never cut
            high += 1
        piece = joined[low:high]
        inside = ~SPACE[piece]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        prefix = np.empty(len(piece) + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum(_BYTE[LOWER[piece]] * _powers(_BASE, len(piece) - 1), out=prefix[1:])
        words.append(mix64((prefix[end] - prefix[start]) * _powers(_INVERSE, len(piece))[start]))
        starts.append(start + low)
        low = high
    stops = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(np.concatenate(starts), stops)))) if texts else np.zeros(0, dtype=np.int64)
    return np.concatenate(words), counts


def text_batches(rows: Iterator[dict], text: str, limit: int = 4 << 20) -> Iterator[tuple[list[dict], list[bytes]]]:
    """Rows in groups of about ``limit`` bytes of text, with the texts as bytes (null: empty)."""
    held, texts, size = [], [], 0
    for row in rows:
        t = (row.pop(text) or "").encode("utf-8", "surrogatepass")
        held.append(row)
        texts.append(t)
        size += len(t) + 64
        if size >= limit:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable from each node over the undirected ``edges`` (a, b).

    Alternating large-star and small-star steps. Each keeps the number of edges within the input's and each is written
    to the shared folder, so an executor that is lost costs one step. The rounds needed grow with the logarithm of the
    longest path. A node of very many edges is a join key, which Spark splits, and a minimum, which is combined before
    the shuffle; its edges never meet in one task.
    """
    spark = edges.sparkSession
    current = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name
    )

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        """Ties each neighbour of a node (larger ones, or the node and its smaller ones) to the smallest of all."""
        both = pairs if small else pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        tied = both.join(least, "a")
        if small:
            moved = tied.select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
        else:
            moved = tied.filter("b > a").select(F.col("b").alias("x"), "m")
        return moved.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    def print_of(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    before = print_of(current)
    while before[0]:
        current = stored(star(star(current, small=False), small=True), name)
        after = print_of(current)
        if after == before:
            break
        before = after
    hubs = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(hubs)
