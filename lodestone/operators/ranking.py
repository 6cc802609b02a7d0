"""Top-k, exact global numbering and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import work_path

# A side is broadcast by hand only if it was found to have at most this many rows of a few numbers each, or at most
# this many bytes where it holds text.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def fits(table: DataFrame, text: str, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table of one text column and a few numbers is within ``limit`` bytes; one aggregate over it."""
    size = table.agg(F.sum(F.octet_length(text) + 48)).head()[0]
    return (size or 0) <= limit


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast hint if the caller has checked the size, else leave the join to Spark."""
    return F.broadcast(df) if small else df


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark prunes to k per key within each task before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def running_number(df: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """Exact 0-based position in the order (bucket, *order), without sorting everything in one task.

    ``bucket`` must rise with the order and cut it into moderate pieces, and not too many of them. Each bucket is numbered in its own task and
    shifted by the rows of the earlier buckets; only one (bucket, count) row per bucket meets in a single task.
    """
    cut = df.withColumn("_bucket", bucket)
    counts = cut.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1
    return (
        cut.withColumn("_inside", inside)
        .join(offsets, "_bucket")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_before", "_inside")
    )


def global_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Exact 0-based position of each row in the order of columns that tell all rows apart.

    The rows are written once as range-sorted files, which cuts any key, however frequent its first column's values
    are; a row's position is the rows of the earlier files plus its place in its own file. Only one row per file is
    ever sorted in a single task.
    """
    path = work_path(df.sparkSession, "ordered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    placed = df.sparkSession.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    # Range partition i is file "part-i"; the number sorts beyond five digits, the name does not.
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("bigint")
    counts = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    earlier = W.orderBy(part, "_file").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(starts, "_file").withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def hash_order(key: Column, seed: int) -> Column:
    """Seeded pseudo-random sort key, equal on every run and in other SQL engines."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
