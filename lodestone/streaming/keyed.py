"""A table that takes each chunk id once, with a small Bloom summary beside every file group.

Layout below the sink: ``rows/batch_id=n/bucket=b`` holds the rows, buckets by the hash of the id; ``summaries/batch_id=n``
holds, for each cell of hash values that the batch wrote to, 32,768 bits in which every id sets ``PROBES``; ``layout`` holds
the two counts that all batches share. A batch asks the summaries first and reads only the row groups that
may hold one of its ids, and of them only the id column. There is no stream state. Several jobs may append in turn, not at
the same time, if they number their batches apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .ingest import Transform
from ..operators.ranking import at_most, broadcast_if

BUCKETS = 64
# Bits of a summary: what the bitmap functions make of one group.
BITS = 32_768
PROBES = 4
# Ids of a cell for which about one of 400 absent ids looks present; more ids cost reads, never rows.
CELL_IDS = 2_048
BROADCAST_IDS = 200_000


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def create(spark: SparkSession, sink: str, buckets: int = BUCKETS, ids_per_batch: int = 1_000_000) -> tuple[int, int]:
    """(buckets, cells) of the sink; they are fixed when it is first used. ``ids_per_batch`` sets the size of summaries."""
    path = f"{sink}/layout"
    if not _exists(spark, f"{path}/_SUCCESS"):
        per_bucket = max(1, -(-ids_per_batch // (buckets * CELL_IDS)))
        layout = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(buckets * per_bucket).alias("cells"))
        layout.coalesce(1).write.mode("overwrite").parquet(path)
    return tuple(spark.read.schema("buckets int, cells int").parquet(path).head())


def _cell(key: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells)).cast("int")


def _bits(key: Column) -> Column:
    """The places that an id sets in its cell."""
    return F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda i: F.pmod(F.xxhash64(i, key), F.lit(BITS)))


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def _summarize(written: DataFrame, cells: int) -> DataFrame:
    """(cell, bits) of the ids of one batch."""
    places = written.select(_cell(F.col("chunk_id"), cells).alias("cell"), F.explode(_bits(F.col("chunk_id"))).alias("place"))
    return places.groupBy("cell").agg(F.bitmap_construct_agg("place").alias("bits"))


def groups_to_read(ids: DataFrame, sink: str, batch_id: int | None = None) -> tuple[DataFrame, list[str]]:
    """``ids(chunk_id)`` that the sink may hold, with (chunk_id, batch_id, bucket), and the folders to be read for them.

    Ids that no summary knows are not in the table. Rows of ``batch_id`` itself are left out: a batch that runs again replaces them.
    """
    spark = ids.sparkSession
    buckets, cells = create(spark, sink)
    schema = "cell int, bits binary, batch_id bigint"
    if not _exists(spark, f"{sink}/summaries"):
        return ids.limit(0).select("chunk_id", F.lit(0).alias("batch_id"), F.lit(0).alias("bucket")), []
    summaries = spark.read.schema(schema).parquet(f"{sink}/summaries")
    if batch_id is not None:
        summaries = summaries.filter(F.col("batch_id") != batch_id)
    asked = ids.select("chunk_id", _cell(F.col("chunk_id"), cells).alias("cell"))
    known = F.forall(_bits(F.col("chunk_id")), lambda p: _is_set(F.col("bits"), p))
    maybe = asked.join(summaries, "cell").filter(known).select(
        "chunk_id", "batch_id", (F.col("cell") % buckets).alias("bucket"))
    folders = [f"{sink}/rows/batch_id={r.batch_id}/bucket={r.bucket}" for r in maybe.select("batch_id", "bucket").distinct().collect()]
    return maybe, sorted(folders)


def append(batch: DataFrame, transform: Transform, sink: str, batch_id: int, buckets: int = BUCKETS, ids_per_batch: int = 1_000_000) -> None:
    """Add the rows of ``batch`` whose ``chunk_id`` the sink does not have, one each, through ``transform``.

    A row without an id is left out. ``batch_id`` names the batch: run again, also after a failure at any point, it replaces what it had
    written. ``transform`` must keep ``chunk_id`` and sees only rows that are new.
    """
    spark = batch.sparkSession
    buckets, cells = create(spark, sink, buckets, ids_per_batch)
    fresh = batch.filter("chunk_id is not null").dropDuplicates(["chunk_id"])
    maybe, folders = groups_to_read(fresh.select("chunk_id"), sink, batch_id)
    if folders:
        held = spark.read.schema("chunk_id bigint").parquet(*folders).join(
            maybe.select("chunk_id").distinct(), "chunk_id", "left_semi")
        fresh = fresh.join(broadcast_if(held, at_most(held, BROADCAST_IDS)), "chunk_id", "left_anti")
    rows = transform(fresh).withColumn("bucket", _cell(F.col("chunk_id"), cells) % buckets)
    path = f"{sink}/rows/batch_id={batch_id}"
    # One file a bucket, however many tasks made the rows; the hash deals a hot range of ids evenly.
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    written = spark.read.schema("chunk_id bigint").parquet(path)
    _summarize(written, cells).write.mode("overwrite").parquet(f"{sink}/summaries/batch_id={batch_id}")


def read(spark: SparkSession, sink: str) -> DataFrame:
    """The table, without the columns of its layout. A batch whose summary is not there yet is not finished and is left out."""
    done = spark.read.schema("batch_id bigint").parquet(f"{sink}/summaries").select("batch_id").distinct()
    return spark.read.parquet(f"{sink}/rows").join(done, "batch_id", "left_semi").drop("batch_id", "bucket")


def start(
    rows: DataFrame, transform: Transform, sink: str, checkpoint: str, available_now: bool = True, buckets: int = BUCKETS,
    ids_per_batch: int = 1_000_000,
) -> StreamingQuery:
    """``append`` for every batch of a stream."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append(batch, transform, sink, batch_id, buckets, ids_per_batch)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
