"""Incremental ingestion: new context files become embedded rows of the chunk table, once per chunk id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Transform = Callable[[DataFrame], DataFrame]


def read_stream(
    spark: SparkSession, path: str, schema: StructType, format: str = "json", glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream; each file is read once."""
    reader = spark.readStream.schema(schema).format(format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def start(
    rows: DataFrame, transform: Transform, sink: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append ``transform(rows)`` to the table at ``sink``, one row per ``chunk_id``.

    Ids seen before are dropped by keyed stream state, before the (costly) transform runs. The file sink commits each
    batch with the checkpoint, so a restart repeats nothing and loses nothing. The keys are spread by hash.
    """
    fresh = rows.dropDuplicates(["chunk_id"])
    writer = (
        transform(fresh).writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_against_sink(
    rows: DataFrame, transform: Transform, sink: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Like ``start``, without state: each batch leaves out the ids the table already has.

    For tables that other jobs append to as well. A batch overwrites its own ``batch_id`` folder, so a batch that is
    run again after a failure replaces what it had written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["chunk_id"])
        root = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            held = spark.read.schema("chunk_id bigint, batch_id bigint").option("basePath", sink).parquet(sink)
            fresh = fresh.join(held.filter(F.col("batch_id") != batch_id).select("chunk_id"), "chunk_id", "left_anti")
        transform(fresh).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
