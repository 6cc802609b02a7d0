"""Stored form of the dense index: one Parquet table of chunks with vectors and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_chunk_table(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table with a ``cell`` column is written partitioned by it, so a search reads the probed cells only."""
    writer = table.write.mode(mode)
    (writer.partitionBy("cell") if "cell" in table.columns else writer).parquet(path)


def load_chunk_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
