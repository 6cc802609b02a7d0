"""The roles that the given tables play: chunks, questions, vectors, pages, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A scan of at most this many bytes may be spread over the cores; moving more costs more than waiting.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a small scan over all cores, if it has fewer splits than that; others are left where they are."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_name"), F.col("text").alias("text_content")
    )
    return spread(rows, "chunk_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), "chunk_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn that the next turn answers: (conv_id, turn, question, answer)."""
    said = turns(spark, sf_dir)
    answers = said.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    asked = said.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    return asked.join(answers, ["conv_id", "turn"])
