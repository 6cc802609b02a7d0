"""Text lines whose order is their identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import strip


def with_line_numbers(df: DataFrame, name: str = "line_no") -> DataFrame:
    """Add the 0-based line number over all files, to a frame read straight from text or JSON files.

    Files follow by the number of their ``batch=`` folder, then by the number of their ``part-`` name, then by path.

    Each file block counts its lines in its own task. Only one row per block is sorted to find where a block starts,
    so the lines themselves are not brought together.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    blocks = placed.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    number = lambda pattern: F.nullif(F.regexp_extract("_path", pattern, 1), F.lit("")).cast("bigint")
    order = [number(r"/batch=(\d+)/[^/]*$"), number(r"/part-(\d+)[^/]*$"), F.col("_path"), F.col("_block")]
    earlier = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("_path", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        placed.join(starts, ["_path", "_block"])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_path", "_block", "_at", "_first", "_before")
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, question): stripped lines of a text file; blank lines are kept."""
    lines = with_line_numbers(spark.read.text(path))
    return lines.select("line_no", strip("value").alias("question"))


def write_answers(answers: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> None:
    """One answer per line in ``line_no`` order; ``answers(line_no, answer)``.

    Sorted files follow each other by name. ``single_file`` is for small outputs only.
    """
    ordered = answers.orderBy("line_no").select("answer")
    (ordered.coalesce(1) if single_file else ordered).write.mode(mode).text(path)
