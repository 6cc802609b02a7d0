"""Vectors as tab-separated text, one per line, without ids."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import with_line_numbers


def write(vectors: DataFrame, path: str, mode: str = "append") -> None:
    """``vectors(embedding)`` with eight decimals, appended by default, in the order of the frame.

    Every call writes a ``batch=`` folder of its own; the folders' numbers rise with the time of the call, so that all
    lines of a later call follow those of an earlier one when read.
    """
    cells = F.transform("embedding", lambda x: F.format_string("%.8f", x.cast("double")))
    if mode != "append":
        vectors.sparkSession.createDataFrame([], "value string").write.mode(mode).text(path)
    vectors.select(F.array_join(cells, "\t").alias("value")).write.text(f"{path}/batch={time.time_ns():020d}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, embedding); the line number stands in for the missing id."""
    lines = with_line_numbers(spark.read.text(path), "row_no")
    cells = F.transform(F.split("value", "\t"), lambda x: x.cast("float"))
    return lines.select("row_no", cells.alias("embedding"))


def align(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pair the rows and the vectors of equal ``row_no``; the longer side loses its tail."""
    return rows.join(vectors, "row_no")
