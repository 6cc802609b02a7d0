"""JSON-lines files of contexts, questions, answers, pairs and page records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .lines import with_line_numbers
from .. import schemas


def read_json(
    spark: SparkSession, path: str, schema: StructType, strict: bool = False, corrupt: str | None = None
) -> DataFrame:
    """Rows of a JSON-lines file. Broken lines are an error if ``strict``, else rows of NULLs.

    With ``corrupt`` such rows carry their line in a column of that name, which is NULL in all others.
    """
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if corrupt:
        schema = StructType(schema.fields + [StructField(corrupt, StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).json(path)


def text_of(raw: Column) -> Column:
    """Text that may have been a JSON list of strings: the list is joined by spaces."""
    items = F.from_json(raw, "array<string>")
    return F.when(raw.startswith("["), F.coalesce(F.array_join(items, " "), raw)).otherwise(raw)


def read_contexts(spark: SparkSession, path: str, numbered: bool = False, strict: bool = False) -> DataFrame:
    """Context chunks: ids as BIGINT, list texts joined; ``numbered`` adds ``line_no``."""
    rows = read_json(spark, path, schemas.CONTEXT_FILE, strict)
    if numbered:
        rows = with_line_numbers(rows)
    return rows.withColumns({
        "chunk_id": F.col("chunk_id").try_cast("bigint"), "text_content": text_of(F.col("text_content"))
    })


def read_questions(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Labelled questions with their gold chunk; ids as BIGINT."""
    rows = read_json(spark, path, schemas.QUESTION_FILE, strict)
    return rows.withColumns({c: F.col(c).try_cast("bigint") for c in ("question_id", "chunk_id")})


def read_training(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return read_json(spark, path, schemas.TRAINING_EXAMPLE, strict)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 JSON lines; NULL fields are left out, as in page records without dates."""
    df.write.mode(mode).json(path)


def write_answers(answers: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Answer records with exactly the columns of ``schemas.ANSWER``."""
    write_json(answers.select(*[f.name for f in schemas.ANSWER.fields]), path, mode)


def write_entries_and_pairs(entries: DataFrame, pairs_path: str, entries_path: str, keep: list[str]) -> None:
    """Two outputs of one generation pass: the enriched contexts are written, and the pairs derived from that file's rows.

    The model has run once when the first file is there; the second reads it back.
    """
    from ..operators.trainset import qa_pairs

    entries.write.parquet(f"{entries_path}.parts")
    kept = entries.sparkSession.read.schema(entries.schema).parquet(f"{entries_path}.parts")
    write_json(kept.drop("line_no"), entries_path)
    write_json(qa_pairs(kept, keep).drop("n_dropped"), pairs_path)
