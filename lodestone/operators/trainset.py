"""Synthetic question/answer pairs and the training set made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import infer
from .ranking import global_number, hash_order, running_number
from ..config import SPLIT_SEED, TEST_SHARE
from ..functions import prompts
from ..functions.text import last_section, parse_qa_pairs, render


def line_slice(df: DataFrame, start: int, end: int, line: str = "line_no") -> DataFrame:
    """Rows whose line number is in [start, end)."""
    return df.filter((F.col(line) >= start) & (F.col(line) < end))


def generate_entries(
    contexts: DataFrame, generator: infer.Factory, template: str = prompts.QA_GENERATION, batch_size: int = 16
) -> DataFrame:
    """``contexts(line_no, ..., text_content)`` plus ``questions`` and ``answers`` parsed from a model's output.

    Contexts without text are skipped.
    """
    asked = contexts.filter(F.length("text_content") > 0).withColumn("_prompt", render(template, context="text_content"))
    said = infer.run(asked, generator, "_prompt", "_said", "string", batch_size)
    return with_qa(said.drop("_prompt"), "_said").drop("_said")


def with_qa(df: DataFrame, text: str) -> DataFrame:
    """Add ``questions`` and ``answers`` out of the last section of generated text."""
    return df.withColumn("_qa", parse_qa_pairs(last_section(text))).withColumns(
        {"questions": F.col("_qa.questions"), "answers": F.col("_qa.answers")}
    ).drop("_qa")


def qa_pairs(entries: DataFrame, keep: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per pair, with a running ``question_id`` from 1 in the order of the entries (``line_no`` by default).

    Pairs are zipped to the shorter list; ``n_dropped`` tells what the longer list had too much.
    """
    order = order or ["line_no"]
    n = F.least(F.size("questions"), F.size("answers"))
    zipped = F.arrays_zip(
        F.slice("questions", F.lit(1), n).alias("question"), F.slice("answers", F.lit(1), n).alias("gt_answer")
    )
    pairs = entries.withColumn("n_dropped", F.abs(F.size("questions") - F.size("answers"))).select(
        *keep, *[c for c in order if c not in keep], "n_dropped", F.posexplode(zipped).alias("_pos", "_qa")
    )
    return global_number(pairs, [*order, "_pos"], "question_id").select(
        *keep, (F.col("question_id") + 1).alias("question_id"), F.col("_qa.question").alias("question"),
        F.col("_qa.gt_answer").alias("gt_answer"), "n_dropped",
    )


def join_context(qa: DataFrame, chunks: DataFrame) -> DataFrame:
    """Training examples (question_id, question, answer, text_content): each pair with the text it came from."""
    return qa.join(chunks.select("chunk_id", "text_content"), "chunk_id").select(
        "question_id", "chunk_id", "question", F.col("gt_answer").alias("answer"), "text_content"
    )


def format_examples(
    examples: DataFrame, template: str = prompts.TRAINING, instruction: str = prompts.TRAINING_INSTRUCTION,
    end: str = prompts.END_OF_TEXT,
) -> DataFrame:
    """Add ``text``: the filled training template and the end token."""
    text = render(template, instruction=F.lit(instruction), context="text_content", question="question", answer="answer")
    return examples.withColumn("text", F.concat(text, F.lit(end)))


def seeded_position(df: DataFrame, key: Column, seed: int, name: str) -> DataFrame:
    """Add the 0-based position of each row in a seeded permutation.

    Rows are ordered by a hash of their key; its first four hex digits cut them into at most 65,536 even pieces,
    whatever the keys are.
    """
    hashed = df.withColumn("_h", hash_order(key, seed)).withColumn("_key", key)
    return running_number(hashed, F.substring("_h", 1, 4), ["_h", "_key"], name).drop("_h", "_key")


def split(df: DataFrame, key: Column, test_share: float = TEST_SHARE, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``split``: exactly ceil(test_share · n) rows are 'test', the others 'train'."""
    positioned = seeded_position(df, key, seed, "_position")
    n_test = F.ceil(df.agg(F.count("*")).scalar() * F.lit(test_share))
    return positioned.withColumn("split", F.when(F.col("_position") < n_test, "test").otherwise("train")).drop("_position")


def shuffle(df: DataFrame, key: Column, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``position``, the place of each row in a seeded permutation. Sort by it when writing."""
    return seeded_position(df, key, seed, "position")


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"))
