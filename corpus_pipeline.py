"""From raw documents to token ids: identify languages, drop near copies, replace personal data, mix sources, encode."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, mixing, ngram_join, pii
from lodestone.operators.ranking import at_most, broadcast_if
from lodestone.session import stored

SECRET = "corpus pipeline"
WEIGHTS = [1, 2, 3]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BROADCAST_IDS = 200_000

# Compression sizes, minimum hashes and token merges cannot be written in SQL.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a clear margin; a missing ``lang`` is filled in."""
    models = langid.learn(docs, "doc_id", "text", "lang")
    found = langid.identify(docs, "text", models)
    lang = F.coalesce("lang", "lang_pred").alias("lang")
    return found.filter(~F.col("rejected")).select(*(lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Rows that share an id are told apart by their texts: each is judged for itself, of equal ones one stays. Rows without
    an id stay as they are.
    """
    several = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    several = stored(several, "pipeline-repeated")
    if several.isEmpty():
        groups = ngram_join.join(docs, "doc_id", "text", words=5, percent=80)
        goes = stored(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "pipeline-copies")
        kept = docs.join(broadcast_if(goes, at_most(goes, BROADCAST_IDS)), "doc_id", "left_anti")
        return kept.select(*docs.columns)
    # One row of those of equal id and text, under a number of its own that is the id wherever that is enough.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = docs.filter("doc_id is not null").groupBy("doc_id", F.coalesce("text", F.lit("")).alias("_body")).agg(
        F.min_by(row, F.struct("source", "lang")).alias("_row"))
    few = at_most(several, BROADCAST_IDS)
    marked = once.join(broadcast_if(several.withColumn("_many", F.lit(True)), few), "doc_id", "left")
    numbered = stored(marked.withColumn("_number", F.when(F.col("_many"), F.xxhash64("doc_id", "_body")).otherwise(F.col("doc_id"))),
                      "pipeline-numbered")
    groups = ngram_join.join(numbered, "_number", "_body", words=5, percent=80)
    placed = stored(numbered.join(groups.select("_number", "component_id").distinct(), "_number"), "pipeline-groups")
    first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "_number")).alias("least")).select("component_id", "least._number")
    kept = placed.join(first, ["component_id", "_number"], "left_semi").select("_row.*")
    return kept.union(docs.filter("doc_id is null"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced, and their new number of characters."""
    found = pii.surrogates(docs, "doc_id", "text", SECRET, found="_replaced")
    n_chars = F.when(F.size("_replaced") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("bigint").alias("n_chars")
    return found.select(*(n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some not, some up to three times."""
    return mixing.draw(docs, "doc_id", "text", "source", WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document."""
    found = bpe.digests(docs, "doc_id", "text", Path(RANKS).read_bytes(), public_tokenizers.PATTERN, with_ids=True)
    return found.withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", languages), ("ngram_join", distinct_texts), ("pii", surrogates), ("mix", mixture), ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
