"""Composition of retrieval: fusion, reranking, query expansion, summaries, contexts and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import infer
from .ranking import broadcast_if, top_k
from .sparse import SparseIndex
from ..config import SUMMARY_SENTENCES
from ..functions import prompts
from ..functions.text import let, parse_expansion, parse_summary, render, sentences, words


def fuse(sparse: DataFrame, dense: DataFrame, dedup: bool = False) -> DataFrame:
    """Bag union of two rankings, sparse first: (question_id, rank, chunk_id, channel).

    A chunk found by both channels stays twice, unless ``dedup`` keeps its first place only.
    """
    columns = ["question_id", "rank", "chunk_id"]
    both = sparse.select(*columns, F.lit("sparse").alias("channel"), F.lit(0).alias("_c")).unionByName(
        dense.select(*columns, F.lit("dense").alias("channel"), F.lit(1).alias("_c"))
    )
    if dedup:
        first = W.partitionBy("question_id", "chunk_id").orderBy("_c", "rank")
        both = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    order = W.partitionBy("question_id").orderBy("_c", "rank")
    return both.select("question_id", F.row_number().over(order).alias("rank"), "chunk_id", "channel")


def overlap_score(question: Column | str, passage: Column | str) -> Column:
    """Share of the question's distinct words that the passage has; the model-free pair score."""
    asked = F.array_distinct(words(question))
    shared = F.size(F.array_intersect(asked, words(passage)))
    return F.round(F.when(F.size(asked) > 0, shared / F.size(asked)).otherwise(F.lit(0.0)), 6)


def rerank(
    pairs: DataFrame, n: int | None = None, fraction: float | None = None, scorer: infer.Factory | None = None,
    query: str = "question", batch_size: int = 16,
) -> DataFrame:
    """Score ``pairs(question_id, rank, chunk_id, question, text_content, ...)`` and keep the best per question.

    Keeps ``n`` pairs, or the ``fraction`` of each question's pairs rounded up. Equal scores keep their earlier order.
    ``scorer`` is a model over (query, passage) tuples; without it the word overlap counts.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    if scorer is None:
        scored = pairs.withColumn("score", overlap_score(query, "text_content"))
    else:
        scored = infer.run(pairs, scorer, [query, "text_content"], "score", "double", batch_size)
    order = [F.desc("score"), F.asc("rank")]
    if n is not None:
        return top_k(scored, ["question_id"], order, n, "_new").drop("rank").withColumnRenamed("_new", "rank")
    per = W.partitionBy("question_id")
    kept = scored.withColumn("_all", F.count("*").over(per)).withColumn("_new", F.row_number().over(per.orderBy(*order)))
    return (
        kept.filter(F.col("_new") <= F.ceil(F.col("_all") * F.lit(fraction)))
        .drop("_all", "rank").withColumnRenamed("_new", "rank")
    )


def scored_candidates(
    sparse: DataFrame, dense: DataFrame, questions: DataFrame, chunks: DataFrame, scorer: infer.Factory | None = None,
    query: str = "question", batch_size: int = 16, small: bool = False,
) -> DataFrame:
    """(question_id, chunk_id, sparse_rank, dense_rank, score): every pair that a channel found, scored once.

    A rank is NULL where the channel did not find the pair. ``questions(question_id, <query>)``, ``chunks(chunk_id, text_content)``;
    ``small`` if the caller has bounded the pairs. The score is that of ``rerank``.
    """
    ranks = sparse.select("question_id", "chunk_id", F.col("rank").alias("sparse_rank"), F.lit(None).cast("int").alias("dense_rank")).unionByName(
        dense.select("question_id", "chunk_id", F.lit(None).cast("int").alias("sparse_rank"), F.col("rank").alias("dense_rank")))
    found = ranks.groupBy("question_id", "chunk_id").agg(F.min("sparse_rank").alias("sparse_rank"), F.min("dense_rank").alias("dense_rank"))
    pairs = chunks.select("chunk_id", "text_content").join(broadcast_if(found, small), "chunk_id").join(
        questions.select("question_id", query), "question_id")
    if scorer is None:
        scored = pairs.withColumn("score", overlap_score(query, "text_content"))
    else:
        scored = infer.run(pairs, scorer, [query, "text_content"], "score", "double", batch_size)
    return scored.select("question_id", "chunk_id", "sparse_rank", "dense_rank", "score")


def expand_with_model(
    questions: DataFrame, generator: infer.Factory, template: str = prompts.EXPAND, batch_size: int = 16,
    key: str | None = None,
) -> DataFrame:
    """Add ``expanded``: the question, a line break and a generated paragraph that could answer it."""
    asked = questions.withColumn("_prompt", render(template, question="question"))
    said = infer.run(asked, generator, "_prompt", "_echo", "string", batch_size, key=key)
    paragraph = parse_expansion("_echo")["document"]
    return said.withColumn("expanded", F.concat("question", F.lit("\n"), paragraph)).drop("_prompt", "_echo")


def expand_with_feedback(
    questions: DataFrame, first_pass: DataFrame, index: SparseIndex, n_terms: int = 5, small: bool = False
) -> DataFrame:
    """Add ``expanded``: the question and the heaviest terms (summed tf·idf) of the chunks a first pass found.

    Only the chunks of the first pass take part; the postings of all others are dropped by the join, where they lie if
    the caller has bounded the first pass (``small``).
    """
    found = broadcast_if(first_pass.select("question_id", "chunk_id"), small)
    weighted = index.postings.join(found, "chunk_id").join(
        index.vocabulary.select("term", "idf"), "term"
    )
    sums = weighted.groupBy("question_id", "term").agg(F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("_w"))
    best = top_k(sums, ["question_id"], [F.desc("_w"), F.asc("term")], n_terms)
    lists = best.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_t"))
    added = F.array_join(F.transform("_t", lambda t: t["term"]), " ")
    return questions.join(lists, "question_id", "left").withColumn(
        "expanded", F.when(F.col("_t").isNull(), F.col("question")).otherwise(F.concat("question", F.lit("\n"), added))
    ).drop("_t")


def extract_summary(question: Column, text: Column, n: int = SUMMARY_SENTENCES) -> Column:
    """The ``n`` sentences that share most words with the question, in text order; none shared gives ''."""
    def pick(asked: Column) -> Column:
        scored = F.transform(
            sentences(text),
            lambda s, i: F.struct(
                (-F.size(F.array_intersect(asked, words(s)))).alias("miss"), i.alias("at"), s.alias("text")
            ),
        )
        best = F.slice(F.array_sort(F.filter(scored, lambda s: s["miss"] < 0)), 1, n)
        in_order = F.array_sort(F.transform(best, lambda s: F.struct(s["at"].alias("at"), s["text"].alias("text"))))
        return F.array_join(F.transform(in_order, lambda s: s["text"]), " ")

    return let(F.array_distinct(words(question)), pick)


def summarize(
    pairs: DataFrame, generator: infer.Factory | None = None, template: str = prompts.SUMMARY, batch_size: int = 16,
    key: str | None = None,
) -> DataFrame:
    """Replace ``text_content`` by a question-aware summary; the full text stays in ``original_text``."""
    kept = pairs.withColumn("original_text", F.col("text_content"))
    if generator is None:
        return kept.withColumn("text_content", extract_summary(F.col("question"), F.col("text_content")))
    asked = kept.withColumn("_prompt", render(template, question="question", context="text_content"))
    said = infer.run(asked, generator, "_prompt", "_echo", "string", batch_size, key=key)
    return said.withColumn("text_content", parse_summary("_echo")).drop("_prompt", "_echo")


def contexts(pairs: DataFrame) -> DataFrame:
    """(question_id, context, retrieved_chunk_ids): passages in rank order, a blank line between two."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text_content", "chunk_id")))
    return pairs.groupBy("question_id").agg(ordered.alias("_d")).select(
        "question_id",
        F.array_join(F.transform("_d", lambda d: d["text_content"]), "\n\n").alias("context"),
        F.transform("_d", lambda d: d["chunk_id"]).alias("retrieved_chunk_ids"),
    )


def sources(pairs: DataFrame) -> DataFrame:
    """(question_id, sources): provenance of each answer as an array of (name, text, index_id) in rank order."""
    text = F.col("original_text") if "original_text" in pairs.columns else F.col("text_content")
    ordered = F.sort_array(F.collect_list(F.struct(
        "rank", F.col("source_name").alias("name"), text.alias("text"), F.col("chunk_id").alias("index_id")
    )))
    return pairs.groupBy("question_id").agg(ordered.alias("_s")).select(
        "question_id",
        F.transform("_s", lambda s: F.struct(s["name"].alias("name"), s["text"].alias("text"), s["index_id"].alias("index_id"))).alias("sources"),
    )


def collate(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """Answer records: gold columns and answer columns aligned by question id."""
    return questions.select(
        "question_id", F.col("chunk_id").alias("gt_chunk_id"), "question", "gt_answer"
    ).join(
        answered.select("question_id", "retrieved_chunk_ids", "raw_output", "retrieved_context", "generated_answer"),
        "question_id",
    )
