"""Question answering over whole tables: retrieval, prompts, models, answers, sources and scores in one lazy plan."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MODES, METRIC_BATCH, RetrievalConfig
from ..functions import prompts
from ..functions.dates import date_terms
from ..functions.text import normalize_ws, parse_answer, render
from ..operators import dense, entities, graph, infer, metrics, retrieve, sparse
from ..operators.ranking import BROADCAST_ROWS, at_most, global_number
from ..session import stored


@dataclass(frozen=True)
class Models:
    """Injected models. ``reader`` maps prompts to raw outputs; the others have native stand-ins when absent.

    Expansion and summaries share one generator per Python worker.
    """

    reader: infer.Factory
    generator: infer.Factory | None = None
    scorer: infer.Factory | None = None
    encoder: infer.Factory | None = None
    entity_finder: infer.Factory | None = None
    batch_size: int = METRIC_BATCH
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass(frozen=True)
class Corpus:
    """``chunks(chunk_id, source_name, text_content)``, their ``vectors`` and, if wanted, a sparse index.

    ``centroids`` or ``codes`` with ``codebooks`` belong to the approximate index types. ``n_probe`` is the number of
    cells that a calibration found for this corpus; without it and without a configured one each search calibrates anew.
    ``links`` are those of a neighbour graph over the vectors.
    """

    chunks: DataFrame
    vectors: DataFrame
    sparse_index: sparse.SparseIndex | None = None
    centroids: object | None = None
    codes: DataFrame | None = None
    codebooks: object | None = None
    n_probe: int | None = None
    links: DataFrame | None = None
    dim: int = 64


def embed_questions(questions: DataFrame, column: str, corpus: Corpus, models: Models) -> DataFrame:
    """(query_id, embedding) by the injected encoder, or by hashed words."""
    if models.encoder is None:
        hashed = dense.hashed_vectors(questions, "question_id", column, corpus.dim)
        return hashed.withColumnRenamed("question_id", "query_id")
    rows = questions.withColumnRenamed("question_id", "query_id")
    return dense.embed(rows, "query_id", column, models.encoder, models.batch_size)


def question_terms(questions: DataFrame, models: Models, base: object | None = None) -> DataFrame:
    """``questions`` plus ``terms``, the entities and days that the sparse channel looks up.

    Entities come from the injected finder, or are the capitalised phrases. ``base`` is the moment that relative date
    words refer to.
    """
    found = entities.find(questions, "question", "_entities", models.entity_finder, models.batch_size)
    terms = sparse.query_terms("_entities", date_terms("question", base))
    asked = found.withColumn("terms", terms).drop("_entities")
    return stored(asked, "questions") if models.entity_finder else asked


def dense_channel(questions: DataFrame, column: str, corpus: Corpus, models: Models, conf: RetrievalConfig) -> DataFrame:
    # Written once: the searches look at the size, then at the matrix, and the encoder must run for neither again.
    queries = stored(embed_questions(questions, column, corpus, models), "asked")
    kind = conf.index.index_type
    if kind == "exact":
        found = dense.search_exact(queries, corpus.vectors, conf.dense_k)
    elif kind == "hnsw" and corpus.links is not None:
        beam = conf.index.beam or graph.calibrate_beam(queries, corpus.vectors, corpus.links, conf.dense_k, conf.index.recall)
        found = graph.search(queries, corpus.vectors, corpus.links, conf.dense_k, beam)
    elif kind == "hnsw":
        n_probe = conf.index.n_probe or corpus.n_probe
        if n_probe is None:
            n_probe = dense.calibrate_probes(queries, corpus.vectors, corpus.centroids, conf.dense_k, conf.index.recall)
        found = dense.search_cells(queries, corpus.vectors, corpus.centroids, conf.dense_k, n_probe)
    else:
        found = dense.search_pq(queries, corpus.vectors, corpus.codes, corpus.codebooks, conf.dense_k, conf.index.rescore)
    return found.select(F.col("query_id").alias("question_id"), "rank", "chunk_id")


def retrieve_chunks(questions: DataFrame, corpus: Corpus, models: Models, conf: RetrievalConfig) -> DataFrame:
    """(question_id, rank, chunk_id, source_name, question, text_content[, original_text]) for every question.

    ``questions(question_id, question[, terms])``; ``terms`` feed the sparse channel. Three shapes, chosen while the
    plan is built: dense; sparse and dense; sparse and dense, reranked. With the dense channel alone the reranker
    works on the dense results.
    """
    asked, column = questions, "question"
    if conf.hyde_enabled:
        if models.generator is None:
            raise ValueError("query expansion needs a generator")
        expanded = retrieve.expand_with_model(questions, models.generator, batch_size=models.batch_size, key=models.key)
        asked = stored(expanded, "expanded")
        column = "expanded"
    ranked = dense_channel(asked, column, corpus, models, conf)
    width = conf.dense_k
    if conf.sparse_enabled:
        if corpus.sparse_index is None:
            raise ValueError("the sparse channel needs a sparse index")
        hits = sparse.search(corpus.sparse_index, questions.select("question_id", "terms"), conf.sparse_k)
        ranked = retrieve.fuse(hits, ranked, conf.dedup).drop("channel")
        width += conf.sparse_k
    # No question has more than ``width`` rows, so a bounded question table bounds the ids.
    small = at_most(questions, BROADCAST_ROWS // width)
    passages = dense.fetch(ranked, corpus.chunks, small)
    shown = "expanded" if conf.rerank_query == "expanded" and not conf.sparse_enabled and conf.hyde_enabled else "question"
    texts = (asked if shown == "expanded" else questions).select("question_id", "question", *(["expanded"] if shown == "expanded" else []))
    pairs = passages.join(texts, "question_id")
    if conf.rerank_enabled:
        pairs = retrieve.rerank(pairs, n=conf.rerank_k, scorer=models.scorer, query=shown, batch_size=models.batch_size)
    pairs = pairs.drop("score", "expanded")
    if conf.summary_enabled:
        pairs = retrieve.summarize(pairs, models.generator, batch_size=models.batch_size, key=models.key)
    return pairs


def read_answers(
    questions: DataFrame, pairs: DataFrame, models: Models, template: str = prompts.READER
) -> DataFrame:
    """(question_id, retrieved_chunk_ids, raw_output, retrieved_context, generated_answer).

    Questions without a retrieved chunk are asked with an empty context.
    """
    found = questions.select("question_id", "question").join(retrieve.contexts(pairs), "question_id", "left")
    asked = found.withColumn("_prompt", render(template, context="context", question="question"))
    said = infer.run(asked, models.reader, "_prompt", "raw_output", "string", models.batch_size)
    parsed = parse_answer("raw_output")
    return said.select(
        "question_id",
        F.coalesce("retrieved_chunk_ids", F.array().cast("array<bigint>")).alias("retrieved_chunk_ids"),
        "raw_output", parsed["context"].alias("retrieved_context"), parsed["answer"].alias("generated_answer"),
    )


def run_inference(
    questions: DataFrame, corpus: Corpus, models: Models, conf: RetrievalConfig, template: str = prompts.READER
) -> DataFrame:
    """(question_id, answer) with the white space of each answer normalised."""
    pairs = retrieve_chunks(questions, corpus, models, conf)
    answered = read_answers(questions, pairs, models, template)
    return answered.select("question_id", normalize_ws("generated_answer").alias("answer"))


def answer_with_sources(
    questions: DataFrame, corpus: Corpus, models: Models, conf: RetrievalConfig, template: str = prompts.READER
) -> DataFrame:
    """(question_id, answer, sources) for every question."""
    pairs = stored(retrieve_chunks(questions, corpus, models, conf), "passages")  # read for the answers and the sources
    answered = read_answers(questions, pairs, models, template)
    return answered.select("question_id", normalize_ws("generated_answer").alias("answer")).join(
        retrieve.sources(pairs), "question_id", "left"
    )


def run_validation(
    questions: DataFrame, corpus: Corpus, models: Models, conf: RetrievalConfig, template: str = prompts.READER
) -> DataFrame:
    """Answer records of ``questions(question_id, chunk_id, question, gt_answer[, terms])``."""
    pairs = retrieve_chunks(questions, corpus, models, conf)
    return retrieve.collate(questions, read_answers(questions, pairs, models, template))


def validation_metrics(
    records: DataFrame, batch: int = METRIC_BATCH, row_no: str = "question_id", encoder: infer.Factory | None = None
) -> DataFrame:
    """Every score per batch of ``batch`` consecutive questions and over all (batch_id NULL), out of answer records.

    Questions are numbered from 0 in the order of ``row_no``, whatever gaps it has. Token counts are made inside each
    row. With an ``encoder`` of texts into token vectors, BERTScore is added.
    """
    scored = global_number(records, [row_no], "_no").select(
        F.col("question_id").alias("pair_id"), F.col("_no").alias("row_no"),
        F.col("generated_answer").alias("prediction"), F.col("gt_answer").alias("reference"),
        F.nullif(F.array_position("retrieved_chunk_ids", F.col("gt_chunk_id")), F.lit(0)).alias("_rank"),
    )
    joined = scored.select(
        "pair_id", F.floor(F.col("row_no") / batch).cast("bigint").alias("batch_id"),
        F.col("_rank").isNotNull().cast("double").alias("recall"), F.coalesce(F.lit(1.0) / F.col("_rank"), F.lit(0.0)).alias("mrr"),
        *metrics.squad_columns("prediction", "reference"), metrics.rouge1_column("prediction", "reference"),
        metrics.bleu1_column("prediction", "reference").alias("_bleu"),
    )
    names = ["recall", "mrr", "squad_exact_match", "squad_f1", "rouge1"]
    if encoder is not None:
        similar = metrics.bertscore_per_pair(scored.select("pair_id", "prediction", "reference"), encoder)
        parts = ["precision", "recall", "f1"]
        joined = joined.join(similar.select("pair_id", *[F.col(c).alias(f"bertscore_{c}") for c in parts]), "pair_id")
        names += [f"bertscore_{c}" for c in parts]
    measures = [F.avg(c).alias(c) for c in names]
    bleu = metrics.bleu1_score(*[F.sum(f"_bleu.{c}") for c in ("n_common", "n_prediction", "n_reference")]).alias("bleu1")
    size = F.count("*").alias("n_questions")
    # ROLLUP gives the batch rows and the overall row in one pass.
    return joined.rollup("batch_id").agg(size, *measures, bleu)


def run(mode: str, questions: DataFrame, corpus: Corpus, models: Models, conf: RetrievalConfig) -> DataFrame:
    """Answer records ("validation") or answers ("inference")."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    return (run_validation if mode == "validation" else run_inference)(questions, corpus, models, conf)
