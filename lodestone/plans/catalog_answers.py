"""Registered queries of retrieval composition and question answering, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import answering, catalog_dense, catalog_sparse, catalog_text, standins, tables
from .registry import Registry
from .catalog_text import BLEU, ROUGE, SQUAD, sql_bags, sql_render, ws
from ..config import RetrievalConfig
from ..functions import prompts
from ..functions.text import words
from ..operators import dense, metrics, retrieve, sparse
from ..operators.ranking import BROADCAST_ROWS, at_most
from ..session import stored, work_path
from ..streaming import ingest, keyed

r = Registry()
r.fragments.include(catalog_sparse.r.fragments)
r.fragments.include(catalog_dense.r.fragments)
r.fragments.include(catalog_text.r.fragments)
DENSE_K, SPARSE_K, RERANK_K = catalog_dense.K, catalog_sparse.K, 3
DIM = catalog_dense.DIM

WORDS = r"regexp_extract_all(lower({c}), '\p{{L}}+')"


def sql_best_line(text: str, question: str) -> str:
    """The line of a text that shares most distinct words with a question, the first of equal ones."""
    shared = f"len(list_intersect(list_distinct({WORDS.format(c=question)}), {WORDS.format(c='x')}))"
    return (f"list_extract(list_sort(list_transform(string_split({text}, chr(10)), lambda x, i: "
            f"{{'n': -{shared}, 'i': i, 's': x}})), 1).s")


Q_WORDS, T_WORDS = WORDS.format(c="question"), WORDS.format(c="text_content")

r.fragments.add("fused", f"""
    SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY c, rank) AS rank, chunk_id,
           CASE c WHEN 0 THEN 'sparse' ELSE 'dense' END AS channel FROM (
        SELECT question_id, 0 AS c, rank, chunk_id FROM ranked WHERE rank <= {SPARSE_K}
        UNION ALL SELECT query_id, 1, rank, chunk_id FROM text_near)""")
r.fragments.add("fused_texts", """
    SELECT f.question_id, f.rank, f.chunk_id, d.source AS source_name, b.text AS question, d.text AS text_content
    FROM fused f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.question_id""")
r.fragments.add("pair_scores", f"""
    SELECT *, round(CASE WHEN len({Q_WORDS}) > 0 THEN len(list_intersect(list_distinct({Q_WORDS}), {T_WORDS}))::DOUBLE
           / len(list_distinct({Q_WORDS})) ELSE 0.0 END, 6) AS score FROM fused_texts""")
r.fragments.add("reranked", f"""
    SELECT question_id, new_rank AS rank, chunk_id, source_name, question, text_content, score FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS new_rank FROM pair_scores)
    WHERE new_rank <= {RERANK_K}""")


def corpus(spark, sf_dir):
    """Documents with hashed vectors and a word index; their words are counted once for both."""
    chunks = tables.chunks(spark, sf_dir)
    index = sparse.fit(chunks.select("chunk_id", words("text_content").alias("terms")))
    vectors = stored(dense.hashed_counts(index.rows, "chunk_id", "counts", DIM), "vectors")
    return answering.Corpus(chunks, vectors, index, dim=DIM)


def dense_corpus(spark, sf_dir):
    """Documents with hashed vectors alone."""
    chunks = tables.chunks(spark, sf_dir)
    return answering.Corpus(chunks, stored(dense.hashed_vectors(chunks, "chunk_id", "text_content", DIM), "vectors"), dim=DIM)


def asked(spark, sf_dir):
    return tables.questions(spark, sf_dir).withColumn("terms", words("question"))


def both_channels(spark, sf_dir):
    index, questions = corpus(spark, sf_dir), asked(spark, sf_dir)
    hits = sparse.search(index.sparse_index, questions.select("question_id", "terms"), SPARSE_K)
    near = answering.dense_channel(
        questions, "question", index, answering.Models(standins.echo_reader), RetrievalConfig(dense_k=DENSE_K)
    )
    return retrieve.fuse(hits, near), index, questions


def fused_pairs(spark, sf_dir):
    fused, index, questions = both_channels(spark, sf_dir)
    small = at_most(questions, BROADCAST_ROWS // (DENSE_K + SPARSE_K))
    passages = dense.fetch(fused.drop("channel"), index.chunks, small)
    return passages.join(questions.select("question_id", "question"), "question_id")


@r.query("SELECT * FROM fused")
def fused_candidates(spark, sf_dir):
    return both_channels(spark, sf_dir)[0]


@r.query(r"""
    SELECT item_id AS question_id, list_concat(list_transform(regexp_extract_all(
               regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), '\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*'), lambda x: lower(x)),
               [strftime(o_orderdate, '%Y-%m-%d')]) AS terms
    FROM benchmark JOIN orders ON o_orderkey = item_id""")
def question_terms(spark, sf_dir):
    """Entities and days of questions that name the date of an order."""
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), "o_orderdate")
    dated = tables.questions(spark, sf_dir).join(orders, "question_id").select(
        "question_id", F.concat_ws(" ", "question", F.lit("(on"), F.date_format("o_orderdate", "M/d/yyyy"), F.lit(")")).alias("question")
    )
    return answering.question_terms(dated, MODELS).select("question_id", "terms")


@r.query("""
    SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank, chunk_id, channel FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY rank) AS n FROM fused) WHERE n = 1""")
def fused_distinct(spark, sf_dir):
    fused = both_channels(spark, sf_dir)[0]
    sides = [fused.filter(F.col("channel") == c) for c in ("sparse", "dense")]
    return retrieve.fuse(*sides, dedup=True)


@r.query("SELECT question_id, rank, chunk_id, score FROM reranked")
def rerank_overlap(spark, sf_dir):
    return retrieve.rerank(fused_pairs(spark, sf_dir), n=RERANK_K).select("question_id", "rank", "chunk_id", "score")


@r.query("""
    SELECT question_id, new_rank AS rank, chunk_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS new_rank,
               count(*) OVER (PARTITION BY question_id) AS n FROM pair_scores)
    WHERE new_rank <= ceil(n * (1.0 / 3.0)::DOUBLE)""")
def rerank_top_third(spark, sf_dir):
    kept = retrieve.rerank(fused_pairs(spark, sf_dir), fraction=1.0 / 3.0)
    return kept.select("question_id", "rank", "chunk_id", "score")


SPARSE_KS, DENSE_KS, RERANK_KS = [1, 3, SPARSE_K], [1, 3, DENSE_K], [1, 2, 3, 5]
r.fragments.add("grid_cells", f"""
    SELECT sparse_k, dense_k FROM (SELECT unnest({SPARSE_KS}) AS sparse_k), (SELECT unnest({DENSE_KS}) AS dense_k)""")
r.fragments.add("grid_fused", """
    SELECT sparse_k, dense_k, question_id, chunk_id, min([c, rank]) AS place FROM (
        SELECT sparse_k, dense_k, question_id, chunk_id, 0 AS c, rank FROM ranked JOIN grid_cells ON rank <= sparse_k
        UNION ALL SELECT sparse_k, dense_k, query_id, chunk_id, 1, rank FROM text_near JOIN grid_cells ON rank <= dense_k)
    GROUP BY ALL""")
r.fragments.add("grid_ranked", """
    SELECT sparse_k, dense_k, question_id, chunk_id,
           row_number() OVER (PARTITION BY sparse_k, dense_k, question_id ORDER BY score DESC, place) AS new_rank
    FROM grid_fused JOIN (SELECT DISTINCT question_id, chunk_id, score FROM pair_scores) USING (question_id, chunk_id)""")


@r.query(f"""
    SELECT sparse_k, dense_k, rerank_k, count(*) AS n_questions, round(avg(CASE WHEN new_rank <= rerank_k THEN 1.0 ELSE 0.0 END), 6) AS recall,
           round(avg(CASE WHEN new_rank <= rerank_k THEN 1.0 / new_rank ELSE 0.0 END), 6) AS mrr
    FROM (SELECT *, unnest({RERANK_KS}) AS rerank_k FROM gold, grid_cells) a
    LEFT JOIN grid_ranked USING (sparse_k, dense_k, question_id, chunk_id) GROUP BY sparse_k, dense_k, rerank_k""")
def retrieval_grid(spark, sf_dir):
    """Every combination of the cut-offs of both channels and of reranking, out of one ranking each."""
    index, questions = corpus(spark, sf_dir), asked(spark, sf_dir)
    hits = sparse.search(index.sparse_index, questions.select("question_id", "terms"), max(SPARSE_KS))
    near = answering.dense_channel(
        questions, "question", index, answering.Models(standins.echo_reader), RetrievalConfig(dense_k=max(DENSE_KS)))
    small = at_most(questions, BROADCAST_ROWS // (max(DENSE_KS) + max(SPARSE_KS)))
    scored = retrieve.scored_candidates(hits, near, questions, index.chunks, small=small)
    grid = metrics.retrieval_grid(catalog_sparse.gold(spark, sf_dir), scored, SPARSE_KS, DENSE_KS, RERANK_KS)
    return grid.select(
        "sparse_k", "dense_k", "rerank_k", "n_questions", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


r.fragments.add("feedback_terms", f"""
    SELECT question_id, string_agg(term, ' ' ORDER BY w DESC, term) AS added FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY w DESC, term) AS n FROM (
            SELECT question_id, term, round(sum(tf * idf), 6) AS w FROM ranked JOIN postings USING (chunk_id)
            JOIN vocabulary USING (term) WHERE rank <= {SPARSE_K} GROUP BY ALL))
    WHERE n <= 5 GROUP BY question_id""")


@r.query("""SELECT item_id AS question_id, CASE WHEN added IS NULL THEN text ELSE text || chr(10) || added END AS expanded
            FROM benchmark LEFT JOIN feedback_terms ON question_id = item_id""")
def feedback_expansion(spark, sf_dir):
    index = sparse.fit(catalog_sparse.document_words(spark, sf_dir))
    first = sparse.search(index, catalog_sparse.question_words(spark, sf_dir), SPARSE_K)
    questions = tables.questions(spark, sf_dir)
    small = at_most(questions, BROADCAST_ROWS // SPARSE_K)
    return retrieve.expand_with_feedback(questions, first, index, small=small).select("question_id", "expanded")


@r.query("SELECT item_id AS question_id, text || chr(10) || text AS expanded FROM benchmark")
def hyde_expand(spark, sf_dir):
    """Expansion by an injected generator, here one that repeats the question as its paragraph."""
    expanded = retrieve.expand_with_model(tables.questions(spark, sf_dir), standins.echo_expander)
    return expanded.select("question_id", "expanded")


r.fragments.add("summary_sentences", f"""
    SELECT question_id, rank, chunk_id, spot, s, len(list_intersect(list_distinct({Q_WORDS}), {WORDS.format(c='s')})) AS shared FROM (
        SELECT question_id, rank, chunk_id, question, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS spot FROM (
            SELECT *, list_filter(list_transform(regexp_extract_all(text_content, '[^.!?\\n]+[.!?]*'), lambda x: {ws('x')}),
                   lambda x: length(x) > 0) AS sentences FROM reranked))""")
r.fragments.add("summaries", """
    SELECT question_id, rank, chunk_id, string_agg(s, ' ' ORDER BY spot) AS summary FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id, rank ORDER BY shared DESC, spot) AS n FROM summary_sentences
        WHERE shared > 0) WHERE n <= 3 GROUP BY ALL""")
r.fragments.add("summarized", """
    SELECT r.question_id, r.rank, r.chunk_id, r.source_name, coalesce(summary, '') AS text_content, r.text_content AS original_text
    FROM reranked r LEFT JOIN summaries USING (question_id, rank)""")


def summarized(spark, sf_dir):
    return retrieve.summarize(retrieve.rerank(fused_pairs(spark, sf_dir), n=RERANK_K))


@r.query("SELECT question_id, rank, chunk_id, text_content FROM summarized")
def extractive_summary(spark, sf_dir):
    return summarized(spark, sf_dir).select("question_id", "rank", "chunk_id", "text_content")


@r.query("""SELECT question_id, string_agg(text_content, chr(10) || chr(10) ORDER BY rank) AS context,
            list(chunk_id ORDER BY rank) AS retrieved_chunk_ids FROM summarized GROUP BY question_id""")
def context_assembly(spark, sf_dir):
    return retrieve.contexts(summarized(spark, sf_dir))


@r.query("""
    SELECT question_id, place, s.name AS name, s.text AS text, s.index_id AS index_id FROM (
        SELECT question_id, rank - 1 AS place, {'name': source_name, 'text': original_text, 'index_id': chunk_id} AS s FROM summarized)""")
def answer_sources(spark, sf_dir):
    """Provenance with the original, unsummarised text."""
    named = retrieve.sources(summarized(spark, sf_dir))
    return named.select("question_id", F.posexplode("sources").alias("place", "s")).select(
        "question_id", F.col("place").cast("bigint").alias("place"), "s.name", "s.text", "s.index_id"
    )


# ---- whole runs with deterministic models ----------------------------------------------------------------------

CONF = RetrievalConfig(dense_k=DENSE_K, sparse_enabled=True, sparse_k=SPARSE_K, rerank_k=RERANK_K)
MODELS = answering.Models(reader=standins.echo_reader, generator=standins.line_summarizer)

r.fragments.add("contexts", f"""
    SELECT question_id, any_value(question) AS question, list(chunk_id ORDER BY rank) AS retrieved_chunk_ids,
           string_agg({sql_best_line('text_content', 'question')}, chr(10) || chr(10) ORDER BY rank) AS context
    FROM reranked GROUP BY question_id""")
r.fragments.add("outputs", f"""
    SELECT b.item_id AS question_id, b.text AS question, coalesce(retrieved_chunk_ids, []) AS retrieved_chunk_ids,
           coalesce(context, '') AS retrieved_context,
           {ws(sql_best_line("coalesce(context, '')", "b.text"))} AS generated_answer
    FROM benchmark b LEFT JOIN contexts c ON c.question_id = b.item_id""")
RAW = sql_render(prompts.READER, context="retrieved_context", question="o.question") + " || generated_answer"
r.fragments.add("records", f"""
    SELECT o.question_id, g.chunk_id AS gt_chunk_id, o.question, o.question AS gt_answer, retrieved_chunk_ids,
           {RAW} AS raw_output, retrieved_context, generated_answer FROM outputs o JOIN gold g USING (question_id)""")
r.fragments.add("record_pairs", """
    SELECT question_id AS pair_id, (row_number() OVER (ORDER BY question_id) - 1) // 4 AS batch_id, generated_answer AS prediction, gt_answer AS reference,
           nullif(coalesce(list_position(retrieved_chunk_ids, gt_chunk_id), 0), 0) AS hit FROM records""")


r.fragments.add("dense_scores", f"""
    SELECT *, round(CASE WHEN len({Q_WORDS}) > 0 THEN len(list_intersect(list_distinct({Q_WORDS}), {T_WORDS}))::DOUBLE
           / len(list_distinct({Q_WORDS})) ELSE 0.0 END, 6) AS score FROM (
        SELECT n.query_id AS question_id, n.rank, n.chunk_id, b.text AS question, d.text AS text_content
        FROM text_near n JOIN documents d ON d.doc_id = n.chunk_id JOIN benchmark b ON b.item_id = n.query_id)""")
r.fragments.add("dense_best", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS place FROM dense_scores)
    WHERE place <= {RERANK_K}""")


@r.query(f"""
    SELECT b.item_id AS question_id, {ws(sql_best_line("coalesce(context, '')", "b.text"))} AS answer
    FROM benchmark b LEFT JOIN (
        SELECT question_id, string_agg({sql_best_line('text_content', 'question')}, chr(10) || chr(10) ORDER BY place) AS context
        FROM dense_best GROUP BY question_id) c ON c.question_id = b.item_id""")
def rag_dense_only_e2e(spark, sf_dir):
    """The dense channel alone on the expanded question, reranked by the expanded text, with summaries and the reader."""
    conf = RetrievalConfig(dense_k=DENSE_K, rerank_k=RERANK_K, rerank_query="expanded")
    questions = tables.questions(spark, sf_dir)
    return answering.run("inference", questions, dense_corpus(spark, sf_dir), MODELS, conf)


@r.query("SELECT question_id, rank, chunk_id FROM fused")
def retrieval_without_rerank(spark, sf_dir):
    """Both channels, neither reranked nor summarised."""
    conf = RetrievalConfig(
        dense_k=DENSE_K, sparse_enabled=True, sparse_k=SPARSE_K, rerank_enabled=False, summary_enabled=False, hyde_enabled=False
    )
    found = answering.retrieve_chunks(asked(spark, sf_dir), corpus(spark, sf_dir), MODELS, conf)
    return found.select("question_id", "rank", "chunk_id")


def labelled(spark, sf_dir):
    """Questions with the chunk that contains them; the passage itself is the expected answer."""
    found = asked(spark, sf_dir).join(catalog_sparse.gold(spark, sf_dir), "question_id")
    return stored(found.withColumn("gt_answer", F.col("question")), "labelled")


@r.query("SELECT question_id, generated_answer AS answer FROM outputs")
def rag_inference_e2e(spark, sf_dir):
    """Expansion, both channels, reranking, summaries, reader, for every question of the table."""
    return answering.run("inference", asked(spark, sf_dir), corpus(spark, sf_dir), MODELS, CONF)


@r.query("""
    SELECT o.question_id, generated_answer AS answer, len(retrieved_chunk_ids) AS n_sources, string_agg(r.source_name, ',' ORDER BY rank) AS names,
           sum(length(r.text_content))::BIGINT AS n_chars
    FROM outputs o LEFT JOIN reranked r USING (question_id) GROUP BY ALL""")
def rag_answers_with_sources(spark, sf_dir):
    answered = answering.answer_with_sources(asked(spark, sf_dir), corpus(spark, sf_dir), MODELS, CONF)
    chars = F.aggregate("sources", F.lit(0).cast("bigint"), lambda n, s: n + F.length(s["text"]))
    return answered.select(
        "question_id", "answer", F.size("sources").cast("bigint").alias("n_sources"),
        F.array_join(F.transform("sources", lambda s: s["name"]), ",").alias("names"), chars.alias("n_chars"),
    )


@r.query("SELECT * FROM records")
def rag_validation_e2e(spark, sf_dir):
    return answering.run("validation", labelled(spark, sf_dir), corpus(spark, sf_dir), MODELS, CONF)


for _name, _tokens in (("rs", SQUAD), ("rr", ROUGE), ("rb", BLEU)):
    sql_bags(_name, _tokens, r.fragments, "record_pairs")
r.fragments.add("record_scores", f"""
    SELECT batch_id, CASE WHEN hit IS NULL THEN 0.0 ELSE 1.0 END AS recall, coalesce(1.0 / hit, 0.0) AS mrr,
           CASE WHEN {SQUAD.format(c='prediction')} = {SQUAD.format(c='reference')} THEN 100.0 ELSE 0.0 END AS em,
           CASE WHEN s.m > 0 THEN 200.0 * s.m / (s.t + s.n) ELSE 0.0 END AS f1,
           CASE WHEN r.m > 0 THEN 2.0 * r.m / (r.t + r.n) ELSE 0.0 END AS rouge1, b.m, b.t, b.n
    FROM record_pairs JOIN rs_bags s USING (pair_id) JOIN rr_bags r USING (pair_id) JOIN rb_bags b USING (pair_id)""")


@r.query("""
    SELECT batch_id, count(*) AS n_questions, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr,
           round(avg(em), 6) AS squad_exact_match, round(avg(f1), 6) AS squad_f1, round(avg(rouge1), 6) AS rouge1,
           round(CASE WHEN sum(t) = 0 THEN 0.0 ELSE (sum(m) + 1.0) / (sum(t) + 1.0) * CASE WHEN sum(t) > sum(n) THEN 1.0
                 ELSE exp(1 - sum(n)::DOUBLE / sum(t)) END END, 6) AS bleu1
    FROM record_scores GROUP BY ROLLUP (batch_id)""")
def rag_validation_metrics(spark, sf_dir):
    """All scores per batch of four questions and over all of them, out of stored answer records."""
    records = stored(rag_validation_e2e(spark, sf_dir), "records")
    scores = answering.validation_metrics(records)
    measures = ["recall", "mrr", "squad_exact_match", "squad_f1", "rouge1", "bleu1"]
    return scores.select("batch_id", "n_questions", *[F.round(m, 6).alias(m) for m in measures])


# Tokens of both sides as (bucket, bucket before); a vector has 1 and 1/2 there, so cosines follow from equal buckets.
r.fragments.add("bert_texts", """
    SELECT pair_id, 1 AS side, string_split(prediction, ' ') AS w FROM scored_pairs
    UNION ALL SELECT pair_id, 2, string_split(reference, ' ') FROM scored_pairs""")
r.fragments.add("bert_tokens", """
    SELECT *, CASE WHEN before IS NULL THEN 1.0 WHEN before = bucket THEN 1.5 ELSE sqrt(1.25) END AS size FROM (
        SELECT pair_id, side, i, bucket, lag(bucket) OVER (PARTITION BY pair_id, side ORDER BY i) AS before FROM (
            SELECT pair_id, side, i, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS bucket FROM (
                SELECT pair_id, side, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM bert_texts) WHERE t <> ''))""")
r.fragments.add("bert_near", """
    SELECT p.pair_id, p.i AS pi, r.i AS ri, ((p.bucket = r.bucket)::INT + 0.5 * coalesce((p.bucket = r.before)::INT, 0)
           + 0.5 * coalesce((p.before = r.bucket)::INT, 0) + 0.25 * coalesce((p.before = r.before)::INT, 0)) / (p.size * r.size) AS cosine
    FROM bert_tokens p JOIN bert_tokens r ON p.pair_id = r.pair_id AND p.side = 1 AND r.side = 2""")
r.fragments.add("bert_pairs", """
    SELECT pair_id, coalesce(a.v, 0) AS precision, coalesce(b.v, 0) AS recall FROM scored_pairs
    LEFT JOIN (SELECT pair_id, avg(m) AS v FROM (SELECT pair_id, pi, max(cosine) AS m FROM bert_near GROUP BY ALL) GROUP BY pair_id) a USING (pair_id)
    LEFT JOIN (SELECT pair_id, avg(m) AS v FROM (SELECT pair_id, ri, max(cosine) AS m FROM bert_near GROUP BY ALL) GROUP BY pair_id) b USING (pair_id)""")


@r.query("""
    SELECT count(*) AS n_pairs, round(avg(precision), 6) AS bertscore_precision, round(avg(recall), 6) AS bertscore_recall,
           round(avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 6) AS bertscore_f1
    FROM bert_pairs""")
def bertscore_tokens(spark, sf_dir):
    """Token matching with vectors that depend on the token before, of an injected encoder of whole texts."""
    scores = metrics.bertscore(catalog_text.scored_pairs(spark, sf_dir), standins.context_encoder(64))
    return scores.select("n_pairs", *[F.round(f"bertscore_{c}", 6).alias(f"bertscore_{c}") for c in ("precision", "recall", "f1")])


@r.query(r"""
    SELECT doc_id AS chunk_id, source AS source_name, length(text) AS n_chars, len(list_distinct(list_transform(
           regexp_extract_all(lower(text), '\p{L}+'), lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64))) AS n_buckets,
           CASE WHEN regexp_matches(text, '\p{L}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS size FROM documents""")
def stream_ingest(spark, sf_dir):
    """Documents streamed into an embedded chunk table, once per id; the table is read back."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType())
    ])
    # As a pattern, so that the table may be one file or a folder of files.
    rows = ingest.read_stream(spark, f"{sf_dir}/{{documents.parquet}}", schema, "parquet").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_name"), F.col("text").alias("text_content")
    )
    root = work_path(spark, "stream")

    def embedded(batch):
        counted = batch.withColumn("n_chars", F.length("text_content").cast("bigint"))
        return dense.hashed_vectors(counted, "chunk_id", "text_content", DIM, ("source_name", "n_chars"))

    ingest.start(rows, embedded, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return spark.read.parquet(f"{root}/table").select(
        "chunk_id", "source_name", "n_chars", F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("n_buckets"),
        F.round(squares, 6).alias("size"),
    )


@r.query("""
    SELECT chunk_id, count(*) AS n_rows, min(source_name) AS source_name, min(length(text_content)) AS n_chars FROM (
        SELECT doc_id AS chunk_id, source AS source_name, text AS text_content FROM documents
        UNION ALL SELECT -1 - page_id, url, html FROM pages)
    GROUP BY chunk_id""")
def keyed_ingest(spark, sf_dir):
    """Documents and pages appended to one table in four batches that bring most rows again; every id is there once."""
    sink = work_path(spark, "keyed")
    documents = tables.chunks(spark, sf_dir)
    pages = tables.pages(spark, sf_dir).select(
        (F.lit(-1) - F.col("page_id")).alias("chunk_id"), F.col("url").alias("source_name"), F.col("html").alias("text_content"))

    def counted(rows):
        return rows.withColumn("n_chars", F.length("text_content").cast("bigint"))

    for number, batch in enumerate((documents, documents.unionByName(pages), pages, pages.unionByName(pages))):
        keyed.append(batch, counted, sink, number, buckets=16)
    return keyed.read(spark, sink).groupBy("chunk_id").agg(
        F.count("*").alias("n_rows"), F.min("source_name").alias("source_name"), F.min("n_chars").alias("n_chars"))
