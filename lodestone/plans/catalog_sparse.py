"""Registered queries of the sparse channel, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .registry import Registry
from ..functions.text import words
from ..operators import entities, metrics, passages, sparse
from ..session import work_path

r = Registry()
K = 5
SWEEP = [1, 3, 5, 10]

r.fragments.add("doc_words", r"SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents")
r.fragments.add("postings", "SELECT chunk_id, term, count(*) AS tf FROM doc_words GROUP BY ALL")
r.fragments.add("vocabulary", """
    SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
    FROM postings GROUP BY term""")
r.fragments.add("norms", """
    SELECT chunk_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM postings JOIN vocabulary USING (term)
    GROUP BY chunk_id""")
r.fragments.add("question_terms", r"""
    SELECT question_id, term, count(*) AS tf FROM (
        SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM benchmark)
    GROUP BY ALL""")
r.fragments.add("question_weights", """
    SELECT question_id, term, idf,
           tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY question_id)) AS query_weight
    FROM question_terms JOIN vocabulary USING (term)""")
r.fragments.add("scored", """
    SELECT question_id, chunk_id, round(dot / norm, 6) AS score FROM (
        SELECT question_id, chunk_id, sum(tf * idf * query_weight) AS dot
        FROM postings JOIN question_weights USING (term) GROUP BY ALL) JOIN norms USING (chunk_id)""")
r.fragments.add("ranked", """
    SELECT question_id, chunk_id, score,
           row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
    FROM scored""")
r.fragments.add("gold", """
    SELECT item_id AS question_id, min(doc_id) AS chunk_id FROM benchmark JOIN documents ON
    contains(documents.text, benchmark.text) GROUP BY item_id""")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunks(spark, sf_dir).select("chunk_id", words("text_content").alias("terms"))


def question_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.questions(spark, sf_dir).select("question_id", words("question").alias("terms"))


def ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    index = sparse.fit(document_words(spark, sf_dir))
    return sparse.search(index, question_words(spark, sf_dir), k)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.gold_chunks(tables.questions(spark, sf_dir), tables.chunks(spark, sf_dir))


@r.query("SELECT term, df, round(idf, 6) AS idf FROM vocabulary")
def tfidf_vocabulary(spark, sf_dir):
    documents = document_words(spark, sf_dir)
    postings = sparse.term_counts(documents, "chunk_id")
    vocabulary = sparse.build_vocabulary(postings, documents.agg(F.count("*")).scalar())
    return vocabulary.select("term", "df", F.round("idf", 6).alias("idf"))


@r.query("SELECT chunk_id, round(norm, 6) AS norm FROM norms")
def tfidf_doc_norms(spark, sf_dir):
    index = sparse.fit(document_words(spark, sf_dir))
    return index.norms.select("chunk_id", F.round("norm", 6).alias("norm"))


@r.query("""SELECT term, chunk_id, round(tf * idf / norm, 6) AS weight
            FROM postings JOIN vocabulary USING (term) JOIN norms USING (chunk_id)""")
def tfidf_weights(spark, sf_dir):
    weights = sparse.weights(sparse.fit(document_words(spark, sf_dir)))
    return weights.select("term", "chunk_id", F.round("weight", 6).alias("weight"))


r.fragments.add("matrix", """
    SELECT term, chunk_id, tf * idf / norm AS weight FROM postings JOIN vocabulary USING (term) JOIN norms USING (chunk_id)""")


@r.query("""SELECT chunk_id, count(*) AS n_terms, round(min(weight), 6) AS least, round(max(weight), 6) AS most, round(sum(weight), 6) AS total
            FROM matrix GROUP BY chunk_id""")
def tfidf_weights_by_chunk(spark, sf_dir):
    """The rows of the matrix, summed up; a chunk's norm divides its sums, so that no posting has to meet it."""
    index = sparse.fit(document_words(spark, sf_dir))
    of = F.col("tf") * F.col("idf")
    sums = sparse.with_idf(index.postings, index.vocabulary).groupBy("chunk_id").agg(
        F.count("*").alias("n_terms"), F.min(of).alias("least"), F.max(of).alias("most"), F.sum(of).alias("total"))
    return sums.join(index.norms, "chunk_id").select(
        "chunk_id", "n_terms", *[F.round(F.col(c) / F.col("norm"), 6).alias(c) for c in ("least", "most", "total")])


@r.query("""SELECT term, count(*) AS n_chunks, round(min(weight), 6) AS least, round(max(weight), 6) AS most, round(sum(weight), 6) AS total
            FROM matrix GROUP BY term""")
def tfidf_weights_by_term(spark, sf_dir):
    """The columns of the matrix, summed up."""
    return _summed(spark, sf_dir, "term", "n_chunks")


def _summed(spark: SparkSession, sf_dir: str, key: str, n: str) -> DataFrame:
    weights = sparse.weights(sparse.fit(document_words(spark, sf_dir)))
    of = F.col("weight")
    return weights.groupBy(key).agg(
        F.count("*").alias(n), F.round(F.min(of), 6).alias("least"), F.round(F.max(of), 6).alias("most"), F.round(F.sum(of), 6).alias("total"))


@r.query("SELECT question_id, term, round(query_weight, 6) AS query_weight FROM question_weights")
def query_weights(spark, sf_dir):
    index = sparse.fit(document_words(spark, sf_dir))
    weighed = sparse.weigh_queries(question_words(spark, sf_dir), index.vocabulary, False)
    return weighed.select("question_id", "term", F.round("query_weight", 6).alias("query_weight"))


@r.query(f"SELECT question_id, rank, chunk_id, score FROM ranked WHERE rank <= {K}")
def sparse_topk(spark, sf_dir):
    return ranked(spark, sf_dir, K)


@r.query(f"SELECT question_id, rank, chunk_id, score FROM ranked WHERE rank <= {K}")
def sparse_saved_index(spark, sf_dir):
    """The same search over an index that was saved and loaded."""
    path = work_path(spark, "index")
    sparse.save_index(sparse.fit(document_words(spark, sf_dir)), path)
    return sparse.search(sparse.load_index(spark, path), question_words(spark, sf_dir), K)


@r.query(f"""
    SELECT count(*) AS n_questions, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall,
           round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr
    FROM gold LEFT JOIN (SELECT * FROM ranked WHERE rank <= {K}) USING (question_id, chunk_id)""")
def sparse_recall_mrr(spark, sf_dir):
    scores = metrics.retrieval_metrics(gold(spark, sf_dir), ranked(spark, sf_dir, K))
    return scores.select("n_questions", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@r.query(f"""
    SELECT k, count(*) AS n_questions, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall,
           round(avg(CASE WHEN rank <= k THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr
    FROM (SELECT unnest({SWEEP}) AS k, question_id, rank FROM gold LEFT JOIN ranked USING (question_id, chunk_id))
    GROUP BY k""")
def retrieval_k_sweep(spark, sf_dir):
    sweep = metrics.retrieval_sweep(gold(spark, sf_dir), ranked(spark, sf_dir, max(SWEEP)), SWEEP)
    return sweep.select("k", "n_questions", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


r.fragments.add("scores_by_question", f"""
    SELECT (row_number() OVER (ORDER BY question_id) - 1) // 4 AS batch_id, CASE WHEN rank <= {K} THEN 1.0 ELSE 0.0 END AS recall,
           CASE WHEN rank <= {K} THEN 1.0 / rank ELSE 0.0 END AS mrr
    FROM gold LEFT JOIN ranked USING (question_id, chunk_id)""")


@r.query("""
    SELECT batch_id, count(*) AS n_questions, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr
    FROM scores_by_question GROUP BY batch_id
    UNION ALL SELECT NULL, count(*), round(avg(recall), 6), round(avg(mrr), 6) FROM scores_by_question""")
def retrieval_batch_metrics(spark, sf_dir):
    per_question = metrics.per_question_retrieval(gold(spark, sf_dir), ranked(spark, sf_dir, K))
    rows = metrics.batch_metrics(per_question, "question_id", 4, ["recall", "mrr"])
    return rows.select(
        "batch_id", "n_questions", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr")
    )


r.fragments.add("doc_entities", r"""
    SELECT doc_id AS chunk_id, unnest(list_transform(regexp_extract_all(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'),
        '\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*'), lambda x: lower(x))) AS term FROM documents""")
r.fragments.add("question_entities", r"""
    SELECT item_id AS question_id, unnest(list_transform(regexp_extract_all(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'),
        '\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*'), lambda x: lower(x))) AS term FROM benchmark""")


@r.query("SELECT chunk_id, term, count(*) AS tf FROM doc_entities GROUP BY ALL")
def entity_phrases(spark, sf_dir):
    chunks = tables.chunks(spark, sf_dir)
    found = chunks.select("chunk_id", entities.phrases("text_content").alias("terms"))
    return sparse.term_counts(found, "chunk_id")


@r.query(f"""
    SELECT * FROM (
        SELECT question_id, chunk_id, score,
               row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
            SELECT question_id, chunk_id, round(sum(p.tf * v.idf * q.w) / any_value(n.norm), 6) AS score
            FROM e_postings p JOIN e_vocabulary v USING (term) JOIN e_query q USING (term) JOIN e_norms n USING (chunk_id)
            GROUP BY ALL))
    WHERE rank <= {K}""")
def entity_sparse_topk(spark, sf_dir):
    documents = tables.chunks(spark, sf_dir).select("chunk_id", entities.phrases("text_content").alias("terms"))
    asked = tables.questions(spark, sf_dir).select("question_id", entities.phrases("question").alias("terms"))
    return sparse.search(sparse.fit(documents), asked, K)


r.fragments.add("e_postings", "SELECT chunk_id, term, count(*) AS tf FROM doc_entities GROUP BY ALL")
r.fragments.add("e_vocabulary", """
    SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM e_postings GROUP BY term""")
r.fragments.add("e_norms", """
    SELECT chunk_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM e_postings JOIN e_vocabulary USING (term)
    GROUP BY chunk_id""")
r.fragments.add("e_query", """
    SELECT question_id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY question_id)) AS w
    FROM (SELECT question_id, term, count(*) AS tf FROM question_entities GROUP BY ALL) JOIN e_vocabulary USING (term)""")

r.fragments.add("dictionary", r"SELECT DISTINCT term AS entity FROM question_entities")
r.fragments.add("doc_tokens", r"""
    SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents""")
r.fragments.add("doc_places", """
    SELECT chunk_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM doc_tokens""")
r.fragments.add("doc_grams", """
    SELECT chunk_id, unnest([t, t || ' ' || t2, t || ' ' || t2 || ' ' || t3]) AS entity FROM (
        SELECT chunk_id, t, lead(t, 1) OVER n AS t2, lead(t, 2) OVER n AS t3 FROM doc_places
        WINDOW n AS (PARTITION BY chunk_id ORDER BY i))""")


@r.query("SELECT chunk_id, entity, count(*) AS n_mentions FROM doc_grams JOIN dictionary USING (entity) GROUP BY ALL")
def entity_dictionary_match(spark, sf_dir):
    named = tables.questions(spark, sf_dir).select(F.explode(entities.phrases("question")).alias("entity")).distinct()
    return entities.dictionary_matches(tables.chunks(spark, sf_dir), named, max_words=3)
