"""Registered queries of the dense channel, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import tables
from .registry import Registry
from ..config import IndexConfig
from ..operators import dense, graph, metrics
from ..session import work_path
from ..sources import vectors_text

r = Registry()
K = 10
DIM = 64

r.fragments.add("vector_pairs", """
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.label AS query_label, b.label AS chunk_label,
           round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),
                 lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id""")
r.fragments.add("near", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
                   FROM vector_pairs) WHERE rank <= {K}""")
NEAR = "SELECT query_id, rank, chunk_id, distance FROM near"


def both_sides(spark, sf_dir):
    vectors = tables.vectors(spark, sf_dir)
    return vectors.select(F.col("chunk_id").alias("query_id"), "embedding"), vectors.select("chunk_id", "embedding")


@r.query(NEAR)
def dense_topk_exact(spark, sf_dir):
    """Every vector asks for its nearest others; the queries go to every executor."""
    return dense.search_exact(*both_sides(spark, sf_dir), K, exclude_self=True)


@r.query(NEAR)
def dense_topk_blocks(spark, sf_dir):
    """The same by the block join that serves query sets too large to be sent around."""
    queries, vectors = both_sides(spark, sf_dir)
    return dense.search_blocks(queries, vectors, K, exclude_self=True)


@r.query()
def dense_topk_ivf(spark, sf_dir):
    """The cell search with as many cells probed as a brute force over some of the queries asks for."""
    return dense.search(*both_sides(spark, sf_dir), K, IndexConfig("hnsw", n_cells=16), exclude_self=True)


@r.query(NEAR)
def dense_topk_all_cells(spark, sf_dir):
    """The cell search with every cell probed, which must find exactly what the exact search finds."""
    return dense.search(*both_sides(spark, sf_dir), K, IndexConfig("hnsw", n_cells=16, n_probe=16), exclude_self=True)


@r.query()
def dense_topk_pq(spark, sf_dir):
    """Inverted lists of one-byte codes, read by lookup tables in the probed cells; the best are scored exactly."""
    return dense.search(*both_sides(spark, sf_dir), K, IndexConfig("hnsw_pq", n_cells=16, pq_bits=6), exclude_self=True)


@r.query(f"SELECT count(*) AS n_queries, {K} AS k, true AS recall_reached, true AS scores_exact FROM embeddings")
def dense_pq_recall(spark, sf_dir):
    """Whether the inverted lists find nine tenths of the true neighbours of all vectors, with their true distances."""
    true = dense.search_exact(*both_sides(spark, sf_dir), K, exclude_self=True)
    return recall_row(true, dense_topk_pq(spark, sf_dir))


def recall_row(true, found):
    """One row: whether ``found`` holds nine tenths of the ``true`` neighbours, at their distances."""
    pairs = true.join(found.select("query_id", "chunk_id", F.col("distance").alias("seen")), ["query_id", "chunk_id"], "left")
    return pairs.agg(
        F.countDistinct("query_id").alias("n_queries"), F.lit(K).alias("k"), (F.count("seen") >= 0.9 * F.count("*")).alias("recall_reached"),
        F.coalesce(F.max(F.abs(F.col("seen") - F.col("distance"))) < 2e-6, F.lit(False)).alias("scores_exact"))


def asked_and_found(spark, sf_dir):
    """Every twentieth vector asks the neighbour graph; (queries, vectors, found)."""
    queries, vectors = both_sides(spark, sf_dir)
    queries = queries.filter(F.col("query_id") % 20 == 0)
    links = graph.build(vectors).links
    beam = graph.calibrate_beam(queries, vectors, links, K, 0.95, exclude_self=True)
    return queries, vectors, graph.search(queries, vectors, links, K, beam, exclude_self=True)


@r.query()
def dense_topk_graph(spark, sf_dir):
    """Search of the neighbour graph, with the number of vectors that each query looked at."""
    return asked_and_found(spark, sf_dir)[2]


@r.query(f"""
    SELECT count(*) AS n_queries, {K} AS k, true AS recall_reached, true AS scores_exact FROM embeddings WHERE vec_id % 20 = 0""")
def dense_graph_recall(spark, sf_dir):
    """Whether the graph finds nine tenths of the true neighbours of all that ask, and gives them their true distances."""
    queries, vectors, found = asked_and_found(spark, sf_dir)
    true = dense.search_exact(queries, vectors, K, exclude_self=True)
    return recall_row(true, found)


@r.query(f"""
    SELECT count(*) AS n_queries, round(avg(CASE WHEN first_rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall,
           round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr
    FROM (SELECT e.vec_id, min(n.rank) AS first_rank FROM embeddings e
          LEFT JOIN near n ON n.query_id = e.vec_id AND n.query_label = n.chunk_label GROUP BY e.vec_id)""")
def dense_label_metrics(spark, sf_dir):
    """How early a vector of the same label comes back."""
    labels = tables.vectors(spark, sf_dir).select("chunk_id", "label")
    near = dense.search_exact(*both_sides(spark, sf_dir), K, exclude_self=True)
    hits = near.join(labels, "chunk_id").groupBy(F.col("query_id").alias("question_id"), "label").agg(
        F.min("rank").alias("rank")
    )
    gold = labels.select(F.col("chunk_id").alias("question_id"), F.col("label").alias("chunk_id"))
    scores = metrics.retrieval_metrics(gold, hits.withColumnRenamed("label", "chunk_id"))
    return scores.select(
        F.col("n_questions").alias("n_queries"), F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr")
    )


r.fragments.add("doc_buckets", rf"""
    SELECT doc_id AS chunk_id, bucket, count(*)::DOUBLE AS n FROM (
        SELECT doc_id, (('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '\p{{L}}+'))), 1, 8))::BIGINT % {DIM}) AS bucket
        FROM documents) GROUP BY ALL""")
r.fragments.add("doc_hashed", """
    SELECT chunk_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS weight FROM doc_buckets""")
r.fragments.add("question_buckets", rf"""
    SELECT item_id AS question_id, bucket, count(*)::DOUBLE AS n FROM (
        SELECT item_id, (('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '\p{{L}}+'))), 1, 8))::BIGINT % {DIM}) AS bucket
        FROM benchmark) GROUP BY ALL""")
r.fragments.add("question_hashed", """
    SELECT question_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY question_id)) AS weight FROM question_buckets""")
r.fragments.add("text_distance", """
    SELECT q.item_id AS query_id, d.doc_id AS chunk_id,
           round(greatest(coalesce(ql.l, 0) + coalesce(dl.l, 0) - 2 * coalesce(x.dot, 0), 0), 6) AS distance
    FROM benchmark q CROSS JOIN documents d
    LEFT JOIN (SELECT question_id, 1.0 AS l FROM question_hashed GROUP BY question_id) ql ON ql.question_id = q.item_id
    LEFT JOIN (SELECT chunk_id, 1.0 AS l FROM doc_hashed GROUP BY chunk_id) dl ON dl.chunk_id = d.doc_id
    LEFT JOIN (SELECT question_id, chunk_id, sum(a.weight * b.weight) AS dot
               FROM question_hashed a JOIN doc_hashed b USING (bucket) GROUP BY ALL) x
        ON x.question_id = q.item_id AND x.chunk_id = d.doc_id""")
r.fragments.add("text_near", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
                   FROM text_distance) WHERE rank <= {K}""")


@r.query("SELECT chunk_id, bucket::INTEGER AS bucket, round(weight, 6) AS weight FROM doc_hashed")
def embed_documents(spark, sf_dir):
    weights = dense.hashed_weights(tables.chunks(spark, sf_dir), "chunk_id", "text_content", DIM)
    return weights.withColumn("weight", F.round("weight", 6))


@r.query("SELECT query_id, rank, chunk_id, distance FROM text_near")
def dense_text_topk(spark, sf_dir):
    """Questions against documents, both embedded by hashed word counts."""
    documents = dense.hashed_vectors(tables.chunks(spark, sf_dir), "chunk_id", "text_content", DIM)
    asked = dense.hashed_vectors(tables.questions(spark, sf_dir), "question_id", "question", DIM)
    return dense.search_exact(asked.withColumnRenamed("question_id", "query_id"), documents, K)


@r.query("""
    SELECT query_id AS question_id, rank, chunk_id, d.source AS source_name, d.text AS text_content
    FROM text_near JOIN documents d ON d.doc_id = chunk_id""")
def docs_by_id(spark, sf_dir):
    """The retrieved ids with the text and the metadata they name."""
    near = dense_text_topk(spark, sf_dir).select(F.col("query_id").alias("question_id"), "rank", "chunk_id")
    return dense.fetch(near, tables.chunks(spark, sf_dir))


@r.query("""
    SELECT row_no, list_transform(embedding, lambda x: round(format('{:.8f}', x::DOUBLE)::FLOAT::DOUBLE, 6)) AS embedding FROM (
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_no, embedding FROM embeddings)""")
def embedding_tsv_roundtrip(spark, sf_dir):
    """Vectors written as tab-separated text with eight decimals, read back, and numbered by line."""
    path = work_path(spark, "vectors-tsv")
    ordered = tables.vectors(spark, sf_dir).orderBy("chunk_id")
    vectors_text.write(ordered, path)
    back = vectors_text.read(spark, path)
    return back.select("row_no", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))
