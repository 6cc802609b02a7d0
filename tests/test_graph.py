"""The neighbour graph against brute force."""

import numpy as np
import pytest

from lodestone.config import IndexConfig, RetrievalConfig
from lodestone.operators import dense, graph
from lodestone.plans import answering, standins


@pytest.fixture(scope="module")
def built(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(12, 8)), 50, axis=0) * 3 + rng.normal(size=(600, 8))
    x[7] = x[9]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (700, None)],
                                    "chunk_id bigint, embedding array<double>")
    return x, vectors, graph.build(vectors, degree=8, sample=16)


def test_edges_are_near_exact_and_bounded(built):
    x, _, g = built
    edges = g.edges.toPandas()
    gaps = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    assert np.allclose(gaps[edges.chunk_id, edges.neighbor_id], edges.distance, atol=2e-6)
    assert (edges.groupby("chunk_id").size() == 8).all() and (edges.chunk_id != edges.neighbor_id).all()
    np.fill_diagonal(gaps, np.inf)
    limit = np.sort(gaps, axis=1)[:, 7]
    assert (edges.distance <= limit[edges.chunk_id] + 1e-5).mean() > 0.9
    assert max(len(r.neighbors) for r in g.links.collect()) <= 16


def test_search_finds_the_neighbours_and_looks_at_few(spark, built):
    x, vectors, g = built
    vectors = vectors.filter("embedding is not null")
    queries = vectors.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    true = dense.search_exact(queries, vectors.distinct(), 5, exclude_self=True)
    found = graph.search(queries, vectors.distinct(), g.links, 5, beam=32, exclude_self=True).cache()
    assert graph.recall_of(found, true) >= 0.95
    rows = found.collect()
    assert all(r.query_id != r.chunk_id and r.visited < 400 for r in rows) and len(rows) == 5 * 30
    gaps = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    assert all(abs(gaps[r.query_id, r.chunk_id] - r.distance) < 2e-6 for r in rows)


def test_answering_takes_the_graph_and_nothing_breaks_on_empty(spark):
    chunks = spark.createDataFrame([(i, "s", t) for i, t in enumerate(["red fox", "blue whale", "green frog"])],
                                   "chunk_id bigint, source_name string, text_content string")
    vectors = dense.hashed_vectors(chunks, "chunk_id", "text_content", 16)
    asked = spark.createDataFrame([(1, "a blue whale")], "question_id bigint, question string")
    conf = RetrievalConfig(dense_k=2, rerank_enabled=False, hyde_enabled=False, summary_enabled=False, index=IndexConfig("hnsw"))
    corpus = answering.Corpus(chunks, vectors, links=graph.build(vectors).links, dim=16)
    models = answering.Models(reader=standins.echo_reader)
    first = answering.retrieve_chunks(asked, corpus, models, conf).orderBy("rank").collect()
    assert first[0].chunk_id == 1 and len(first) == 2
    centroids = dense.fit_centroids(vectors, 2)[0]
    cells = answering.Corpus(chunks, dense.assign_cells(vectors, centroids), centroids=centroids, dim=16)
    assert answering.retrieve_chunks(asked, cells, models, conf).orderBy("rank").first().chunk_id == 1
    none = graph.build(vectors.limit(0))
    assert none.links.count() == 0


def test_shards_bound_the_work_and_a_query_walks_through_all_of_them(spark, built):
    x, vectors, _ = built
    vectors = vectors.filter("embedding is not null").distinct()
    g = graph.build(vectors, degree=8, sample=12, shard=150)
    links = g.links.toPandas()
    shard_of = dict(zip(links.chunk_id, links["shard"]))
    assert links.groupby("shard").size().between(80, 250).all() and links["shard"].nunique() == 4 and len(links) == 600
    assert max(map(len, links.neighbors)) <= 12
    edges = g.edges.toPandas()
    assert all(shard_of[a] == shard_of[b] for a, b in zip(edges.chunk_id, edges.neighbor_id)) and (edges.groupby("chunk_id").size() == 8).all()
    queries = vectors.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    found = graph.search(queries, vectors, g.links, 5, beam=32, exclude_self=True).cache()
    assert graph.recall_of(found, dense.search_exact(queries, vectors, 5, exclude_self=True)) >= 0.95
    assert all(4 * 64 <= r.visited < 600 for r in found.collect())
