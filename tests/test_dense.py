import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.config import IndexConfig
from lodestone.functions.text import words
from lodestone.operators import dense, sparse

N, DIM, K = 400, 16, 5
SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, DIM)) + 4 * rng.normal(size=(8, DIM))[rng.integers(0, 8, N)]
    x[10:14] = x[9]  # copies, to have ties
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark, matrix):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(matrix)], "chunk_id bigint, embedding array<float>")


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.select(F.col("chunk_id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def truth(matrix):
    x = matrix.astype(np.float64)
    d = np.round(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 6)
    np.fill_diagonal(d, np.inf)
    return {q: [int(c) for c in np.lexsort((np.arange(N), d[q]))[:K]] for q in range(N)}


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


def test_exact(queries, vectors, truth):
    assert ranked(dense.search_exact(queries, vectors, K, exclude_self=True)) == truth


def test_blocks(monkeypatch, queries, vectors, truth):
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 90)
    monkeypatch.setattr(dense, "BLOCK_VECTORS", 70)
    assert ranked(dense.search_blocks(queries, vectors, K, exclude_self=True)) == truth


def test_large_query_sets_take_the_block_path(monkeypatch, queries, vectors, truth):
    monkeypatch.setattr(dense, "QUERY_BYTES", 64)
    assert ranked(dense.search_exact(queries, vectors, K, exclude_self=True)) == truth


def test_own_chunk_is_first_unless_excluded(queries, vectors):
    first = dense.search_exact(queries, vectors, 1).collect()
    assert all(r["distance"] == 0 for r in first)
    assert sum(r["query_id"] == r["chunk_id"] for r in first) == N - 4


def recall(found, truth):
    return np.mean([len(set(found.get(q, [])) & set(truth[q])) / K for q in truth])


def test_cells(monkeypatch, queries, vectors, truth):
    centroids = dense.fit_centroids(vectors, 12)[0]
    celled = dense.assign_cells(vectors, centroids)
    some = ranked(dense.search_cells(queries, celled, centroids, K, 4, exclude_self=True))
    assert recall(some, truth) > 0.9
    assert ranked(dense.search_cells(queries, celled, centroids, K, 12, exclude_self=True)) == truth
    monkeypatch.setattr(dense, "QUERY_BYTES", 64)
    assert ranked(dense.search_cells(queries, celled, centroids, K, 4, exclude_self=True)) == some


def test_codes(monkeypatch, queries, vectors, truth):
    books = dense.fit_centroids(vectors, 32, n_parts=4)
    codes = dense.encode_pq(vectors, books)
    found = dense.search_pq(queries, vectors, codes, books, K, 6, exclude_self=True)
    assert recall(ranked(found), truth) > 0.9
    rough = ranked(dense.search_pq(queries, vectors, codes, books, K, 0, exclude_self=True))
    assert 0.2 < recall(rough, truth) <= 1
    monkeypatch.setattr(dense, "QUERY_BYTES", 64)
    assert ranked(dense.search_pq(queries, vectors, codes, books, K, 0, exclude_self=True)) == rough


def test_rescored_distances_are_exact(queries, vectors, matrix):
    found = dense.search(queries, vectors, K, IndexConfig("hnsw_pq", pq_m=4, pq_bits=5), exclude_self=True).collect()
    for r in found[:50]:
        gap = matrix[r["query_id"]].astype(float) - matrix[r["chunk_id"]].astype(float)
        assert abs(r["distance"] - (gap**2).sum()) < 2e-6


def test_dispatch(queries, vectors, truth):
    found = dense.search(queries, vectors, K, IndexConfig("hnsw", n_cells=10, n_probe=10), exclude_self=True)
    assert ranked(found) == truth
    with pytest.raises(ValueError, match="unknown index type"):
        IndexConfig("flat")


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, ""), (3, "TWO one two")], "k bigint, t string")
    rows = {r["k"]: np.array(r["embedding"]) for r in dense.hashed_vectors(df, "k", "t", 32).collect()}
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-12 and not rows[2].any() and np.allclose(rows[1], rows[3])
    long = dense.hashed_weights(df, "k", "t", 32).filter("k = 1").collect()
    assert {r["bucket"]: round(r["weight"], 9) for r in long} == {i: round(w, 9) for i, w in enumerate(rows[1]) if w}


def test_counted_words_give_the_same_vectors(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "é é ü")], "k bigint, t string")
    counts = sparse.term_rows(df.select("k", words("t").alias("terms")), "k")
    rows = [sorted(map(tuple, of.collect())) for of in (dense.hashed_vectors(df, "k", "t", 8), dense.hashed_counts(counts, "k", "counts", 8))]
    assert rows[0] == rows[1] and [any(v) for _, v in rows[0]] == [True, False, False, True]


def test_fetch(spark):
    chunks = spark.createDataFrame([(1, "x"), (2, "y")], "chunk_id bigint, text_content string")
    ids = spark.createDataFrame([(7, 1, 2), (7, 2, 1), (8, 1, 9)], "question_id bigint, rank int, chunk_id bigint")
    for small in (True, False):
        got = {(r["question_id"], r["rank"], r["text_content"]) for r in dense.fetch(ids, chunks, small).collect()}
        assert got == {(7, 1, "y"), (7, 2, "x")}
    with pytest.raises(Exception, match="no chunk with id 9"):
        dense.fetch(ids, chunks, strict=True).collect()


def test_append_keeps_one_row_per_id(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "chunk_id bigint, v string").write.parquet(path)
    dense.append_new(spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "chunk_id bigint, v string"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]


def test_chunk_table(spark):
    chunks = spark.createDataFrame([(1, "x", "s", ["2024"])], "chunk_id bigint, text_content string, source_name string, associated_dates array<string>")
    vectors = spark.createDataFrame([(1, [0.5])], "chunk_id bigint, embedding array<float>")
    row = dense.chunk_table(chunks, vectors).head()
    assert row["metadata"].asDict() == {"source_name": "s", "associated_dates": ["2024"], "chunk_id": 1}


def test_both_ways_of_cell_search_agree_on_doubles(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    made = lambda n, key: spark.createDataFrame([(i, (rng.standard_normal(6) * 1e3).tolist()) for i in range(n)], f"{key} bigint, embedding array<double>")
    vectors, queries = made(300, "chunk_id"), made(40, "query_id")
    centroids = dense.fit_centroids(vectors, 8)[0]
    celled = dense.assign_cells(vectors, centroids)
    want = sorted(map(tuple, dense.search_cells(queries, celled, centroids, 5, 3).collect()))
    monkeypatch.setattr(dense, "QUERY_BYTES", 1)
    assert sorted(map(tuple, dense.search_cells(queries, celled, centroids, 5, 3).collect())) == want


def test_null_embeddings_are_named_as_such(spark):
    vectors = spark.createDataFrame([(1, [1.0]), (2, None)], "chunk_id bigint, embedding array<double>")
    queries = vectors.filter("chunk_id = 1").withColumnRenamed("chunk_id", "query_id")
    with pytest.raises(Exception, match="an embedding is NULL"):
        dense.search_exact(queries, vectors, 1).collect()


def test_append_makes_the_table_and_adds_only_new_ids(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "chunk_id bigint, text_content string")
    dense.append_new(rows, path)
    dense.append_new(rows.union(spark.createDataFrame([(3, "d")], rows.schema)), path)
    got = sorted(map(tuple, spark.read.parquet(path).collect()))
    assert [g[0] for g in got] == [1, 2, 3] and got[0][1] in "ab"


def test_probes_are_calibrated_on_nearly_random_vectors(spark):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, rng.standard_normal(24).tolist()) for i in range(1_500)], "chunk_id bigint, embedding array<double>")
    queries = vectors.withColumnRenamed("chunk_id", "query_id")
    truth = ranked(dense.search_exact(queries, vectors, K, exclude_self=True))
    found = ranked(dense.search(queries, vectors, K, IndexConfig("hnsw"), exclude_self=True))
    assert recall(found, truth) >= 0.9
    centroids = dense.fit_centroids(vectors, 16)[0]
    celled = dense.assign_cells(vectors, centroids)
    few, most = (dense.calibrate_probes(queries, celled, centroids, K, share, True) for share in (0.5, 1.0))
    assert 1 <= few < most <= 16
    assert 1 <= dense.calibrate_probes(queries.union(queries), celled, centroids, K, 0.5, True) <= 16
    assert dense.calibrate_probes(queries.limit(0), celled, centroids, K, 0.9) == 16


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_registered_cell_search_finds_the_neighbours_of_its_table(spark):
    found, truth = (ranked(entry.queries()[n](spark, SF_DIR)) for n in ("dense_topk_ivf", "dense_topk_exact"))
    assert np.mean([len(set(found.get(q, [])) & set(near)) / len(near) for q, near in truth.items()]) >= 0.9


def test_a_block_that_brings_nothing_nearer_sorts_nothing(monkeypatch, matrix):
    best = dense._Best(np.arange(N), matrix.astype(np.float64), K, True)
    best.add(np.arange(N), matrix.astype(np.float64))
    sorted_rows, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or real(keys))
    best.add(np.arange(N, 2 * N), matrix + 1_000.0)
    best.add(np.array([2 * N]), matrix[:1].astype(np.float64), np.arange(1))
    assert sum(sorted_rows) <= K + 1


def test_own_copies_do_not_take_the_places_of_others():
    x = np.array([[0.0], [0.0], [0.0], [0.0], [5.0], [7.0]])
    best = dense._Best(np.array([1]), np.zeros((1, 1)), 2, True)
    best.add(np.array([1, 1, 1, 1, 2, 3]), x)
    assert best.chunk.tolist() == [[2, 3]] and best.dist.tolist() == [[25.0, 49.0]]


def test_blocks_of_both_sides_are_large(monkeypatch, queries, vectors, truth):
    cut = []
    monkeypatch.setattr(dense, "stored", lambda df, name: cut.append(df) or df)
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 20)
    assert ranked(dense.search_blocks(queries, vectors, K, exclude_self=True)) == truth
    assert cut[0].select("nv", "nq").head() == (1, 1)


def test_coded_cells_hand_on_k_chunks_a_query_and_task(monkeypatch, queries, vectors):
    handed, real = [], dense._merge
    monkeypatch.setattr(dense, "_merge", lambda local, k: handed.append(local) or real(local, k))
    config = IndexConfig("hnsw_pq", n_cells=8, n_probe=8, pq_m=4, pq_bits=4)
    index = dense.fit_coded_cells(vectors, config)
    found = dense.search_coded_cells(queries, vectors, index, K, 8, exclude_self=True)
    assert found.count() == N * K
    tasks = handed[-1].rdd.getNumPartitions()
    assert len(handed) == 1 and handed[0].count() <= tasks * N * K
