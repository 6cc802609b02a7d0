import pytest
from pyspark.sql import functions as F

from lodestone.config import IndexConfig, RetrievalConfig
from lodestone.functions.text import words
from lodestone.operators import dense, infer, retrieve, sparse
from lodestone.plans import answering, standins

CHUNKS = [
    (1, "s1", "The incline opened in 1877. It climbs a hill."),
    (2, "s2", "Bridges cross three rivers. The city has many bridges."),
    (3, "s1", "A museum shows pop art. It opened in 1994.\nSecond line."),
    (4, "s3", "Rivers meet at the point."),
]
QUESTIONS = [(1, 2, "how many bridges cross the rivers", "many"), (2, 3, "when opened the museum of pop art", "1994")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id bigint, source_name string, text_content string")


@pytest.fixture(scope="module")
def questions(spark):
    df = spark.createDataFrame(QUESTIONS, "question_id bigint, chunk_id bigint, question string, gt_answer string")
    return df.withColumn("terms", words("question"))


@pytest.fixture(scope="module")
def corpus(chunks):
    vectors = dense.hashed_vectors(chunks, "chunk_id", "text_content", 32)
    index = sparse.fit(chunks.select("chunk_id", words("text_content").alias("terms")))
    return answering.Corpus(chunks, vectors, index, dim=32)


MODELS = answering.Models(reader=standins.echo_reader, generator=standins.line_summarizer)


def rankings(spark, rows):
    return spark.createDataFrame(rows, "question_id bigint, rank int, chunk_id bigint")


def test_fusion_keeps_both_copies_sparse_first(spark):
    fused = retrieve.fuse(rankings(spark, [(1, 1, 7), (1, 2, 8)]), rankings(spark, [(1, 1, 8), (2, 1, 9)]))
    assert sorted(map(tuple, fused.collect())) == [
        (1, 1, 7, "sparse"), (1, 2, 8, "sparse"), (1, 3, 8, "dense"), (2, 1, 9, "dense"),
    ]
    once = retrieve.fuse(rankings(spark, [(1, 1, 7)]), rankings(spark, [(1, 1, 7), (1, 2, 6)]), dedup=True)
    assert sorted(map(tuple, once.collect())) == [(1, 1, 7, "sparse"), (1, 2, 6, "dense")]


PAIRS = "question_id bigint, rank int, chunk_id bigint, question string, text_content string"


def test_rerank(spark):
    pairs = spark.createDataFrame([
        (1, 1, 10, "a b c", "a"), (1, 2, 11, "a b c", "c b a"), (1, 3, 12, "a b c", "b"), (1, 4, 13, "a b c", "x"),
    ], PAIRS)
    assert [(r["rank"], r["chunk_id"]) for r in retrieve.rerank(pairs, n=3).orderBy("rank").collect()] == [(1, 11), (2, 10), (3, 12)]
    assert [r["chunk_id"] for r in retrieve.rerank(pairs, fraction=1 / 3).orderBy("rank").collect()] == [11, 10]

    def longest():
        return lambda batch: [float(len(passage)) for _, passage in batch]

    assert retrieve.rerank(pairs, n=1, scorer=longest).head()["chunk_id"] == 11
    with pytest.raises(ValueError):
        retrieve.rerank(pairs)


def test_expansion_without_the_header_adds_nothing(spark):
    asked = spark.createDataFrame([(1, "why")], "question_id bigint, question string")

    def silent():
        return lambda batch: ["no header"] * len(batch)

    assert retrieve.expand_with_model(asked, silent).head()["expanded"] == "why\n"
    assert retrieve.expand_with_model(asked, standins.echo_expander).head()["expanded"] == "why\nwhy"


def test_summaries(spark):
    pairs = spark.createDataFrame([(1, 1, 5, "red fox", "A dog. The red fox ran. A fox! Red red. fox den. End.")], PAIRS)
    row = retrieve.summarize(pairs).head()
    assert row["text_content"] == "The red fox ran. A fox! Red red." and row["original_text"].startswith("A dog.")
    assert retrieve.summarize(pairs.withColumn("question", F.lit("zebra"))).head()["text_content"] == ""
    copied = retrieve.summarize(pairs.withColumn("text_content", F.lit("one\ntwo")), standins.line_summarizer).head()
    assert (copied["text_content"], copied["original_text"]) == ("one", "one\ntwo")


def test_contexts_follow_the_rank(spark):
    pairs = spark.createDataFrame([(1, 2, 5, "q", "second"), (1, 1, 9, "q", "first")], PAIRS)
    row = retrieve.contexts(pairs).head()
    assert row["context"] == "first\n\nsecond" and row["retrieved_chunk_ids"] == [9, 5]


def test_inference_runs_the_model_in_batches(spark, tmp_path):
    marks = str(tmp_path)

    def build():
        import os
        import uuid

        open(os.path.join(marks, uuid.uuid4().hex), "w").close()

        def shout(batch):
            assert len(batch) <= 3
            return [b.upper() for b in batch]

        return shout

    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id bigint, t string").repartition(4)
    out = infer.run(df, build, "t", "u", batch_size=3, key="shout")
    assert {(r["id"], r["u"]) for r in out.collect()} == {(i, f"T{i}") for i in range(20)}
    import os

    # Built once per Python worker, however many batches and tasks it serves.
    assert 1 <= len(os.listdir(marks)) <= 8

    def short():
        return lambda batch: batch[1:]

    with pytest.raises(Exception, match="results for"):
        infer.run(df, short, "t", "u").collect()


def test_inference_over_questions(questions, corpus):
    conf = RetrievalConfig(dense_k=3, sparse_enabled=True, sparse_k=2, rerank_k=2)
    rows = {r["question_id"]: r["answer"] for r in answering.run("inference", questions, corpus, MODELS, conf).collect()}
    assert rows[1].startswith("Bridges cross three rivers.") and rows[2].startswith("A museum shows pop art.")
    with pytest.raises(ValueError, match="unknown mode"):
        answering.run("training", questions, corpus, MODELS, conf)


@pytest.mark.parametrize("conf", [
    RetrievalConfig(dense_k=3, rerank_enabled=False, hyde_enabled=False, summary_enabled=False),
    RetrievalConfig(dense_k=3, sparse_enabled=True, sparse_k=2, rerank_enabled=False, hyde_enabled=False, summary_enabled=False),
    RetrievalConfig(dense_k=3, rerank_query="expanded"),
])
def test_retrieval_shapes(questions, corpus, conf):
    pairs = answering.retrieve_chunks(questions, corpus, MODELS, conf).collect()
    per = {}
    for r in pairs:
        per.setdefault(r["question_id"], []).append(r["rank"])
    width = conf.rerank_k if conf.rerank_enabled else conf.dense_k + (conf.sparse_k if conf.sparse_enabled else 0)
    assert {q: sorted(ranks) for q, ranks in per.items()} == {1: list(range(1, width + 1)), 2: list(range(1, width + 1))}


def test_approximate_indexes_and_an_injected_encoder(questions, corpus, chunks):
    def build():
        return lambda batch: [[float(len(t)), float(t.count("e")), 1.0, 0.0] for t in batch]

    models = answering.Models(reader=standins.echo_reader, encoder=build)
    vectors = infer.run(chunks, build, "text_content", "embedding", "array<float>").select("chunk_id", "embedding")
    plain = dict(dense_k=2, rerank_enabled=False, hyde_enabled=False, summary_enabled=False)
    centroids = dense.fit_centroids(vectors, 2)[0]
    books = dense.fit_centroids(vectors, 4, n_parts=2)
    exact = answering.Corpus(chunks, vectors)
    cells = answering.Corpus(chunks, dense.assign_cells(vectors, centroids), centroids=centroids)
    codes = answering.Corpus(chunks, vectors, codes=dense.encode_pq(vectors, books), codebooks=books)

    def found(index_type, where):
        conf = RetrievalConfig(**plain, index=IndexConfig(index_type, n_probe=2))
        rows = answering.retrieve_chunks(questions, where, models, conf).collect()
        return sorted((r["question_id"], r["rank"], r["chunk_id"]) for r in rows)

    assert found("exact", exact) == found("hnsw", cells) == found("hnsw_pq", codes)


def test_sources_carry_the_original_text(questions, corpus):
    conf = RetrievalConfig(dense_k=3, rerank_k=1)
    rows = answering.answer_with_sources(questions, corpus, MODELS, conf).collect()
    texts = {c: (s, t) for c, s, t in CHUNKS}
    for r in rows:
        (source,) = r["sources"]
        assert (source["name"], source["text"]) == texts[source["index_id"]]


def test_validation_records_and_scores(questions, corpus):
    conf = RetrievalConfig(dense_k=3, rerank_k=2)
    records = answering.run("validation", questions, corpus, MODELS, conf)
    rows = {r["question_id"]: r for r in records.collect()}
    assert rows[1]["gt_chunk_id"] == 2 and rows[1]["retrieved_chunk_ids"][0] == 2
    assert rows[1]["raw_output"].endswith(rows[1]["generated_answer"]) and "### Context\n" in rows[1]["raw_output"]
    scores = answering.validation_metrics(records, batch=2).collect()
    assert sorted(((r["batch_id"] if r["batch_id"] is not None else -1), r["n_questions"]) for r in scores) == [(-1, 2), (0, 2)]
    total = next(r for r in scores if r["batch_id"] is None)
    assert total["recall"] == 1.0 and total["mrr"] == 1.0


def test_models_of_equal_names_stay_apart(spark):
    def times(n):
        def build():
            return lambda batch: [n * b for b in batch]

        return build

    df = spark.createDataFrame([(i,) for i in range(8)], "v bigint")
    for n in (2, 3, 5):
        assert {r["v"]: r["w"] for r in infer.run(df, times(n), "v", "w", "bigint").collect()} == {i: n * i for i in range(8)}


def test_question_terms(spark):
    asked = spark.createDataFrame([(1, "Who plays at PPG Arena on October 13, 2024?")], "question_id bigint, question string")
    row = answering.question_terms(asked, MODELS).head()
    assert row["terms"] == ["who", "ppg arena", "october", "2024-10-13"]

    def finder():
        return lambda batch: [[" PPG Arena "] for _ in batch]

    models = answering.Models(reader=standins.echo_reader, entity_finder=finder)
    assert answering.question_terms(asked, models).head()["terms"] == ["ppg arena", "2024-10-13"]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        RetrievalConfig(rerank_query="both")


def test_each_model_runs_once_for_each_question_and_passage(spark, questions, corpus):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        def generate(batch):
            calls.add(len(batch))
            return [b + "\n### Summary\nshort" for b in batch]

        return generate

    conf = RetrievalConfig(dense_k=3, rerank_k=2, hyde_enabled=True, summary_enabled=True)
    models = answering.Models(reader=MODELS.reader, generator=counting)
    rows = answering.answer_with_sources(questions, corpus, models, conf).collect()
    assert len(rows) == questions.count()
    assert calls.value == len(rows) + sum(len(r["sources"]) for r in rows)
