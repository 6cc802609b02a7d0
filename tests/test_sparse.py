import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import entities, passages, sparse

DOCS = [(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, ["a"]), (5, ["c", "b"])]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(DOCS, "chunk_id bigint, terms array<string>")


@pytest.fixture(scope="module")
def index(documents):
    return sparse.fit(documents)


def idf(df, n=len(DOCS)):
    return math.log((1 + n) / (1 + df)) + 1


def test_vocabulary_counts_all_documents(index):
    got = {r["term"]: (r["df"], round(r["idf"], 9)) for r in index.vocabulary.collect()}
    assert got == {t: (d, round(idf(d), 9)) for t, d in {"a": 2, "b": 3, "c": 1}.items()}


def test_rows_have_unit_length(index):
    squares = sparse.weights(index).groupBy("chunk_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert {r["chunk_id"] for r in squares} == {1, 2, 4, 5}
    assert all(abs(r["s"] - 1) < 1e-12 for r in squares)


def test_scores_by_hand(spark, index):
    asked = spark.createDataFrame([(7, ["a", "zzz", "b"])], "question_id bigint, terms array<string>")
    got = [(r["rank"], r["chunk_id"], r["score"]) for r in sparse.search(index, asked, 10).orderBy("rank").collect()]
    a, b, c = idf(2), idf(3), idf(1)
    q = math.hypot(a, b)
    expect = {
        1: (2 * a * a + b * b) / (math.hypot(2 * a, b) * q), 2: b / q, 4: a / q, 5: b * b / (math.hypot(c, b) * q),
    }
    order = sorted(expect, key=lambda i: (-round(expect[i], 6), i))
    assert [(r, i) for r, i, _ in got] == [(n + 1, i) for n, i in enumerate(order)]
    assert all(abs(s - expect[i]) < 1e-6 for _, i, s in got)


def test_equal_scores_rank_by_id(spark):
    index = sparse.fit(spark.createDataFrame([(9, ["x"]), (3, ["x"]), (5, ["x"])], "chunk_id bigint, terms array<string>"))
    asked = spark.createDataFrame([(1, ["x"])], "question_id bigint, terms array<string>")
    assert [r["chunk_id"] for r in sparse.search(index, asked, 2).orderBy("rank").collect()] == [3, 5]


def test_unknown_terms_and_zero_fill(spark, documents, index):
    asked = spark.createDataFrame([(1, ["nope"]), (2, ["c"])], "question_id bigint, terms array<string>")
    found = sparse.search(index, asked, 3).collect()
    assert [(r["question_id"], r["chunk_id"]) for r in found] == [(2, 5)]
    filled = sparse.search(index, asked, 3, fill_zeros=True).orderBy("question_id", "rank").collect()
    # Chunk 3 has no terms, so it has no norm row and is not offered.
    assert [(r["question_id"], r["chunk_id"]) for r in filled] == [(1, 1), (1, 2), (1, 4), (2, 5), (2, 1), (2, 2)]


def test_hot_terms_split_from_cold_ones(spark, monkeypatch):
    rows = [(i, ["hot"] * 2 + [f"t{i}"]) for i in range(300)]
    docs = spark.createDataFrame(rows, "chunk_id bigint, terms array<string>")
    whole = {(r["term"], r["chunk_id"]): r["weight"] for r in sparse.weights(sparse.fit(docs)).collect()}
    monkeypatch.setattr(sparse, "HOT_SHARE", 10)
    split = {(r["term"], r["chunk_id"]): r["weight"] for r in sparse.weights(sparse.fit(docs, store=False)).collect()}
    assert len(split) == 600 and split.keys() == whole.keys()
    assert all(abs(split[k] - whole[k]) < 1e-12 for k in whole)


def test_shuffle_and_broadcast_searches_agree(spark, index):
    asked = spark.createDataFrame([(i, ["a", "b", "c"][: i % 3 + 1]) for i in range(20)], "question_id bigint, terms array<string>")
    rows = [sorted(map(tuple, sparse.search(index, asked, 3, small=s).collect())) for s in (True, False)]
    assert rows[0] == rows[1]


def test_save_and_load(spark, index, tmp_path):
    sparse.save_index(index, str(tmp_path / "ix"))
    loaded = sparse.load_index(spark, str(tmp_path / "ix"))
    asked = spark.createDataFrame([(7, ["a", "b"])], "question_id bigint, terms array<string>")
    assert sparse.search(loaded, asked, 4).collect() == sparse.search(index, asked, 4).collect()


def test_document_terms(spark):
    rows = spark.createDataFrame(
        [([(" New\tYork ",), ("",)], ["2024-10-13T08:00:00"], ["2024-01-01"]), ([], [], [])],
        "e array<struct<entity:string>>, d array<string>, a array<string>",
    )
    got = [r[0] for r in rows.select(sparse.document_terms("e", "d", "a")).collect()]
    assert got == [["new york", "2024-10-13", "2024-01-01"], []]
    assert rows.select(sparse.document_terms("e", "d", "a", keep_empty_term=True)).collect()[1][0] == [""]


def test_query_terms(one):
    assert one(sparse.query_terms("e", "d"), e=["PPG Arena "], d=["2024-10-13"]) == ["ppg arena", "2024-10-13"]


def test_entities(spark, one):
    assert one(entities.phrases("t"), t="met Andy  Warhol and UPMC in Ohio") == ["andy warhol", "upmc", "ohio"]
    chunks = spark.createDataFrame([(1, "the Point State Park, point state"), (2, "none")], "chunk_id bigint, text_content string")
    names = spark.createDataFrame([("point state park",), ("point",)], "entity string")
    found = {(r["chunk_id"], r["entity"], r["n_mentions"]) for r in entities.dictionary_matches(chunks, names).collect()}
    assert found == {(1, "point state park", 1), (1, "point", 2)}


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_containment_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(passages, "BROADCAST_BYTES", limit)
    texts = ["alpha beta gamma delta", "xalpha beta  gamma", "beta gamma", "", "a\nb c d e", "alpha", "ééa b"]
    wanted = ["lpha beta gamma", "beta", "beta gamma", "a", "b c d", "pha beta gamma de", " ", "\nb", "éa b", "zeta"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text_content string")
    asked = spark.createDataFrame(list(enumerate(wanted)), "passage_id bigint, passage string")
    got = {tuple(r) for r in passages.containing_chunks(asked, chunks).collect()}
    assert got == {(i, j) for i, w in enumerate(wanted) for j, t in enumerate(texts) if w in t}


def test_pairs_of_chunk_and_question_are_summed_where_the_chunk_lies(spark, tmp_path):
    import re

    documents = spark.createDataFrame([(i, ["a", "b", f"w{i % 7}"]) for i in range(60)], "chunk_id bigint, terms array<string>")
    questions = spark.createDataFrame([(1, ["a", "w3"]), (2, ["b", "b", "w5"]), (3, ["none"])], "question_id bigint, terms array<string>")
    index = sparse.fit(documents)
    sparse.save_index(index, str(tmp_path / "index"))
    rows = []
    for held in (index, sparse.load_index(spark, str(tmp_path / "index"))):
        found = sparse.search(held, questions, 5)
        assert not re.search(r"hashpartitioning\(chunk_id#\d+L, question_id", found._jdf.queryExecution().executedPlan().toString())
        rows.append(sorted(map(tuple, found.collect())))
    large = sorted(map(tuple, sparse.search(index, questions, 5, small=False).collect()))
    assert rows[0] == rows[1] == large and [r[2] for r in rows[0]] == [3, 10, 17, 24, 31, 5, 12, 19, 26, 33]


def test_a_chunk_stays_one_row_until_it_has_met_its_norm(spark, documents, index):
    assert {r["chunk_id"]: {c["term"]: c["tf"] for c in r["counts"]} for r in index.rows.collect()} == {
        1: {"a": 2, "b": 1}, 2: {"b": 1}, 3: {}, 4: {"a": 1}, 5: {"b": 1, "c": 1}}
    got = {(r["chunk_id"], r["term"]): r["weight"] for r in sparse.weights(index).collect()}
    a, b, c = idf(2), idf(3), idf(1)
    wanted = {(1, "a"): 2 * a / math.hypot(2 * a, b), (1, "b"): b / math.hypot(2 * a, b), (2, "b"): 1, (4, "a"): 1,
              (5, "b"): b / math.hypot(b, c), (5, "c"): c / math.hypot(b, c)}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-12 for k in wanted)
    rows = spark.createDataFrame([(1, None), (2, []), (3, ["x", None, "x", "é"])], "chunk_id bigint, terms array<string>")
    assert {tuple(r) for r in sparse.term_counts(rows, "chunk_id").collect()} == {(3, "x", 2), (3, None, 1), (3, "é", 1)}


def test_blocks_of_chunks_score_like_single_pairs(spark):
    import random

    rng = random.Random(3)
    words = [f"w{int(40 * rng.random() ** 3)}" for _ in range(4000)]
    docs = spark.createDataFrame([(i, words[(i % 150) * 13:][:1 + i % 12]) for i in range(300)], "chunk_id bigint, terms array<string>")
    asked = spark.createDataFrame([(f"q{i}", rng.choices(words, k=1 + i % 9)) for i in range(30)], "question_id string, terms array<string>")
    index = sparse.fit(docs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # chunks go on in the next batch
    try:
        blocks = sparse.search(index, asked, 6)
        assert "MapInArrow" in blocks._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, blocks.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(tuple, sparse.search(index, asked, 6, small=False).collect())) and len(got) > 100
