import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, ranking, trainset
from lodestone.plans import standins
from lodestone.sources import records


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(0, 5, ["q1", "q2", "q3"], ["a1", "a2"]), (1, 6, [], ["x"]), (9000, 7, ["q4"], ["a4"])]
    return spark.createDataFrame(rows, "line_no bigint, chunk_id bigint, questions array<string>, answers array<string>")


def test_pairs_are_cut_and_numbered(entries):
    got = trainset.qa_pairs(entries, ["chunk_id"]).orderBy("question_id").collect()
    assert [(r["question_id"], r["chunk_id"], r["question"], r["gt_answer"], r["n_dropped"]) for r in got] == [
        (1, 5, "q1", "a1", 1), (2, 5, "q2", "a2", 1), (3, 7, "q4", "a4", 0),
    ]


def test_slice(spark):
    rows = spark.range(10).withColumnRenamed("id", "line_no")
    assert sorted(r[0] for r in trainset.line_slice(rows, 3, 6).collect()) == [3, 4, 5]


def test_split_is_an_exact_partition(spark):
    rows = spark.range(103)
    parts = trainset.split(rows, F.col("id"))
    sizes = {r["split"]: r["n_rows"] for r in trainset.split_sizes(parts).collect()}
    assert sizes == {"test": 21, "train": 82}
    assert sorted(r["id"] for r in parts.collect()) == list(range(103))
    again = trainset.split(rows.repartition(5), F.col("id"))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, again.collect()))
    assert {r["split"]: r["n_rows"] for r in trainset.split_sizes(trainset.split(spark.range(10), F.col("id"))).collect()} == {"test": 2, "train": 8}


def test_shuffle_is_a_permutation(spark):
    rows = trainset.shuffle(spark.range(500), F.col("id")).collect()
    assert sorted(r["position"] for r in rows) == list(range(500))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["position"])] != list(range(500))
    other = trainset.shuffle(spark.range(500), F.col("id"), seed=7).collect()
    assert {tuple(r) for r in rows} != {tuple(r) for r in other}


def test_running_number_over_uneven_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = ranking.running_number(df, F.when(F.col("v") < 900, 0).otherwise(F.col("v")), ["v"], "n").collect()
    assert all(r["v"] == r["n"] for r in got) and len(got) == 1000


def test_global_number_with_a_frequent_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    got = ranking.global_number(df.repartition(7), ["k", "v"], "n").collect()
    assert len(got) == 2000 and all(r["n"] == r["v"] for r in got)


def test_training_text(spark):
    qa = spark.createDataFrame([(1, 3, "who?", "me"), (2, 4, "no context", "x")], "question_id bigint, chunk_id bigint, question string, gt_answer string")
    chunks = spark.createDataFrame([(3, "ctx")], "chunk_id bigint, text_content string")
    (row,) = trainset.format_examples(trainset.join_context(qa, chunks), end="<end>").collect()
    assert row["text"].endswith("### Context:\nctx\n\n### Q:\nwho?\n\n### A:\nme<end>")


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a b  c\nd e"), (2, ""), (3, "x")], "doc_id bigint, text string")
    got = [(r["doc_id"], r["position"], r["n_tokens"], r["text_content"]) for r in chunking.chunk(df, 2).orderBy("chunk_id").collect()]
    assert got == [(1, 0, 2, "a b"), (1, 1, 2, "c d"), (1, 2, 1, "e"), (3, 0, 1, "x")]
    lapped = [r["text_content"] for r in chunking.chunk(df, 3, 1).filter("doc_id = 1").orderBy("chunk_id").collect()]
    assert lapped == ["a b c", "c d e"]
    with pytest.raises(ValueError):
        chunking.chunk(df, 2, 2)


def test_generation_writes_both_files(spark, tmp_path):
    source = tmp_path / "contexts.jsonl"
    rows = [
        {"chunk_id": "1", "source_id": "s", "source_name": "n", "text_content": "one two three four five six"},
        {"chunk_id": 2, "source_id": "s", "source_name": "n", "text_content": ["a b", "c d", "e f"]},
        {"chunk_id": 3, "source_id": "s", "source_name": "n", "text_content": ""},
        {"chunk_id": 4, "source_id": "s", "source_name": "n", "text_content": []},
    ]
    source.write_text("".join(json.dumps(r) + "\n" for r in rows))
    contexts = trainset.line_slice(records.read_contexts(spark, str(source), numbered=True), 0, 4)
    entries = trainset.generate_entries(contexts, standins.qa_writer)
    pairs, whole = str(tmp_path / "pairs"), str(tmp_path / "entries")
    records.write_entries_and_pairs(entries, pairs, whole, ["source_id", "chunk_id", "source_name"])
    got = spark.read.json(pairs).orderBy("question_id").collect()
    assert [(r["question_id"], r["chunk_id"], r["question"], r["gt_answer"]) for r in got] == [
        (1, 1, "what follows one two three?", "four five six"), (2, 2, "what follows a b c?", "d e f"),
    ]
    enriched = spark.read.json(whole).collect()
    assert {r["chunk_id"]: r["text_content"] for r in enriched} == {1: "one two three four five six", 2: "a b c d e f"}
