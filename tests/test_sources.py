import json

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import dense
from lodestone.sources import lines, records, sitemap, tables, vectors_text
from lodestone.streaming import ingest


def test_lines_keep_order_and_blanks(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\ntwo\n")
    (tmp_path / "b.txt").write_text("three\n" * 3)
    rows = lines.read_questions(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [(0, "one"), (1, ""), (2, "two"), (3, "three"), (4, "three"), (5, "three")]


def test_line_numbers_over_many_blocks(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        rows = lines.read_questions(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5000 and all(int(r["question"]) == r["line_no"] for r in rows)


def test_answers_text(spark, tmp_path):
    df = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "line_no bigint, answer string")
    lines.write_answers(df, str(tmp_path / "out"), single_file=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b", "c"]


def test_vectors_round_trip_and_alignment(spark, tmp_path):
    vectors = spark.createDataFrame([([0.123456789, -1.0],), ([2.0, 3.5],), ([0.0, 1.0],)], "embedding array<float>").coalesce(1)
    vectors_text.write(vectors, str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).head()[0] == "0.12345679\t-1.00000000"
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "row_no bigint, text string")
    rows = vectors_text.align(texts, vectors_text.read(spark, str(tmp_path / "v"))).orderBy("row_no").collect()
    assert [(r["text"], [round(x, 6) for x in r["embedding"]]) for r in rows] == [
        ("t0", [0.123457, -1.0]), ("t1", [2.0, 3.5]), ("t2", [0.0, 1.0]),
    ]


def test_questions_and_answers_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question_id": "7", "chunk_id": 3, "question": "é?", "gt_answer": "a"}\nbroken\n')
    rows = records.read_questions(spark, str(tmp_path / "q.jsonl")).collect()
    assert (rows[0]["question_id"], rows[0]["chunk_id"], rows[0]["question"]) == (7, 3, "é?") and rows[1]["question_id"] is None
    with pytest.raises(Exception):
        records.read_questions(spark, str(tmp_path / "q.jsonl"), strict=True).collect()
    answers = spark.createDataFrame([(7, 3, "é?", "a", [3, 4], "raw", "ctx", "gen", 1)], "question_id bigint, gt_chunk_id bigint, question string, gt_answer string, retrieved_chunk_ids array<bigint>, raw_output string, retrieved_context string, generated_answer string, extra int")
    records.write_answers(answers, str(tmp_path / "out"))
    (line,) = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert line == {"question_id": 7, "gt_chunk_id": 3, "question": "é?", "gt_answer": "a", "retrieved_chunk_ids": [3, 4],
                    "raw_output": "raw", "retrieved_context": "ctx", "generated_answer": "gen"}
    assert [f.name for f in schemas.ANSWER.fields] == list(line)


def test_chunk_table_by_cell(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id bigint, embedding array<float>")
    centroids = dense.fit_centroids(df, 2)[0]
    tables.save_chunk_table(dense.assign_cells(df, centroids), str(tmp_path / "t"))
    loaded = tables.load_chunk_table(spark, str(tmp_path / "t"))
    asked = df.withColumnRenamed("chunk_id", "query_id")
    found = dense.search_cells(asked, loaded, centroids, 1, 1).collect()
    assert all(r["query_id"] == r["chunk_id"] for r in found) and len(found) == 2


SCHEMA = "chunk_id bigint, text_content string"


def drop(path, rows):
    path.write_text("".join(json.dumps({"chunk_id": c, "text_content": t}) + "\n" for c, t in rows))


@pytest.mark.parametrize("start", [ingest.start, ingest.start_against_sink])
def test_ingestion_is_once_per_id_over_restarts(spark, tmp_path, start):
    from pyspark.sql.types import _parse_datatype_string

    inbox = tmp_path / "in"
    inbox.mkdir()
    schema = _parse_datatype_string(SCHEMA)
    seen = []

    def once():
        stream = ingest.read_stream(spark, str(inbox), schema, files_per_trigger=1)
        embed = lambda df: df.withColumn("n", F.length("text_content"))
        start(stream, embed, str(tmp_path / "sink"), str(tmp_path / "check")).awaitTermination()
        return sorted((r["chunk_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "sink")).collect())

    drop(inbox / "1.json", [(1, "a"), (2, "bb"), (1, "a")])
    drop(inbox / "2.json", [(2, "bb"), (3, "ccc")])
    assert once() == [(1, 1), (2, 2), (3, 3)]
    drop(inbox / "3.json", [(3, "ccc"), (4, "dddd")])
    assert once() == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert once() == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_appended_vectors_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "vectors")
    for start in (0, 1_000, 2_000):
        batch = spark.range(start, start + 1_000, 1, 3).select(F.array(F.col("id").cast("float")).alias("embedding"))
        vectors_text.write(batch, path)
    rows = spark.range(3_000).select(F.col("id").alias("row_no"), F.col("id").alias("text"))
    pairs = vectors_text.align(rows, vectors_text.read(spark, path))
    assert pairs.count() == 3_000 and pairs.filter(F.col("embedding")[0] != F.col("text")).count() == 0
    vectors_text.write(rows.limit(5).select(F.array(F.lit(1.0)).alias("embedding")), path, mode="overwrite")
    assert vectors_text.read(spark, path).count() == 5


def test_part_files_follow_by_number(spark, tmp_path):
    for name, line in (("part-99999-a.txt", "first"), ("part-100000-a.txt", "second")):
        (tmp_path / name).write_text(line + "\n")
    got = lines.read_questions(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.question for r in got] == ["first", "second"]


def test_broken_lines_can_be_kept(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question_id": 1, "question": "a"}\nnot json\n')
    rows = records.read_json(spark, str(tmp_path / "q.jsonl"), schemas.QUESTION_FILE, corrupt="broken").collect()
    assert sorted((r.question_id or "", r.broken or "") for r in rows) == [("", "not json"), ("1", "")]


def test_nested_sitemap_indexes_are_followed_to_the_end(spark, tmp_path):
    def index(*names):
        return "<sitemapindex>" + "".join(f"<sitemap><loc> https://a.com/{n} </loc></sitemap>" for n in names) + "</sitemapindex>"

    def urls(*names):
        return "<urlset>" + "".join(f"<url><loc>https://a.com/{n}</loc></url>" for n in names) + "</urlset>"

    files = {
        "top.xml": index("mid.xml", "leaf1.xml"), "mid.xml": index("low.xml", "top.xml", "missing.xml"),
        "low.xml": index("mid.xml", "leaf2.xml", "leaf1.xml"), "leaf1.xml": urls("p1", "p2"), "leaf2.xml": urls("p3"),
        "alone.xml": urls("p4"),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    catalog = spark.createDataFrame([(f"https://a.com/{n}", n) for n in files] + [(None, "x")], "loc string, name string")

    def found(*roots):
        start = spark.createDataFrame([(f"https://a.com/{n}",) for n in roots], "loc string")
        return sorted(r.loc[-2:] for r in sitemap.read_tree(spark, str(tmp_path), catalog, start).collect())

    assert found("top.xml") == ["p1", "p2", "p3"]
    assert found("low.xml", "low.xml", "leaf2.xml") == ["p1", "p2", "p3"]
    assert found("leaf1.xml") == ["p1", "p2"] and found("missing.xml") == [] and found() == []


def test_stream_ingest_reads_a_table_of_one_file_or_of_many(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "One two", "a"), (2, None, None), (3, "three", "b"), (4, "", "c")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    documents.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    documents.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    ask = entry.queries()["stream_ingest"]
    found = [sorted(ask(spark, str(tmp_path / kind)).collect()) for kind in ("one", "many")]
    assert [r["chunk_id"] for r in found[1]] == [1, 2, 3, 4] and found[0] == found[1]
