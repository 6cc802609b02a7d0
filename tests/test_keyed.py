"""The table that takes each id once: rows, reruns, and what a batch reads."""

import json

from pyspark.sql import functions as F

from lodestone.streaming import ingest, keyed


def rows(spark, ids, word):
    return spark.createDataFrame([(i, f"{word} {i}") for i in ids], "chunk_id bigint, text_content string")


def table(spark, sink):
    return sorted((r.chunk_id, r.text_content) for r in keyed.read(spark, sink).collect())


def test_each_id_is_taken_once_and_reruns_replace(spark, tmp_path):
    sink, seen = str(tmp_path / "sink"), []

    def mark(df):
        return df.withColumn("n", F.length("text_content"))

    keyed.append(rows(spark, [1, 2, 2, None, -5], "a"), mark, sink, 0, buckets=4)
    first = table(spark, sink)
    assert [i for i, _ in first] == [-5, 1, 2] and keyed.read(spark, sink).columns == ["chunk_id", "text_content", "n"]
    keyed.append(rows(spark, [2, 3, 3], "b"), mark, sink, 1, buckets=8)
    assert table(spark, sink) == sorted(first + [(3, "b 3")])
    # The same batch again, with other rows, replaces what it had written; the layout is that of the first use.
    keyed.append(rows(spark, [1, 4], "c"), mark, sink, 1)
    assert table(spark, sink) == sorted(first + [(4, "c 4")])
    assert keyed.create(spark, sink) == keyed.create(spark, sink, 99) and keyed.create(spark, sink)[0] == 4
    # A batch of nothing new, and an empty one.
    keyed.append(rows(spark, [1, 2, 4], "d"), mark, sink, 2)
    keyed.append(rows(spark, [], "e"), mark, sink, 3)
    keyed.append(rows(spark, [9], "f"), mark, sink, 4)
    assert table(spark, sink) == sorted(first + [(4, "c 4"), (9, "f 9")])


def test_a_batch_that_failed_before_its_summary_is_not_read(spark, tmp_path):
    sink = str(tmp_path / "sink")
    keyed.append(rows(spark, [1], "a"), lambda d: d, sink, 0, buckets=4)
    rows(spark, [2], "lost").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{sink}/rows/batch_id=1")
    assert table(spark, sink) == [(1, "a 1")]
    keyed.append(rows(spark, [1, 2], "b"), lambda d: d, sink, 1)
    assert table(spark, sink) == [(1, "a 1"), (2, "b 2")]


def test_a_batch_reads_only_where_its_ids_may_be(spark, tmp_path):
    sink = str(tmp_path / "sink")
    for n in range(6):
        keyed.append(spark.range(n * 3_000, (n + 1) * 3_000).select(F.col("id").alias("chunk_id")), lambda d: d, sink, n, buckets=16)
    assert keyed.read(spark, sink).count() == 18_000
    ids = rows(spark, [5, 3_007, 17_999], "x").select("chunk_id")
    maybe, folders = keyed.groups_to_read(ids, sink)
    true = {(5, 0), (3_007, 1), (17_999, 5)}
    found = {(r.chunk_id, r.batch_id) for r in maybe.collect()}
    assert true <= found and 3 <= len(folders) <= 5  # of 96
    assert len(keyed.groups_to_read(ids, sink, batch_id=1)[1]) < len(folders)
    # Ids that are not there: hardly any folder is read; a batch of ten times the ids reads at most in proportion.
    absent = spark.range(10**6, 10**6 + 200).select(F.col("id").alias("chunk_id"))
    few = keyed.groups_to_read(absent, sink)[0].count()
    assert few <= 200 * 6 * 0.01
    # More ids in a cell than planned cost reads, no rows.
    for n in (6, 7):
        keyed.append(spark.range(20_000, 60_000).select(F.col("id").alias("chunk_id")), lambda d: d, sink, n)
    assert keyed.read(spark, sink).count() == 18_000 + 40_000 == keyed.read(spark, sink).distinct().count()


def test_stream_into_the_table(spark, tmp_path):
    inbox, sink, log = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "log")
    inbox.mkdir()

    def once(name, ids):
        (inbox / name).write_text("".join(json.dumps({"chunk_id": i, "text_content": f"t {i}"}) + "\n" for i in ids))
        stream = ingest.read_stream(spark, str(inbox), rows(spark, [], "").schema, files_per_trigger=1)
        keyed.start(stream, lambda d: d, sink, log, buckets=4).awaitTermination()
        return [i for i, _ in table(spark, sink)]

    assert once("1.json", [1, 2, 1]) == [1, 2]
    assert once("2.json", [2, 3]) == [1, 2, 3]
    assert once("2.json", [2, 3]) == [1, 2, 3]
