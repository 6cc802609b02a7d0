"""Following files that grow, and the inverted lists of codes."""

import numpy as np
import pytest

from lodestone.config import IndexConfig
from lodestone.operators import dense, graph
from lodestone.streaming import growing


def run(spark, folder, out):
    rows = spark.readStream.format("growing_lines").option("suffix", ".jsonl").load(folder)
    query = rows.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/log").trigger(
        availableNow=True).start()
    query.awaitTermination()
    return sorted((r.file.split("/")[-1], r.position, r.line) for r in spark.read.parquet(f"{out}/table").collect())


def test_each_line_of_a_growing_file_is_read_once(spark, tmp_path):
    spark.dataSource.register(growing.GrowingLines)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.jsonl").write_text("one\ntwo é\nthr")
    (folder / "skipped.txt").write_text("no\n")
    assert run(spark, str(folder), out) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two é")]
    with open(folder / "a.jsonl", "a") as file:
        file.write("ee\nfour\n")
    (folder / "b.jsonl").write_text("\nlast\r\n")
    after = run(spark, str(folder), out)
    assert [x[2] for x in after] == ["one", "two é", "three", "four", "", "last"]
    # A stream that starts again with nothing new repeats nothing.
    assert run(spark, str(folder), out) == after


def test_pieces_share_the_lines_between_them(tmp_path):
    lines = [f"{i} " + "x" * (i * 7 % 50) for i in range(200)]
    path = tmp_path / "a"
    path.write_text("\n".join(lines) + "\n")
    reader = growing.GrowingReader(str(tmp_path), "")
    (file, end), = reader.latestOffset().items()
    for size, read in ((13, 5), (64, 1 << 20), (1_000, 17)):
        growing.PIECE, growing.READ = size, read
        try:
            got = [(p, x) for piece in reader.partitions({}, {file: end}) for batch in reader.read(piece)
                   for p, x in zip(batch.column("position").to_pylist(), batch.column("line").to_pylist())]
        finally:
            growing.PIECE, growing.READ = 32 << 20, 1 << 20
        assert [x for _, x in got] == lines and [p for p, _ in got] == sorted({p for p, _ in got})


def test_coded_cells_are_near_exact_search(spark):
    x = np.random.default_rng(2).normal(size=(400, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id bigint, embedding array<double>")
    queries = vectors.withColumnRenamed("chunk_id", "query_id")
    true = dense.search_exact(queries, vectors, 5, exclude_self=True).cache()
    found = dense.search(queries, vectors, 5, IndexConfig("hnsw_pq", n_cells=8, pq_m=8, pq_bits=5), exclude_self=True).cache()
    assert graph.recall_of(found, true) >= 0.9
    exact = {(r.query_id, r.chunk_id): r.distance for r in true.collect()}
    assert all(abs(exact.get((r.query_id, r.chunk_id), r.distance) - r.distance) < 2e-6 for r in found.collect())
    index = dense.fit_coded_cells(vectors, IndexConfig("hnsw_pq", n_cells=8, pq_m=8, pq_bits=5))
    spelled = {r.chunk_id: index.centroids[r.cell] + np.concatenate([b[c] for b, c in zip(index.codebooks, r.codes)]) for r in index.codes.collect()}
    rough = dense.search_coded_cells(queries.filter("query_id < 5"), vectors, index, 5, 8, 0).collect()
    assert all(abs(((x[r.query_id] - spelled[r.chunk_id]) ** 2).sum() - r.distance) < 1e-5 for r in rough) and len(rough) == 25
    assert dense.search_coded_cells(queries.limit(0), vectors, index, 5, 2).count() == 0
    with pytest.raises(ValueError):
        dense.fit_coded_cells(vectors, IndexConfig("hnsw_pq", pq_bits=9, n_cells=4))
