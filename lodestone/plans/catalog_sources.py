"""Registered queries of sources and sinks: given tables written in each file form and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .catalog_text import ws
from .registry import Registry
from ..functions import text
from ..operators import crawl, dense, infer, sparse, trainset
from ..operators.html import Part, Scope
from ..operators.ranking import global_number
from ..session import work_path
from ..sources import lines, records, sitemap, vectors_text
from ..sources import tables as chunk_tables

r = Registry()

# SQL forms of the normalised text, and of a text as one line.
LINE = ws("text")


def contexts(spark, sf_dir) -> DataFrame:
    """Documents as context records: quoted ids, every other text a list of its lines, entities and dates."""
    text_list = F.to_json(F.split("text", "\n"))
    return tables.documents(spark, sf_dir).join(
        tables.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id"
    ).select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("s"), F.col("doc_id")).alias("source_id"),
        F.col("source").alias("source_name"),
        F.when(F.col("doc_id") % 2 == 0, text_list).otherwise(F.col("text")).alias("text_content"),
        F.array(F.concat(F.lit("2024-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-15"))).alias("associated_dates"),
        F.when(F.col("doc_id") % 5 > 0, F.array(
            F.struct(F.col("source").alias("entity")), F.struct(F.concat(F.lit(" "), F.upper("lang"), F.lit("\tX ")).alias("entity")),
        )).otherwise(F.array().cast("array<struct<entity:string>>")).alias("extracted_entities"),
        F.array(F.concat(F.lit("2023-1"), (F.col("doc_id") % 3).cast("string"), F.lit("-02T10:00:00-05:00"))).alias("extracted_dates"),
    )


def context_file(spark, sf_dir) -> str:
    path = work_path(spark, "contexts")
    rows = contexts(spark, sf_dir)
    # Lists stand as JSON lists in the file, as text does as text.
    listed = rows.filter(F.col("text_content").startswith("[")).withColumn("text_content", F.from_json("text_content", "array<string>"))
    records.write_json(rows.filter(~F.col("text_content").startswith("[")), path)
    records.write_json(listed, path, "append")
    return path


CONTEXT_TEXT = "CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), ' ') ELSE text END"


@r.query(f"""
    SELECT doc_id AS chunk_id, 's' || doc_id AS source_id, source AS source_name, md5({CONTEXT_TEXT}) AS text_md5,
           length({CONTEXT_TEXT}) AS n_chars, '2024-0' || (doc_id % 9 + 1) || '-15' AS day, CASE WHEN doc_id % 5 > 0 THEN 2 ELSE 0 END AS n_entities
    FROM documents""")
def contexts_json_roundtrip(spark, sf_dir):
    back = records.read_contexts(spark, context_file(spark, sf_dir))
    return back.select(
        "chunk_id", "source_id", "source_name", F.md5("text_content").alias("text_md5"),
        F.length("text_content").cast("bigint").alias("n_chars"), F.col("associated_dates")[0].alias("day"),
        F.size("extracted_entities").alias("n_entities"),
    )


@r.query("SELECT item_id AS question_id, item_id * 3 AS chunk_id, text AS question, 'A: ' || text AS gt_answer FROM benchmark")
def questions_json_roundtrip(spark, sf_dir):
    path = work_path(spark, "questions")
    records.write_json(tables.questions(spark, sf_dir).select(
        F.col("question_id").cast("string").alias("question_id"), (F.col("question_id") * 3).alias("chunk_id"), "question",
        F.concat(F.lit("A: "), "question").alias("gt_answer")), path)
    return records.read_questions(spark, path)


@r.query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, {LINE} AS question FROM documents")
def question_lines_roundtrip(spark, sf_dir):
    """Texts as lines of several files, numbered over all files when read."""
    path = work_path(spark, "lines")
    one_line = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("line_no"), text.normalize_ws("text").alias("answer"))
    lines.write_answers(one_line, path)
    return lines.read_questions(spark, path)


@r.query("""
    SELECT item_id AS question_id, item_id AS gt_chunk_id, text AS question, text AS gt_answer, [item_id, item_id + 1] AS retrieved_chunk_ids,
           '' AS raw_output, lower(text) AS retrieved_context, 'A: ' || text AS generated_answer FROM benchmark""")
def answers_json_sink(spark, sf_dir):
    path = work_path(spark, "answers")
    rows = tables.questions(spark, sf_dir).select(
        F.lit("not a column of answers").alias("extra"), "question_id", F.col("question_id").alias("gt_chunk_id"), "question",
        F.col("question").alias("gt_answer"), F.array("question_id", F.col("question_id") + 1).alias("retrieved_chunk_ids"),
        F.lit("").alias("raw_output"), F.lower("question").alias("retrieved_context"), F.concat(F.lit("A: "), "question").alias("generated_answer"),
    )
    records.write_answers(rows, path)
    return spark.read.schema(records.schemas.ANSWER).json(path)


@r.query(f"""
    SELECT string_agg({LINE} || chr(10), '' ORDER BY item_id) AS content FROM benchmark""")
def answers_text_sink(spark, sf_dir):
    """One file with one answer per line, in the order of the questions."""
    path = work_path(spark, "answer-lines")
    rows = tables.questions(spark, sf_dir).select(F.col("question_id").alias("line_no"), text.normalize_ws("question").alias("answer"))
    lines.write_answers(rows, path, single_file=True)
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))


@r.query("""
    SELECT row_number() OVER (ORDER BY half, vec_id) - 1 AS row_no, vec_id, label FROM (SELECT *, vec_id % 2 AS half FROM embeddings)""")
def embedding_tsv_append_align(spark, sf_dir):
    """Two appended batches of several files, and the rows they belong to joined by line."""
    path, vectors = work_path(spark, "vectors-append"), tables.vectors(spark, sf_dir).withColumn("half", F.col("chunk_id") % 2)
    for half in (0, 1):
        vectors_text.write(vectors.filter(F.col("half") == half).repartitionByRange(3, "chunk_id").sortWithinPartitions("chunk_id"), path)
    numbered = numbered_rows(vectors.select("half", "chunk_id", "label", "embedding"))
    back = vectors_text.align(numbered, vectors_text.read(spark, path).withColumnRenamed("embedding", "read"))
    gap = F.aggregate(F.zip_with("embedding", "read", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: F.greatest(s, d.cast("double")))
    return back.filter(gap < 1e-6).select("row_no", F.col("chunk_id").alias("vec_id"), "label")


def numbered_rows(rows: DataFrame) -> DataFrame:
    return global_number(rows, ["half", "chunk_id"], "row_no")


@r.query("""
    SELECT doc_id AS chunk_id, length(text) AS n_chars, source AS source_name, [] ::VARCHAR[] AS dates, doc_id AS inner_id, v.label
    FROM documents JOIN embeddings v ON v.vec_id = doc_id""")
def chunk_table_roundtrip(spark, sf_dir):
    """Chunks, vectors and the metadata struct as one saved table."""
    vectors = tables.vectors(spark, sf_dir)
    rows = dense.chunk_table(tables.chunks(spark, sf_dir).withColumn("associated_dates", F.array().cast("array<string>")), vectors)
    path = work_path(spark, "chunk-table")
    chunk_tables.save_chunk_table(rows, path)
    return chunk_tables.load_chunk_table(spark, path).join(vectors.select("chunk_id", "label"), "chunk_id").select(
        "chunk_id", F.length("text_content").cast("bigint").alias("n_chars"), F.col("metadata.source_name").alias("source_name"),
        F.col("metadata.associated_dates").alias("dates"), F.col("metadata.chunk_id").alias("inner_id"), "label",
    )


@r.query("SELECT doc_id AS chunk_id, length(text) AS n_chars FROM documents")
def keyed_append(spark, sf_dir):
    """Two overlapping batches appended to a table that is not there at first; each id once."""
    path, rows = work_path(spark, "appended"), tables.chunks(spark, sf_dir)
    dense.append_new(rows.filter("chunk_id % 3 < 2"), path)
    dense.append_new(rows.filter("chunk_id % 3 > 0"), path)
    return spark.read.parquet(path).select("chunk_id", F.length("text_content").cast("bigint").alias("n_chars"))


@r.query("""
    SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 > 0 THEN
        [lower(source), lower(lang) || ' x', '2023-1' || (doc_id % 3) || '-02', '2024-0' || (doc_id % 9 + 1) || '-15']
        ELSE ['2023-1' || (doc_id % 3) || '-02', '2024-0' || (doc_id % 9 + 1) || '-15'] END AS terms
    FROM documents
    UNION ALL SELECT -1 - doc_id, [''] FROM documents WHERE doc_id % 7 = 0""")
def context_terms(spark, sf_dir):
    """Index terms out of entities, extracted days and associated dates; records without any get the empty term."""
    rows = contexts(spark, sf_dir)
    bare = rows.filter(F.col("chunk_id").cast("bigint") % 7 == 0).withColumns({
        "chunk_id": (-1 - F.col("chunk_id").cast("bigint")).cast("string"),
        "extracted_entities": F.array().cast("array<struct<entity:string>>"), "extracted_dates": F.lit(None).cast("array<string>"),
        "associated_dates": F.lit(None).cast("array<string>"),
    })
    return rows.union(bare).select(
        F.col("chunk_id").cast("bigint").alias("chunk_id"),
        sparse.document_terms("extracted_entities", "extracted_dates", "associated_dates", keep_empty_term=True).alias("terms"),
    )


@r.query(f"SELECT doc_id, {LINE} AS text_content FROM documents")
def whitespace_list(spark, sf_dir):
    """Lines of a text as a list, normalised and joined."""
    return tables.documents(spark, sf_dir).select("doc_id", text.normalize_list(F.split("text", "\n")).alias("text_content"))


def question_writer():
    """Stand-in generator: the header, then a question and an answer made of the text that follows the prompt."""
    return lambda prompts: ["### Questions and Answers\nQ: how long is it\nA: " + str(len(p)) + "\nQ: no answer" for p in prompts]


@r.query("""
    SELECT row_number() OVER (ORDER BY doc_id) AS question_id, doc_id AS chunk_id, source AS source_name, 'how long is it' AS question
    FROM documents""")
def qa_generation_sinks(spark, sf_dir):
    """One generation pass with two outputs: the pairs are read back and checked against the enriched records."""
    root = work_path(spark, "qa")
    rows = tables.chunks(spark, sf_dir).withColumn("line_no", F.col("chunk_id"))
    entries = trainset.generate_entries(rows, question_writer)
    records.write_entries_and_pairs(entries, f"{root}/pairs", f"{root}/entries", ["chunk_id", "source_name"])
    pairs = spark.read.schema("chunk_id bigint, source_name string, question_id bigint, question string, gt_answer string").json(f"{root}/pairs")
    kept = spark.read.schema("chunk_id bigint, questions array<string>, answers array<string>").json(f"{root}/entries")
    same = pairs.join(kept, "chunk_id").filter((F.col("question") == F.col("questions")[0]) & (F.col("gt_answer") == F.col("answers")[0]))
    return same.select("question_id", "chunk_id", "source_name", "question")


@r.query("SELECT item_id AS n, text AS question, 'A: ' || text AS answer, text || ' .' AS text_content FROM benchmark")
def training_json_roundtrip(spark, sf_dir):
    path = work_path(spark, "training")
    rows = tables.questions(spark, sf_dir).select("question", F.concat(F.lit("A: "), "question").alias("answer"), F.concat("question", F.lit(" .")).alias("text_content"))
    records.write_json(rows, path)
    ids = tables.questions(spark, sf_dir).select(F.col("question_id").alias("n"), "question")
    return records.read_training(spark, path).join(ids, "question").select("n", "question", "answer", "text_content")


@r.query("""
    SELECT url AS loc, '2024-01-0' || (page_id % 9 + 1) AS lastmod, 'page' AS kind FROM pages
    UNION ALL SELECT 'https://example.com/map' || (page_id % 7) || '.xml', NULL, 'map' FROM (SELECT DISTINCT page_id % 7 AS page_id FROM pages)""")
def sitemap_urls(spark, sf_dir):
    """Page addresses as plain and gzipped sitemap files, and an index of them."""
    root, pages = work_path(spark, "sitemaps"), tables.pages(spark, sf_dir)
    safe = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<url><loc> "), safe, F.lit(" </loc><lastmod>2024-01-0"), F.col("page_id") % 9 + 1, F.lit("</lastmod></url>"))
    # A file holds the entries of a run of page ids, fewer than the 50,000 that the protocol allows.
    page_set = F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</urlset>"))
    for name, part in (("none", "page_id % 2 = 0"), ("gzip", "page_id % 2 = 1")):
        body = pages.filter(part).groupBy(F.floor(F.col("page_id") / 5_000).alias("file")).agg(page_set.alias("value"))
        body.write.partitionBy("file").option("compression", name).text(f"{root}/{name}")
    maps = pages.select((F.col("page_id") % 7).alias("n")).distinct().select(
        F.concat(F.lit("<sitemap><loc>https://example.com/map"), F.col("n"), F.lit(".xml</loc></sitemap>")).alias("loc"))
    listed = maps.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.sort_array(F.collect_list("loc")), ""), F.lit("</sitemapindex>")).alias("value"))
    listed.write.text(f"{root}/index")
    found = sitemap.read_urls(spark, f"{root}/none").unionByName(sitemap.read_urls(spark, f"{root}/gzip"))
    found = found.select("loc", "lastmod", F.lit("page").alias("kind"))
    return found.union(sitemap.read_index(spark, f"{root}/index").select("loc", "lastmod", F.lit("map").alias("kind")))


@r.query("SELECT sum(1 + length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_lines, sum(strlen(text) + 1)::BIGINT AS n_bytes FROM benchmark")
def binary_catalog(spark, sf_dir):
    """Fetched files as binary rows: their bytes are those of what was written."""
    path = work_path(spark, "binaries")
    tables.questions(spark, sf_dir).select("question").write.text(path)
    files = sitemap.read_binaries(spark, path, "*.txt").filter(F.col("name").startswith("part-"))
    breaks = F.length("content") - F.length(F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("\n"), F.lit("")), "UTF-8"))
    return files.agg(F.sum(breaks).cast("bigint").alias("n_lines"), F.sum("length").cast("bigint").alias("n_bytes"))


# A page as the records see it: its own text in the article, a line with an author and one with a date above it.
DAY = "'2024-' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || '-11'"
AUTHOR = "CASE WHEN page_id % 3 = 0 THEN 'Ann Lee' WHEN page_id % 3 = 1 THEN 'Bo Day' ELSE '' END"
RECORD = crawl.PageRule(
    "page", Scope((Part("h1"),)), (Scope((Part("div", ("lead",)),)), Scope((Part("div", ("body",)),))),
    author=(Scope((Part("span", ("by",)),), first=True), Scope((Part("b", ("by-old",)),), first=True)),
    date=(Scope((Part("time"),), first=True),), find_dates=True, words=("example",),
)


def dated_pages(spark, sf_dir) -> DataFrame:
    n = F.col("page_id")
    month = F.element_at(F.array(*map(F.lit, "January February March April May June July August September October November December".split())), (n % 12 + 1).cast("int"))
    author = F.when(n % 3 == 0, F.lit("<span class='by'> Ann  Lee </span>")).when(n % 3 == 1, F.lit("<b class='by-old'>Bo Day</b>")).otherwise("")
    body = F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Page "), n, F.lit(" was seen on 2023-05-06")))
    return tables.pages(spark, sf_dir).select("url", F.concat(
        F.lit("<html><h1> No. "), n, F.lit("</h1><time>"), month, F.lit(" 11, 2024</time>"), author,
        F.lit("<div class='lead'></div><div class='body main'>"), body, F.lit("</div></html>"),
    ).alias("html"))


@r.query(f"""
    SELECT url, 'No. ' || page_id AS title, '2024-03-01T12:00:00-05:00' AS date_accessed,
           concat_ws(' ', d, nullif({AUTHOR}, ''), 'Page ' || page_id || ' was seen on 2023-05-06') AS text_content,
           [d, '2023-05-06T00:00:00-04:00'] AS associated_dates
    FROM (SELECT *, {DAY} || 'T00:00:00' || CASE WHEN page_id % 12 IN (0, 1, 11) THEN '-05:00' WHEN page_id % 12 IN (3, 4, 5, 6, 7, 8, 9) THEN '-04:00'
          WHEN page_id % 12 = 2 THEN '-04:00' ELSE '-05:00' END AS d FROM pages)
    WHERE page_id % 5 > 0 AND contains(lower(url), 'example')""")
def page_records(spark, sf_dir):
    """Page records of a route: keyword test, title, author and date chains, stamp and dates, written and read back."""
    found = crawl.records(dated_pages(spark, sf_dir), RECORD, "2024-03-01 12:00:00")
    path = work_path(spark, "page-records")
    records.write_json(found.drop("date_missing"), path)
    return spark.read.schema(records.schemas.PAGE).json(path)


@r.query("SELECT doc_id AS chunk_id, length(text) AS said FROM documents")
def batch_inference_sizes(spark, sf_dir):
    """A model over fixed batches: every row is asked once, in batches of at most eight."""
    return infer.run(tables.chunks(spark, sf_dir).select("chunk_id", "text_content"), text_lengths, "text_content", "said", "bigint", 8).select("chunk_id", "said")


def text_lengths():
    def model(batch: list[str]) -> list[int]:
        if len(batch) > 8:
            raise ValueError("batch too large")
        return [len(t) for t in batch]

    return model
