"""The registered queries of the training-text operators, at production parameters over whole tables."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from . import align, ann, bpe, langid, lexical, licenses, lm, mixing, neardup, ngram_join, pii, quality, urls
from .shared import table

r = Registry()
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@r.query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.digests(
        table(spark, sf_dir, "documents"), "doc_id", "text", Path(RANKS).read_bytes(), public_tokenizers.PATTERN
    )
    return found.withColumnRenamed("key", "doc_id")


@r.query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id"))
    models = langid.learn(docs.filter(~F.col("held_out")), "doc_id", "text", "lang")
    return langid.identify(docs, "text", models, keep=["doc_id", "held_out"])


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@r.query("""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT *, ('.' || host LIKE '%.com' AND path LIKE '/%') AS a, ('.' || host LIKE '%.example.com' AND path LIKE '/en/%') AS b,
    ('.' || host LIKE '%.www.example.com' AND path LIKE '/en/%') AS c, ('.' || host LIKE '%.net' AND path LIKE '/es/%') AS d,
    ('.' || host LIKE '%.net' AND path LIKE '/fr/%') AS e
  FROM parts)
SELECT page_id, host, path,
  CASE WHEN c THEN 'www.example.com/en/' WHEN b THEN 'example.com/en/' WHEN a THEN 'com/' WHEN d THEN 'net/es/' WHEN e THEN 'net/fr/' END AS rule,
  CASE WHEN c THEN 'allow' WHEN b THEN 'block' WHEN a THEN 'allow' WHEN d OR e THEN 'block' ELSE 'allow' END AS verdict
FROM fits
""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), "page_id", "url", rules)


@r.query("""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM sizes),
levels AS (
  SELECT *, sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "left"
  FROM weighed),
level AS (SELECT ("left" / open)::DOUBLE AS v FROM levels WHERE cap * open > "left" * w ORDER BY cap / w LIMIT 1),
target AS (SELECT source, source_size, least((SELECT v FROM level) * w, cap)::DOUBLE AS target FROM levels),
run AS (
  SELECT s.source, s.hash, sum(sum(size)) OVER (PARTITION BY s.source ORDER BY s.hash) AS upto, sum(size) AS n
  FROM sized s GROUP BY s.source, s.hash),
rest AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM target)
SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
  (d.size * (t.whole + CASE WHEN r.upto - r.n + r.n / 2.0 < t.target - t.whole * t.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN rest t ON d.source IS NOT DISTINCT FROM t.source
JOIN run r ON d.source IS NOT DISTINCT FROM r.source AND d.hash = r.hash
""")
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", weights=[1, 2, 3])


@r.query()
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    starts, labels = F.col("places.start"), F.array_sort(F.array_distinct("places.label"))
    return found.select(
        F.col("key").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", "spans",
    )


# Stands in for the secret that a deployment keeps to itself.
SURROGATE_SECRET = "registered query"


@r.query()
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogates(docs, "doc_id", "text", SURROGATE_SECRET).select(
        "doc_id", "text", F.size("replaced").cast("bigint").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct("replaced.kind")), ",").alias("kinds"),
    )


@r.query()
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, percent=90)


@r.query()
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", cosine=0.9)


@r.query()
def op5_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, k=20)


@r.query()
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    learns = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(False))
    found = lm.score(table(spark, sf_dir, "documents"), "doc_id", "text", learns)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _sql(text: str) -> str:
    """An SQL literal."""
    return "'" + text.replace("'", "''") + "'"


@r.query(rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n >= 2),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS s FROM d),
seen AS (
  SELECT *, translate(lower_a, {_sql(quality.BLANKS)}, '') AS dense, right(rtrim(s, {_sql(quality.BLANKS + quality.CLOSING)}), 1) AS last,
    len(s) - len(translate(s, {_sql(quality.MARKS)}, '')) AS marks, len(s) - len(translate(s, {_sql(quality.SEPARATORS)}, '')) AS seps
  FROM (SELECT *, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_a FROM lines) WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT rid, s, len(dense) AS chars, CASE
    WHEN seps >= 2 THEN 'navigation'
    WHEN regexp_matches(lower_a, {_sql(quality.BOILERPLATE)}) THEN 'boilerplate'
    WHEN marks >= 3 AND marks * 10 > len(dense) THEN 'punctuation'
    WHEN NOT (last <> '' AND contains({_sql(quality.TERMINAL)}, last)) AND len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) < {quality.CUT_WORDS} THEN 'punctuation' END AS fault
  FROM seen),
by_doc AS (
  SELECT rid, sum(chars)::BIGINT AS word_chars, count(*) AS n_lines, count(*) - count(DISTINCT s) AS n_dup_lines,
    coalesce(sum(chars) FILTER (fault IS NULL), 0)::BIGINT AS left_chars, count(fault) AS n_removed
  FROM judged GROUP BY rid),
counted AS (
  SELECT doc_id, len(w.w)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars,
    (len(t) - len(translate(t, {_sql(quality.SYMBOLS)}, '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(left_chars, 0) AS left_chars
  FROM d JOIN w USING (rid) LEFT JOIN repeated r USING (rid) LEFT JOIN by_doc USING (rid))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words)
    AND 100 * (word_chars - left_chars) <= {quality.MAX_LOSS} * word_chars AS kept
FROM counted
""")
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.clean(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    removed = (F.col("quality.n_punctuation") + F.col("quality.n_navigation") + F.col("quality.n_boilerplate")).alias("n_removed")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "left_chars", "base_failed", "kept")
    return found.select("doc_id", *(F.col(f"quality.{f}").alias(f) for f in fields), removed)


@r.query(r"""
WITH tf AS (
  SELECT rid0, doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf
  FROM (SELECT doc_id, rid0, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
        FROM (SELECT *, row_number() OVER () AS rid0 FROM documents)) GROUP BY ALL),
size AS (SELECT rid0, sum(tf)::BIGINT AS n FROM tf GROUP BY rid0),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM size),
asked AS (
  SELECT DISTINCT item_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) WHERE item_id IS NOT NULL),
weight AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, big_n),
scored AS (
  SELECT item_id, rid0, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (rid0), whole
  WHERE doc_id IS NOT NULL GROUP BY item_id, rid0, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text", k=10)


def _byte_bpe() -> align.Tokens:
    return align.byte_level(public_tokenizers.path("byte_bpe_50k.json"))


def _piece_bpe() -> align.Tokens:
    return align.sentence_pieces(public_tokenizers.path("piece_bpe_32k.model"))


@r.query()
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(table(spark, sf_dir, "documents"), "doc_id", "text", _byte_bpe, _piece_bpe, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
