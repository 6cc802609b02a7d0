"""TF-IDF index over term lists and cosine top-k search, as joins and aggregates.

An index is three tables: ``vocabulary(term, df, idf)``, ``postings(term, chunk_id, tf[, weight])`` and
``norms(chunk_id, norm)``. A fitted index keeps the norm per chunk apart from the raw counts, so its postings are not
shuffled to be normalised and a search divides only the scores of matched chunks. A saved index, which is searched many
times, has the normalised weight in its postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .ranking import broadcast_if, fits, top_k
from ..functions.text import as_col, clean_terms
from ..functions.dates import date_term
from ..session import stored

SCORE_DIGITS = 6
# Terms that hold more than 1/HOT_SHARE of all postings count as hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 500_000
# Rows whose terms are counted together.
COUNTED_ROWS = 1_024
# A search scores blocks of chunks for all questions, if there are at most so many; a block has at most so many pairs
# of posting and question, or of chunk and question.
BLOCK_QUESTIONS = 16_384
BLOCK_PAIRS = 1 << 21


@dataclass(frozen=True)
class SparseIndex:
    vocabulary: DataFrame
    postings: DataFrame
    norms: DataFrame
    # (chunk_id, counts) with the postings of each chunk in one row, where the index was fitted; also chunks without terms.
    rows: DataFrame | None = None


def document_terms(
    entities: Column | str, dates: Column | str, associated: Column | str, keep_empty_term: bool = False
) -> Column:
    """Term list of one context: entity names, days of the extracted dates, associated dates, cleaned.

    ``keep_empty_term`` gives a context without terms the one empty term that a tab split of '' yields.
    """
    empty = F.array().cast("array<string>")
    terms = clean_terms(F.concat(
        F.coalesce(F.transform(as_col(entities), lambda e: e["entity"]), empty),
        F.coalesce(F.transform(as_col(dates), date_term), empty),
        F.coalesce(as_col(associated), empty),
    ))
    return F.when(F.size(terms) == 0, F.array(F.lit(""))).otherwise(terms) if keep_empty_term else terms


def query_terms(entities: Column | str, dates: Column | str, keep_empty_term: bool = False) -> Column:
    """Term list of one question: entities, then dates, cleaned like the index side."""
    terms = clean_terms(F.concat(as_col(entities), as_col(dates)))
    return F.when(F.size(terms) == 0, F.array(F.lit(""))).otherwise(terms) if keep_empty_term else terms


def term_rows(df: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """(key, counts) with the distinct terms of each row and how often each is there; no shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED_ROWS):
                batch = whole.slice(at, COUNTED_ROWS)
                n, lists = batch.num_rows, batch.column(1)
                words = lists.flatten().dictionary_encode("encode")
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                width = max(len(words.dictionary), 1)
                pair = np.repeat(np.arange(n), sizes) * width + words.indices.to_numpy(zero_copy_only=False)
                pair, tf = np.unique(pair, return_counts=True)
                row, term = np.divmod(pair, width)
                found = pa.StructArray.from_arrays([words.dictionary.take(pa.array(term)), pa.array(tf, pa.int64())], ["term", "tf"])
                ends = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, found)], names=[key, "counts"])

    return df.select(key, terms).mapInArrow(count, f"{key} {kind}, counts array<struct<term:string,tf:bigint>>")


def term_counts(df: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """(key, term, tf). Each row counts its own terms, so there is no shuffle."""
    return term_rows(df, key, terms).select(key, F.inline("counts"))


def smoothed_idf(df: Column, n: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1"""
    return F.log((F.lit(1) + n) / (F.lit(1) + df)) + F.lit(1.0)


def build_vocabulary(postings: DataFrame, n_documents: Column) -> DataFrame:
    """(term, df, idf), from one aggregate with map-side combine."""
    return (
        postings.groupBy("term").agg(F.count("*").alias("df"))
        .withColumn("idf", smoothed_idf(F.col("df"), n_documents))
    )


def _hot_and_cold(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, idf) of the terms that can be sent around, fewer than ``HOT_SHARE`` by construction, and of the others."""
    total = vocabulary.agg(F.sum("df")).scalar()
    named = vocabulary.select("term", "idf")
    return named.filter(F.col("df") * HOT_SHARE > total), named.filter(F.col("df") * HOT_SHARE <= total)


def with_idf(postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Attach idf to every posting, whatever the skew of the terms.

    Hot terms, fewer than ``HOT_SHARE`` rows by construction, are joined by broadcast and stay where they are; the
    other terms hold at most ``1/HOT_SHARE`` of the postings each and are joined by shuffle.
    """
    hot, cold = _hot_and_cold(vocabulary)
    hot_part = postings.join(F.broadcast(hot), "term")
    return hot_part.unionByName(_cold(postings, hot, cold))


def _cold(postings: DataFrame, hot: DataFrame, cold: DataFrame) -> DataFrame:
    return postings.join(F.broadcast(hot.select("term")), "term", "left_anti").join(cold, "term")


def build_norms(postings: DataFrame, vocabulary: DataFrame, small_vocabulary: bool = False) -> DataFrame:
    """(chunk_id, norm): length of the tf·idf row of each chunk."""
    if small_vocabulary:
        weighted = postings.join(F.broadcast(vocabulary.select("term", "idf")), "term")
    else:
        weighted = with_idf(postings, vocabulary)
    squared = F.pow(F.col("tf") * F.col("idf"), F.lit(2.0))
    return weighted.groupBy("chunk_id").agg(F.sqrt(F.sum(squared)).alias("norm"))


def fit(documents: DataFrame, store: bool = True) -> SparseIndex:
    """Index of ``documents(chunk_id, terms)``. The document count includes documents without terms.

    With ``store`` the postings, the vocabulary and the norms are written once to the shared folder, as several branches read
    them; without it they stay lazy.
    """
    n_documents = documents.agg(F.count("*")).scalar()
    rows = term_rows(documents, "chunk_id")
    if store:
        rows = stored(rows, "postings")
    postings = rows.select("chunk_id", F.inline("counts"))
    vocabulary = build_vocabulary(postings, n_documents)
    small = False
    if store:
        vocabulary = stored(vocabulary, "vocabulary")
        small = fits(vocabulary, "term")
    norms = build_norms(postings, vocabulary, small)
    # Every search divides by the norms; stored once, no search goes over all postings for them.
    return SparseIndex(vocabulary, postings, stored(norms, "norms") if store else norms, rows)


def weights(index: SparseIndex) -> DataFrame:
    """(term, chunk_id, tf, weight): the L2-normalised matrix in long form.

    In a fitted index a chunk meets its norm with all its postings in one row; only postings of rare terms, which have been
    joined with their idf by shuffle, meet it one by one.
    """
    if "weight" in index.postings.columns:
        return index.postings
    if index.rows is None:
        joined = with_idf(index.postings, index.vocabulary).join(index.norms, "chunk_id")
    else:
        hot, cold = _hot_and_cold(index.vocabulary)
        near = index.rows.join(index.norms, "chunk_id").select("chunk_id", "norm", F.inline("counts")).join(F.broadcast(hot), "term")
        joined = near.unionByName(_cold(index.postings, hot, cold).join(index.norms, "chunk_id"))
    return joined.select("term", "chunk_id", "tf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def save_index(index: SparseIndex, path: str, mode: str = "errorifexists") -> None:
    """Write the index for many searches; postings are laid out by term so that a search reads few row groups.

    The range includes the chunk, so a term of any frequency is cut over many files. Saved postings carry their
    normalised ``weight``: searches then need neither the idf of the document side nor the norms.
    """
    index.vocabulary.write.mode(mode).parquet(f"{path}/vocabulary")
    index.norms.write.mode(mode).parquet(f"{path}/norms")
    (
        weights(index).repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")
        .write.mode(mode).parquet(f"{path}/postings")
    )


def load_index(spark: SparkSession, path: str) -> SparseIndex:
    read = spark.read.parquet
    return SparseIndex(read(f"{path}/vocabulary"), read(f"{path}/postings"), read(f"{path}/norms"))


def weigh_queries(questions: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(question_id, term, query_weight, idf) with unit length per question; unknown terms are ignored."""
    counts = questions.select("question_id", F.explode("terms").alias("term")).groupBy("question_id", "term").agg(
        F.count("*").alias("tf")
    )
    weighted = vocabulary.join(broadcast_if(counts, small), "term").withColumn("_w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy("question_id")))
    return weighted.select("question_id", "term", (F.col("_w") / length).alias("query_weight"), "idf")


def _asked_by_chunk(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the terms that are asked for, those of a chunk in one task.

    Questions multiply postings, most of all those of frequent terms, which a saved index keeps in few files. Here they
    are moved before that, once, so that the pairs of chunk and question are summed and ranked where they arise.
    The number of partitions is fixed, as their size here does not tell the number of pairs.
    """
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.join(F.broadcast(terms), "term").drop("term").repartition(n, "chunk_id")


class _Top:
    """The k best chunks of each question seen so far in one task, equal scores by chunk id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score, self.raw, self.chunk = np.full((n, k), -1.0), np.zeros((n, k)), np.zeros((n, k), np.int64)

    def offer(self, chunks: np.ndarray, raw: np.ndarray) -> None:
        """Take in the scores (question, chunk) of other chunks; 0 is no match."""
        # Scores count rounded, and what is left over is rounded by Spark.
        score = np.where(raw > 0, np.floor(raw * 10.0 ** SCORE_DIGITS + 0.5), -1.0)
        limit = self.score[:, -1]
        if len(chunks) > self.k:
            limit = np.maximum(limit, np.partition(score, -self.k, axis=1)[:, -self.k])
        at, col = np.nonzero((score >= limit[:, None]) & (score >= 0))
        if not len(at):
            return
        kept, place = np.unique(at, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(kept)), self.k), place])
        parts = [(self.score, score), (self.raw, raw)]
        values = [np.concatenate([old[kept].ravel(), new[at, col]]) for old, new in parts]
        chunk = np.concatenate([self.chunk[kept].ravel(), chunks[col]])
        order = np.lexsort((chunk, -values[0], row))
        best = order[np.searchsorted(row[order], np.arange(len(kept)))[:, None] + np.arange(self.k)]
        self.score[kept], self.raw[kept], self.chunk[kept] = values[0][best], values[1][best], chunk[best]


def _scored_in_blocks(postings: DataFrame, asked: pa.Table, ids: pa.Array, k: int, kind: str) -> DataFrame:
    """(question_id, chunk_id, raw): the k best chunks of each question in each partition.

    ``postings(chunk_id, term_no, part, norm)`` with those of a chunk next to each other; ``asked(term_no, question_no, factor)``
    by term, sent to every executor.
    """
    term, question, factor = (asked.column(c).to_numpy() for c in ("term_no", "question_no", "factor"))
    n_terms = int(term[-1]) + 1 if len(term) else 0
    first = np.searchsorted(term, np.arange(n_terms + 1))
    sent = postings.sparkSession.sparkContext.broadcast((first, question, factor, ids))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, question, factor, ids = sent.value
        n = len(ids)
        top = _Top(n, k)

        def block(chunk: np.ndarray, t: np.ndarray, part: np.ndarray, norm: np.ndarray) -> None:
            new = np.flatnonzero(np.diff(chunk)) + 1
            start = np.concatenate(([0], new))
            at = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(chunk))))
            # The terms of a chunk are added in the same order wherever it lies.
            order = np.lexsort((t, at))
            at, t, part = at[order], t[order], part[order]
            times = first[t + 1] - first[t]
            # Cut between chunks, where the pairs grow beyond a block.
            pairs = np.cumsum(np.bincount(at, weights=times, minlength=len(start)) + n)
            cuts = np.unique(np.concatenate(([0], np.searchsorted(pairs, np.arange(BLOCK_PAIRS, pairs[-1], BLOCK_PAIRS)), [len(start)])))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                a, b = np.searchsorted(at, (lo, hi))
                many = times[a:b]
                of = np.repeat(np.arange(a, b), many)
                spot = first[t[of]] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                cell = question[spot] * (hi - lo) + at[of] - lo
                dots = np.bincount(cell, weights=part[of] * factor[spot], minlength=n * (hi - lo)).reshape(n, hi - lo)
                top.offer(chunk[start[lo:hi]], dots / norm[start[lo:hi]])

        names = ("chunk_id", "term_no", "part", "norm")
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, names)]
            last = int(np.argmax(held[0] == held[0][-1]))  # the last chunk may go on in the next batch
            if last:
                block(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        if len(held[0]):
            block(*held)
        at, place = np.nonzero(top.score >= 0)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), pa.array(top.chunk[at, place]), pa.array(top.raw[at, place])], names=["question_id", "chunk_id", "raw"])

    return postings.sortWithinPartitions("chunk_id").mapInArrow(score, f"question_id {kind}, chunk_id bigint, raw double")


def _best_by_blocks(index: SparseIndex, query_side: DataFrame, k: int) -> DataFrame | None:
    """The ranking of ``search`` for questions whose terms are few enough to be sent around, None if they are too many."""
    weighted = "weight" in index.postings.columns
    ids = query_side.select("question_id").distinct()
    if not isinstance(index.postings.schema["chunk_id"].dataType, T.LongType) or ids.limit(BLOCK_QUESTIONS + 1).count() > BLOCK_QUESTIONS:
        return None
    factor = F.col("query_weight") * (F.lit(1.0) if weighted else F.col("idf"))
    asked = query_side.select("question_id", "term", factor.alias("factor")).toArrow().combine_chunks()
    terms, questions = (asked.column(c).combine_chunks().dictionary_encode() for c in ("term", "question_id"))
    numbered = pa.table({
        "term_no": terms.indices.cast(pa.int64()), "question_no": questions.indices.cast(pa.int64()), "factor": asked.column("factor")}).sort_by(
        [("term_no", "ascending"), ("question_no", "ascending")])
    spark = index.postings.sparkSession
    named = spark.createDataFrame(pa.table({
        "term": terms.dictionary.cast(pa.string()), "term_no": pa.array(np.arange(len(terms.dictionary)), pa.int64())}))
    part = F.col("weight") if weighted else F.col("tf").cast("double")
    postings = _asked_by_chunk(index.postings.select("term", "chunk_id", part.alias("part")), named)
    postings = postings.withColumn("norm", F.lit(1.0)) if weighted else postings.join(index.norms, "chunk_id")
    kind = query_side.schema["question_id"].dataType.simpleString()
    found = _scored_in_blocks(postings.select("chunk_id", "term_no", "part", "norm"), numbered, questions.dictionary, k, kind)
    scored = found.select("question_id", "chunk_id", F.round("raw", SCORE_DIGITS).alias("score"))
    return top_k(scored, ["question_id"], [F.desc("score"), F.asc("chunk_id")], k).select("question_id", "rank", "chunk_id", "score")


def search(
    index: SparseIndex, questions: DataFrame, k: int, fill_zeros: bool = False, small: bool | None = None
) -> DataFrame:
    """Top ``k`` chunks per question by cosine: (question_id, rank, chunk_id, score).

    ``questions(question_id, terms)``. Equal scores rank by chunk id. Chunks without a shared term are left out,
    unless ``fill_zeros`` pads each question up to ``k`` with score 0 in chunk id order.
    """
    if small is None:
        small = fits(questions.select(F.explode("terms").alias("term")), "term")
    query_side = weigh_queries(questions, index.vocabulary, small)
    order = [F.desc("score"), F.asc("chunk_id")]
    best = None
    if small:
        query_side = stored(query_side, "query-weights")
        best = _best_by_blocks(index, query_side, k)
    if best is None:
        weighted = "weight" in index.postings.columns
        postings = index.postings
        if small:
            postings = _asked_by_chunk(postings.withColumn("_term", F.col("term")), query_side.select("term").distinct()).withColumnRenamed("_term", "term")
        if not weighted:
            postings = postings.join(index.norms, "chunk_id")
        part = F.col("weight") if weighted else F.col("tf") * F.col("idf")
        dots = postings.join(broadcast_if(query_side, small), "term").groupBy("chunk_id", "question_id").agg(
            F.sum(part * F.col("query_weight")).alias("_dot"), *([] if weighted else [F.max("norm").alias("_norm")]))
        raw = F.col("_dot") if weighted else F.col("_dot") / F.col("_norm")
        scored = dots.select("question_id", "chunk_id", F.round(raw, SCORE_DIGITS).alias("score"))
        best = top_k(scored, ["question_id"], order, k).select("question_id", "rank", "chunk_id", "score")
    if not fill_zeros:
        return best
    # A question short of k has fewer than k matches, so the 2k lowest ids are enough to fill it.
    lowest = index.norms.select("chunk_id").orderBy("chunk_id").limit(2 * k)
    ids = lowest.agg(F.sort_array(F.collect_list("chunk_id"))).scalar()
    zeros = (
        questions.select("question_id", F.explode(ids).alias("chunk_id"))
        .join(best.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
        .withColumn("score", F.lit(0.0))
    )
    both = best.drop("rank").unionByName(zeros)
    return top_k(both, ["question_id"], order, k).select("question_id", "rank", "chunk_id", "score")
