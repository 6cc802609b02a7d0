"""Retrieval and answer scores as aggregates over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .infer import loaded
from .ranking import global_number
from ..functions.text import let, normalize_ws, run_counts, strip, tokens

# ASCII punctuation and the articles that answer matching ignores.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"(?U)\b(?:a|an|the)\b"


# ---- retrieval -------------------------------------------------------------------------------------------------


def first_hits(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``gold(question_id, chunk_id)`` with ``hit_rank``, the first rank at which the gold chunk was retrieved."""
    hits = retrieved.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("hit_rank"))
    return gold.join(hits, ["question_id", "chunk_id"], "left")


def _scores(hit_rank: Column, within: Column | int | None = None) -> tuple[Column, Column]:
    rank = hit_rank if within is None else F.when(hit_rank <= within, hit_rank)
    recall = F.avg(rank.isNotNull().cast("double"))
    mrr = F.avg(F.coalesce(F.lit(1.0) / rank, F.lit(0.0)))
    return recall.alias("recall"), mrr.alias("mrr")


def retrieval_metrics(gold: DataFrame, retrieved: DataFrame, k: int | None = None) -> DataFrame:
    """One row (n_questions, recall, mrr). There is one gold chunk per question, so recall is a hit rate."""
    hits = first_hits(gold, retrieved)
    return hits.agg(F.count("*").alias("n_questions"), *_scores(F.col("hit_rank"), k))


def retrieval_sweep(gold: DataFrame, retrieved: DataFrame, ks: list[int]) -> DataFrame:
    """(k, n_questions, recall, mrr) for several cut-offs out of one ranking made at the largest k."""
    hits = first_hits(gold, retrieved).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return hits.groupBy("k").agg(
        F.count("*").alias("n_questions"), *_scores(F.col("hit_rank"), F.col("k"))
    )


def retrieval_grid(
    gold: DataFrame, candidates: DataFrame, sparse_ks: list[int], dense_ks: list[int], rerank_ks: list[int]
) -> DataFrame:
    """(sparse_k, dense_k, rerank_k, n_questions, recall, mrr) of every combination, out of one table of scored candidates.

    ``candidates(question_id, chunk_id, sparse_rank, dense_rank, score)`` are made at the largest cut-offs
    (``retrieve.scored_candidates``). Each combination counts as fusion without doubles, then reranking, would: equal
    scores stay in the order sparse, dense. Nothing is ranked again: a gold chunk's place is one more than the candidates of its
    combination that come before it, and one aggregate by question counts them for all combinations.
    """
    cells = [(s, d) for s in sparse_ks for d in dense_ks]

    def place(of: Column, s: int, d: int) -> Column:
        """Channel and rank at which a combination finds a candidate, as one number pair; NULL if it does not."""
        spot = lambda channel, rank: F.struct(F.lit(channel).alias("channel"), of[rank].alias("rank"))
        return F.when(of["sparse_rank"] <= s, spot(0, "sparse_rank")).when(of["dense_rank"] <= d, spot(1, "dense_rank"))

    named = gold.select("question_id", F.col("chunk_id").alias("_gold"))
    one = F.struct("chunk_id", "sparse_rank", "dense_rank", "score")
    rows = named.join(candidates.select("question_id", one.alias("_c")), "question_id", "left")
    own = F.max(F.when(F.col("_c.chunk_id") == F.col("_gold"), F.col("_c"))).over(W.partitionBy("question_id"))
    rows = rows.withColumn("_own", own)
    c, g = F.col("_c"), F.col("_own")

    def rank_in(s: int, d: int) -> Column:
        first = (c["score"] > g["score"]) | ((c["score"] == g["score"]) & (place(c, s, d) < place(g, s, d)))
        ahead = F.count_if(place(c, s, d).isNotNull() & first)
        found = F.max(F.when(place(g, s, d).isNotNull(), F.lit(1)))
        return F.struct(F.lit(s).alias("sparse_k"), F.lit(d).alias("dense_k"), F.when(found == 1, ahead + 1).alias("hit_rank"))

    ranks = rows.groupBy("question_id").agg(F.array(*[rank_in(s, d) for s, d in cells]).alias("_cells"))
    spread = ranks.select(F.inline("_cells")).withColumn("rerank_k", F.explode(F.array(*[F.lit(k) for k in rerank_ks])))
    return spread.groupBy("sparse_k", "dense_k", "rerank_k").agg(
        F.count("*").alias("n_questions"), *_scores(F.col("hit_rank"), F.col("rerank_k"))
    )


def batch_metrics(per_question: DataFrame, row_no: str, batch: int, measures: list[str]) -> DataFrame:
    """Mean of each measure per batch of ``batch`` consecutive rows, plus the exact row over all (batch_id NULL).

    Rows are numbered from 0 in the order of ``row_no``, whatever gaps it has; one pass gives both kinds of rows.
    """
    numbered = global_number(per_question, [row_no], "_no").withColumn("batch_id", F.floor(F.col("_no") / batch).cast("bigint"))
    means = [F.avg(m).alias(m) for m in measures]
    return numbered.rollup("batch_id").agg(F.count("*").alias("n_questions"), *means)


def per_question_retrieval(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``gold`` with ``recall`` and ``mrr`` of each question on its own."""
    hits = first_hits(gold, retrieved)
    return hits.withColumn("recall", F.col("hit_rank").isNotNull().cast("double")).withColumn(
        "mrr", F.coalesce(F.lit(1.0) / F.col("hit_rank"), F.lit(0.0))
    ).drop("hit_rank")


# ---- answers ---------------------------------------------------------------------------------------------------


def squad_text(c: Column | str) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    lowered = F.lower(F.col(c) if isinstance(c, str) else c)
    return normalize_ws(F.regexp_replace(F.regexp_replace(lowered, PUNCTUATION, ""), ARTICLES, " "))


def rouge_tokens(c: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.col(c) if isinstance(c, str) else c), F.lit("[a-z0-9]+"), F.lit(0))


def bleu_tokens(c: Column | str) -> Column:
    """The "13a" tokens of machine translation scoring."""
    text = F.col(c) if isinstance(c, str) else c
    for pattern, replacement in BLEU_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return tokens(text)


# The published 13a rules, in order.
BLEU_RULES = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    (r"([\{-~\[-` -&\(-\+:-@/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def bag_overlap(prediction: Column, reference: Column) -> Column:
    """struct(n_common, n_prediction, n_reference) of two token lists; common counts each token by its minimum.

    Counted inside the row, without a shuffle.
    """
    n = lambda c: F.coalesce(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0)).cast("bigint")
    known = F.map_from_entries(run_counts(F.coalesce(reference, F.array().cast("array<string>")), "token", "n"))
    mine = run_counts(F.coalesce(prediction, F.array().cast("array<string>")), "token", "n")
    common = let(known, lambda m: F.aggregate(
        mine, F.lit(0).cast("bigint"), lambda total, t: total + F.least(t["n"], F.coalesce(F.try_element_at(m, t["token"]), F.lit(0)))
    ))
    return F.struct(common.alias("n_common"), n(prediction).alias("n_prediction"), n(reference).alias("n_reference"))


def _f1(common: Column, n_prediction: Column, n_reference: Column) -> Column:
    """2PR / (P + R), which is 2·common / (n_prediction + n_reference); 0 without a common token."""
    return F.when(common > 0, F.lit(2.0) * common / (n_prediction + n_reference)).otherwise(F.lit(0.0))


def _f1_of(bags: Column) -> Column:
    return let(bags, lambda b: _f1(b["n_common"], b["n_prediction"], b["n_reference"]))


def squad_columns(prediction: Column | str, reference: Column | str) -> tuple[Column, Column]:
    """(squad_exact_match, squad_f1), both in 0..100."""
    p, r = squad_text(prediction), squad_text(reference)
    exact = F.when(p == r, 100.0).otherwise(0.0)
    return exact.alias("squad_exact_match"), (_f1_of(bag_overlap(tokens(p), tokens(r))) * 100.0).alias("squad_f1")


def rouge1_column(prediction: Column | str, reference: Column | str) -> Column:
    return _f1_of(bag_overlap(rouge_tokens(prediction), rouge_tokens(reference))).alias("rouge1")


def bleu1_column(prediction: Column | str, reference: Column | str) -> Column:
    """struct(n_common, n_prediction, n_reference), to be summed over pairs."""
    return bag_overlap(bleu_tokens(prediction), bleu_tokens(reference))


def squad_per_pair(pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, prediction, reference)`` → (pair_id, squad_exact_match, squad_f1)."""
    return pairs.select("pair_id", *squad_columns("prediction", "reference"))


def squad(pairs: DataFrame) -> DataFrame:
    """One row (n_pairs, squad_exact_match, squad_f1)."""
    return squad_per_pair(pairs).agg(
        F.count("*").alias("n_pairs"), F.avg("squad_exact_match").alias("squad_exact_match"),
        F.avg("squad_f1").alias("squad_f1"),
    )


def rouge1_per_pair(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", rouge1_column("prediction", "reference"))


def rouge1(pairs: DataFrame) -> DataFrame:
    """One row (n_pairs, rouge1): mean unigram F over pairs."""
    return rouge1_per_pair(pairs).agg(F.count("*").alias("n_pairs"), F.avg("rouge1").alias("rouge1"))


def bleu1_counts(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pairs.select("pair_id", *(by or []), bleu1_column("prediction", "reference").alias("_b")).select("pair_id", *(by or []), "_b.*")


def bleu1_score(matches: Column, candidate: Column, reference: Column) -> Column:
    """(m + 1) / (t + 1), times the brevity penalty; 0 without candidate tokens."""
    penalty = F.when(candidate > reference, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - reference / F.nullif(candidate, F.lit(0))))
    return F.coalesce((matches + F.lit(1.0)) / (candidate + F.lit(1.0)) * penalty, F.lit(0.0))


def bleu1(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Corpus BLEU with unigrams and add-one smoothing: one row, or one per group of ``by`` columns of ``pairs``."""
    counts = bleu1_counts(pairs, by)
    sums = counts.groupBy(*(by or [])).agg(
        F.count("*").alias("n_pairs"), F.sum("n_common").alias("_m"),
        F.sum("n_prediction").alias("_t"), F.sum("n_reference").alias("_r"),
    )
    return sums.select(*(by or []), "n_pairs", bleu1_score(F.col("_m"), F.col("_t"), F.col("_r")).alias("bleu1"))


# Token vectors of texts in their context: each text gives its tokens and one vector for each.
Encoder = Callable[[list[str]], list[tuple[list[str], np.ndarray]]]


# Pairs whose token vectors a worker holds at once, and tokens of one side in a matrix of cosines.
BERT_PAIRS = 32
BERT_TOKENS = 1_024


def _greedy(p: np.ndarray, r: np.ndarray, step: int = BERT_TOKENS) -> tuple[float, float]:
    """Means of the best cosine of each row of ``p`` and of each row of ``r``, all of unit length."""
    of_p, of_r = np.empty(len(p)), np.full(len(r), -np.inf)
    for at in range(0, len(p), step):
        cosine = p[at:at + step] @ r.T
        of_p[at:at + step] = cosine.max(axis=1)
        of_r = np.maximum(of_r, cosine.max(axis=0))
    return of_p.mean(), of_r.mean()


def bertscore_per_pair(pairs: DataFrame, factory: Callable[[], Encoder], key: str | None = None) -> DataFrame:
    """Greedy token matching by cosine: (pair_id, precision, recall, f1) with vectors of an injected encoder.

    The encoder sees whole texts, so that a token's vector may depend on its sentence; the distinct texts of ``BERT_PAIRS``
    pairs go to it in one call and a pair then costs matrix products of bounded height. A side without tokens scores 0.
    """
    key = key or uuid.uuid4().hex

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at:at + BERT_PAIRS] for whole in batches for at in range(0, len(whole), BERT_PAIRS)):
            encode = loaded(key, factory)
            sides = [batch[c].fillna("").tolist() for c in ("prediction", "reference")]
            distinct = list(dict.fromkeys(sides[0] + sides[1]))
            unit = {}
            for text, (found, vectors) in zip(distinct, encode(distinct) if distinct else []):
                x = np.asarray(vectors, dtype=np.float64)
                unit[text] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(found) else None
            rows = []
            for pair_id, p, r in zip(batch["pair_id"], *([unit[t] for t in side] for side in sides)):
                if p is not None and r is not None:
                    precision, recall = _greedy(p, r)
                    total = precision + recall
                    rows.append((pair_id, precision, recall, 2 * precision * recall / total if total else 0.0))
                else:
                    rows.append((pair_id, 0.0, 0.0, 0.0))
            yield pd.DataFrame(rows, columns=["pair_id", "precision", "recall", "f1"])

    schema = "pair_id bigint, precision double, recall double, f1 double"
    return pairs.select("pair_id", "prediction", "reference").mapInPandas(score, schema)


def bertscore(pairs: DataFrame, factory: Callable[[], Encoder], key: str | None = None) -> DataFrame:
    return bertscore_per_pair(pairs, factory, key).agg(
        F.count("*").alias("n_pairs"),
        *[F.avg(c).alias(f"bertscore_{c}") for c in ("precision", "recall", "f1")],
    )
