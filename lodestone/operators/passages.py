"""Exact passage containment: which chunks hold a passage word for word, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import BROADCAST_BYTES, broadcast_if, fits
from ..functions.text import WS

ANCHOR_CHARS = 8


def _char_grams(text: Column, n: int) -> Column:
    """Every run of ``n`` characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def containing_chunks(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(passage_id, chunk_id) for every chunk whose text contains the non-empty passage.

    A chunk that contains a passage holds the passage's inner tokens, those between two white spaces, as whole tokens.
    An equality join on the longest of them (long tokens are rare) finds all candidates, at most one per passage and
    chunk, and the text test confirms them. Passages without an inner token are matched on their first characters.
    """
    pieces = F.split("passage", WS)
    inner = F.filter(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))), lambda t: F.length(t) > 0)
    longest = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    anchored = passages.filter(F.length("passage") > 0).select(
        "passage_id", "passage", F.coalesce(longest, F.substring("passage", 1, ANCHOR_CHARS)).alias("anchor"),
        F.when(longest.isNull(), F.least(F.length("passage"), F.lit(ANCHOR_CHARS))).alias("n_chars"),
    )
    small = fits(passages, "passage", BROADCAST_BYTES)
    text = F.col("text_content")
    # explode_outer, as a plain explode would split every text once more in a filter on the array's size.

    def find(side: DataFrame, grams: Column) -> DataFrame:
        keyed = broadcast_if(side.select("passage_id", "passage", "anchor"), small)
        if small:
            # The text rides along each candidate and is tested in the same task; nothing is shuffled.
            hits = chunks.select("chunk_id", text, F.explode_outer(F.array_distinct(grams)).alias("anchor")).join(keyed, "anchor")
        else:
            rows = chunks.select("chunk_id", F.explode_outer(F.array_distinct(grams)).alias("anchor"))
            pairs = rows.join(keyed.drop("passage"), "anchor").select("passage_id", "chunk_id")
            hits = pairs.join(chunks.select("chunk_id", text), "chunk_id").join(passages, "passage_id")
        return hits.filter(F.contains(text, F.col("passage"))).select("passage_id", "chunk_id")

    found = find(anchored.filter(F.col("n_chars").isNull()), F.split(text, WS))
    # At most ANCHOR_CHARS sizes come back here.
    for (n,) in anchored.select("n_chars").filter(F.col("n_chars").isNotNull()).distinct().collect():
        found = found.unionByName(find(anchored.filter(F.col("n_chars") == n), _char_grams(text, n)))
    return found


def gold_chunks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id): the lowest chunk that contains the question's text; questions without one are absent."""
    passages = questions.select(F.col("question_id").alias("passage_id"), F.col("question").alias("passage"))
    return containing_chunks(passages, chunks).groupBy(F.col("passage_id").alias("question_id")).agg(
        F.min("chunk_id").alias("chunk_id")
    )
