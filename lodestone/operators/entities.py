"""Entity terms: spans of an injected model, capitalised phrases, or matches of a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import infer
from .ranking import broadcast_if, fits
from ..functions.text import normalize_ws, strip, words

# A run of capitalised words separated by single spaces.
PHRASE = r"\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*"


def phrases(c: Column | str) -> Column:
    """Lower-cased capitalised phrases in text order."""
    return F.transform(F.regexp_extract_all(normalize_ws(c), F.lit(PHRASE), F.lit(0)), F.lower)


def find(
    df: DataFrame, text: str, output: str, finder: infer.Factory | None = None, batch_size: int = 16
) -> DataFrame:
    """Add the array column ``output`` with the lower-cased, stripped entity spans of a text column.

    ``finder`` is a model from texts to lists of spans; without one the capitalised phrases count.
    """
    if finder is None:
        return df.withColumn(output, phrases(text))
    found = infer.run(df, finder, text, output, "array<string>", batch_size)
    return found.withColumn(output, F.transform(output, lambda span: F.lower(strip(span))))


def dictionary_matches(chunks: DataFrame, dictionary: DataFrame, max_words: int = 3) -> DataFrame:
    """(chunk_id, entity, n_mentions) for every run of 1..max_words words that is an ``entity`` of the dictionary."""
    tokens = chunks.select("chunk_id", words("text_content").alias("_w"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - (n - 1)))
        spelled = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(F.col("_w"), i, n)))
        return F.coalesce(spelled, F.array().cast("array<string>"))

    grams = tokens.select("chunk_id", F.explode_outer(F.concat(*[runs(n) for n in range(1, max_words + 1)])).alias("entity"))
    small = fits(dictionary, "entity")
    return (
        grams.join(broadcast_if(dictionary.select("entity").distinct(), small), "entity")
        .groupBy("chunk_id", "entity")
        .agg(F.count("*").alias("n_mentions"))
    )
