"""Fixed-length token chunks of documents, by words or by the tokens of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import infer
from ..config import CHUNK_TOKENS
from ..functions.text import tokens

# Chunk ids hold the document id above these bits and the position below.
POSITION_BITS = 20


def chunk_id(doc_id: Column, position: Column) -> Column:
    """Document id and position in one number; an error if either does not fit, so that no two chunks share an id."""
    doc_id, position = doc_id.cast("bigint"), position.cast("bigint")
    fits = (F.abs(doc_id) < 1 << (63 - POSITION_BITS)) & (position < 1 << POSITION_BITS)
    return F.when(fits | doc_id.isNull() | position.isNull(), F.shiftleft(doc_id, POSITION_BITS) + position).otherwise(
        F.raise_error(F.lit("a document id or a chunk position is too large for a chunk id")).cast("bigint")
    )


def chunk(documents: DataFrame, size: int = CHUNK_TOKENS, overlap: int = 0) -> DataFrame:
    """``documents(doc_id, text, ...)`` cut into runs of ``size`` tokens: adds chunk_id, position, n_tokens, text_content.

    Works row by row, without a shuffle. Documents without tokens have no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    step = size - overlap
    split = documents.withColumn("_t", tokens("text")).filter(F.size("_t") > 0)
    last = F.greatest(F.size("_t") - F.lit(overlap), F.lit(1))
    starts = F.sequence(F.lit(1), last, F.lit(step))
    pieces = split.select("*", F.posexplode(F.transform(starts, lambda i: F.slice(F.col("_t"), i, size))).alias("position", "_p"))
    return pieces.select(
        *documents.drop("text").columns,
        chunk_id(F.col("doc_id"), F.col("position")).alias("chunk_id"),
        F.col("position").cast("bigint").alias("position"),
        F.size("_p").cast("bigint").alias("n_tokens"),
        F.array_join("_p", " ").alias("text_content"),
    )


def tokenizer_starts(path: str) -> infer.Factory:
    """Factory for ``chunk_subwords`` from a tokenizer file that every worker can read; strings of special tokens are plain text."""
    def factory() -> infer.Model:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [[start for start, _ in e.offsets] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return factory


def _cut(text: str, starts: list[int], size: int, step: int) -> list[tuple[int, int, int, str]]:
    """(start_char, end_char, n_tokens, text) of each run of tokens; what lies before the first token or after the last belongs to it."""
    n, out = len(starts), []
    for at in range(0, n, step):
        upto = min(at + size, n)
        a, b = starts[at] if at else 0, starts[upto] if upto < n else len(text)
        out.append((a, b, upto - at, text[a:b]))
        if upto == n:
            break
    return out


def chunk_subwords(
    documents: DataFrame, starts: infer.Factory, size: int = CHUNK_TOKENS, overlap: int = 0, batch_size: int = 64
) -> DataFrame:
    """``documents(doc_id, text, ...)`` cut into runs of ``size`` tokens of a model: adds chunk_id, position, start_char,
    end_char, n_tokens, text_content.

    ``starts`` builds a model that maps texts to the places of their tokens' first characters, in rising order. A chunk is the text itself,
    not tokens joined again: without overlap, the chunks of a document are its text when joined. A character that
    several tokens share goes to the chunk of the latest of them. Null and empty texts have no chunk. Works row by row,
    without a shuffle; a worker holds the tokens of ``batch_size`` texts, of which only the chunks leave it.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    step = size - overlap

    def factory() -> infer.Model:
        model = starts()
        return lambda texts: [_cut(t, s, size, step) for t, s in zip(texts, model(texts))]

    taken = {c.lower() for c in documents.columns}
    pieces = next(name for name in ("_chunks", "_chunks_", "_chunks__") if name not in taken)
    kind = "array<struct<start_char:bigint,end_char:bigint,n_tokens:bigint,text_content:string>>"
    cut = infer.run(documents.filter("text <> ''"), factory, "text", pieces, kind, batch_size)
    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() != "text"]
    spread = cut.select(*kept, F.posexplode(pieces).alias("position", pieces))
    return spread.select(
        *kept, chunk_id(F.col("doc_id"), F.col("position")).alias("chunk_id"), F.col("position").cast("bigint").alias("position"),
        f"{pieces}.*")
