"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import top_k

UNKNOWN = "und"
# Bounds of the training sample of each language: texts, characters of each, bytes of the dictionary.
SAMPLE_TEXTS = 128
SAMPLE_CHARS = 4_096
DICTIONARY_BYTES = 128 << 10
# More labels than this are taken for a wrong column.
MAX_LANGUAGES = 1_000
LEVEL = 5
# A text is encoded in pieces of this many bytes, so that it cannot become its own dictionary.
PIECE = 4_096
# A shorter text is repeated up to this length: zstandard stores very short blocks as they are.
SHORT = 256
# Saved bytes of the best against the second language, as a share of the second's bytes; below it a text is rejected.
MIN_MARGIN = 0.002

_NO_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> bytes:
    """Lower-case letters with single blanks between runs; empty if there is no letter."""
    letters = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {letters} ".encode("utf-8", "surrogatepass") if any(map(str.isalpha, letters)) else b""


def learn(df: DataFrame, key: str, text: str, lang: str) -> list[tuple[str, int, bytes]]:
    """(language, learned texts, raw-content dictionary) by falling number of texts.

    A sample bounded by ``SAMPLE_TEXTS`` times ``SAMPLE_CHARS`` a language, chosen by the hash of ``key`` whatever the
    number of rows, is all that reaches the driver. Of each of its texts the first 1/64 of ``DICTIONARY_BYTES`` (2,048
    bytes of letters) are taken, and of these joined the last ``DICTIONARY_BYTES`` are learned: 64 full texts, or more
    shorter ones; what was sampled beyond that is not learned. Rows without a label or a letter teach nothing.
    """
    rows = df.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    counts = dict(map(tuple, rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()))
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    cut = rows.select("lang", F.xxhash64("k").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    held: dict[str, list[bytes]] = {}
    for r in top_k(cut, ["lang"], [F.col("h"), F.col("text")], SAMPLE_TEXTS).orderBy("lang", "rank").collect():
        held.setdefault(r.lang, []).append(normalised(r.text)[: DICTIONARY_BYTES // 64])
    order = sorted(counts, key=lambda x: (-counts[x], x))
    return [(x, counts[x], b"".join(held[x])[-DICTIONARY_BYTES:]) for x in order]


def _sizes(models: list[tuple[str, int, bytes]]):
    import zstandard as zstd

    tools = []
    for _, _, raw in models:
        parameters = zstd.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(raw), source_size=PIECE, min_match=3,
            write_checksum=0, write_content_size=0, write_dict_id=0,
        )
        # A dictionary below 8 bytes can match nothing and is not accepted.
        data = zstd.ZstdCompressionDict(raw.ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        tools.append(zstd.ZstdCompressor(dict_data=data, compression_params=parameters))

    def of(text: bytes) -> list[int]:
        if len(text) < SHORT:
            text *= -(-SHORT // len(text))
        pieces = [text[i: i + PIECE] for i in range(0, len(text), PIECE)]
        return [sum(len(tool.compress(p)) for p in pieces) for tool in tools]

    return of


def verdict(models: list[tuple[str, int, bytes]], sizes: list[int], min_margin: float) -> tuple[str, float, bool]:
    """(language, score, rejected) from the encoded bytes under each language; ties go to the more frequent one."""
    ranked = sorted(range(len(models)), key=lambda i: (sizes[i], i))
    best, second = sizes[ranked[0]], sizes[ranked[1]] if len(ranked) > 1 else None
    if second is None:
        return models[0][0], 1.0, False
    score = 1 / sum(math.exp(max((best - s) / 2, -700)) for s in sizes)
    return models[ranked[0]][0], score, (second - best) / second < min_margin


def identify(df: DataFrame, text: str, models: list[tuple[str, int, bytes]], min_margin: float = MIN_MARGIN,
             keep: list[str] | None = None) -> DataFrame:
    """Each row's language from its whole text: the columns ``keep`` (all if None), lang_pred, score, rejected.

    The text is encoded once per language, the smallest encoding wins, ``score`` (0 to 1) rises with the bytes saved
    against the others, and ``rejected`` marks a margin below ``min_margin``. A null text, or one without any letter,
    is ``und`` with score 0 and rejected, as is every text if nothing was learned. Rows are kept apart, also equal
    ones. Columns that have the name of a result are replaced. Works inside each row, without a shuffle.
    """
    results = T.StructType.fromDDL("lang_pred string, score double, rejected boolean")
    taken = {n.lower() for n in results.names}
    held = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    rows = df.select(*(F.col(f"`{c}`") for c in held), *([] if text in held else [F.col(text)]))
    at, width = rows.columns.index(text), len(held)
    schema = T.StructType([df.schema[c] for c in held] + results.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(models)
        for batch in batches:
            found = []
            for value in batch.column(at):
                letters = normalised(value.as_py())
                found.append(verdict(models, sizes(letters), min_margin) if letters and models else (UNKNOWN, 0.0, True))
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names[:width], *results.names])

    return rows.mapInArrow(run, schema)


def held_out(key: str) -> Column:
    """Rows that a model is not to learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
