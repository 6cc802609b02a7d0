"""Byte-level BPE by overlapping chunks: texts to ids and back."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows, task_row_prefix

CHUNK = 16_384
OVERLAP = 1_024
# A boundary this close to the end of a chunk may depend on characters beyond it.
GUARD = 16


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, start: int, pattern: str) -> np.ndarray:
    """Pre-token boundaries of ``text`` read from its beginning, as positions in the document (it starts at ``start``)."""
    return start + np.array([0, *(m.end() for m in _compiled(pattern).finditer(text))], dtype=np.int64)


def stitched(parts: list[tuple[int, str, np.ndarray]], pattern: str, guard: int = GUARD) -> Iterator[str]:
    """Pre-tokens of a document from its overlapping chunks (start, text, boundaries), in order.

    From a position where two readings both have a boundary they go on alike, as the pattern never looks back. So the
    earlier chunk serves up to the first common boundary of the overlap and the later one from there. Chunks that share
    none (a run without a boundary) are joined into one and read again, until all neighbours agree.
    """
    parts = list(parts)
    k = 0
    cuts = [parts[0][0]]
    while k + 1 < len(parts):
        (a, text, left), (b, following, right) = parts[k], parts[k + 1]
        safe = a + len(text) - guard
        last = k + 2 == len(parts)
        common = np.intersect1d(left[left <= safe], right if last else right[right <= b + len(following) - guard])
        common = common[common >= max(b, cuts[-1])]
        if len(common):
            cuts.append(int(common[0]))
            k += 1
            continue
        joined = text + following[max(0, a + len(text) - b):]
        parts[k: k + 2] = [(a, joined, boundaries(joined, a, pattern))]
        if k and not np.isin(cuts[-1], parts[k][2]):  # the earlier cut must stay a boundary of the joined chunk
            k -= 1
            cuts.pop()
    cuts.append(parts[-1][0] + len(parts[-1][1]))
    for (start, text, marks), low, high in zip(parts, cuts, cuts[1:]):
        inside = marks[(marks >= low) & (marks <= high)] - start
        for i, j in zip(inside, inside[1:]):
            yield text[i:j]


def _texts_to(df: DataFrame, key: str, text: str, ranks: bytes, pattern: str, chunk: int, overlap: int,
              finish: Callable, schema: str) -> DataFrame:
    """One row per text: ``finish(key, ids, encoding)`` under ``schema``.

    A text within one chunk is encoded where it is read. A longer one is cut into overlapping chunks that are spread
    over the cluster to find their boundaries, and then meet for stitching; only long texts are shuffled.
    """
    held = df.sparkSession.sparkContext.broadcast(ranks)  # the rank file, about 1 MB
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.char_length("text") > chunk

    def whole(items: Iterator[dict]) -> Iterator[dict]:
        encoding = _encoding(held.value, pattern)
        for r in items:
            yield finish(r["key"], encoding.encode_ordinary(r["text"]), encoding)

    def cut(items: Iterator[dict]) -> Iterator[dict]:
        for n, r in enumerate(items, task_row_prefix()):
            body = r["text"]
            for start in range(0, max(len(body) - overlap, 1), chunk - overlap):
                yield {"row": n, "key": r["key"], "start": start, "text": body[start: start + chunk]}

    def read(items: Iterator[dict]) -> Iterator[dict]:
        for r in items:
            yield r | {"marks": boundaries(r["text"], r["start"], pattern).tobytes()}

    def join(group):
        import pyarrow as pa

        encoding = _encoding(held.value, pattern)
        parts = sorted(group.select(["start", "text", "marks"]).to_pylist(), key=lambda p: p["start"])
        parts = [(p["start"], p["text"], np.frombuffer(p["marks"], dtype=np.int64)) for p in parts]
        ids: list[int] = []
        for piece in stitched(parts, pattern):
            ids.extend(encoding._encode_single_piece(piece))
        row = finish(group.column("key")[0].as_py(), ids, encoding)
        return pa.Table.from_pylist([row], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    chunks = map_rows(rows.filter(long), cut, "row bigint, key bigint, start bigint, text string")
    read_ = map_rows(
        chunks.repartition("row", "start"), read, "row bigint, key bigint, start bigint, text string, marks binary"
    )
    return map_rows(rows.filter(~long), whole, schema).unionByName(read_.groupBy("row").applyInArrow(join, schema))


def encode(df: DataFrame, key: str, text: str, ranks: bytes, pattern: str,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key bigint, ids array<int>) of each row's whole text.

    ``ranks`` is the content of a rank file (one base64 token and its rank per line) and ``pattern`` splits text before
    the merges. A null text has no ids; equal rows give equal rows; other columns are not read.
    """
    return _texts_to(df, key, text, ranks, pattern, chunk, overlap,
                     lambda k, ids, e: {"key": k, "ids": ids}, "key bigint, ids array<int>")


def decode(df: DataFrame, key: str, ids: str, ranks: bytes, pattern: str) -> DataFrame:
    """(key bigint, bytes binary): the tokens' bytes put together. Null ids give empty bytes; unknown ids are errors."""
    held = df.sparkSession.sparkContext.broadcast(ranks)

    def run(items: Iterator[dict]) -> Iterator[dict]:
        encoding = _encoding(held.value, pattern)
        for r in items:
            yield {"key": r["key"], "bytes": encoding.decode_bytes(r["ids"] or [])}

    return map_rows(df.select(F.col(key).alias("key"), F.col(ids).alias("ids")), run, "key bigint, bytes binary")


def digests(df: DataFrame, key: str, text: str, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP,
            with_ids: bool = False) -> DataFrame:
    """``encode`` and ``decode`` in one pass that returns digests, and the ids themselves only if asked for.

    (key, n_tokens, ids_sha256 of the decimal ids joined by a space, decoded_sha256 of the decoded bytes[, ids]).
    """
    def finish(k, ids, encoding):
        return {
            "key": k, "n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(encoding.decode_bytes(ids)).hexdigest(),
        } | ({"ids": np.array(ids, dtype=np.int32)} if with_ids else {})

    return _texts_to(df, key, text, ranks, pattern, chunk, overlap, finish,
                     "key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                     + ", ids array<int>" * with_ids)
