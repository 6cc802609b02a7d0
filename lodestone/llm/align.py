"""Alignment of two tokenizers: which tokens of one overlap which of the other, and where both end together."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ranking import BROADCAST_ROWS, at_most
from ..session import stored
from .shared import task_row_prefix, text_batches

# The texts that are aligned in one frame.
BATCH_BYTES = 512 << 10
# An id pair that holds more than this share of all linked documents' pairs is joined apart; there are fewer of them.
HOT_SHARE = 10_000

# How the byte-level pre-tokenizer of the library cuts a text.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# From this run of white space on, a text is left to the library itself; the matcher of ``CUT`` fails near a million.
BLANKS = 100_000

# encode(list of texts) -> list of token id lists; pieces: the bytes of each token id; lead: what the tokenizer puts first.
Tokens = tuple[Callable[[list[str]], list], list[bytes]]


@lru_cache(maxsize=2)
def byte_level(path: str) -> Tokens:
    """The byte-level BPE of a ``tokenizers`` file: (encode, bytes of each id); special tokens are ordinary text.

    A worker keeps it for its next tasks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # The printable stand-ins of bytes. Printable ones stand for themselves, others from U+0100 on in order.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    pieces = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    with open(path, encoding="utf-8") as file:
        ranked = _by_rank(tokenizer, json.load(file), pieces, byte_of)

    def own(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in batch([" " + t for t in texts], add_special_tokens=False)]

    def encode(texts: list[str]) -> list[list[int]]:
        return [own([t])[0] if _long_blank(t) else ranked(" " + t) for t in texts]

    return encode if ranked else own, pieces


def _long_blank(text: str) -> bool:
    return len(text) >= BLANKS and any(m.end() - m.start() >= BLANKS for m in re.finditer(r"\s+", text))


def _by_rank(tokenizer, spec: dict, pieces: list[bytes], byte_of: dict[str, int]) -> Callable[[str], list[int]] | None:
    """The ids of a text by token ranks, in a fifth of the library's time, if they are sure to be the library's; else None.

    They are if the file only cuts by ``CUT`` and merges, the vocabulary is 256 bytes and one token of each merge, ids rise
    with the merges, and the library makes every token of its own letters. Then neighbours that together spell a token are
    the two that its merge joins, and the lowest id among them is the next merge.
    """
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    changes = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or any(model.get(c) for c in changes) or any(spec.get(c) for c in ("normalizer", "truncation", "padding")):
        return None
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space", True) or not cut.get("use_regex", True):
        return None
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    letters = [vocab.get(c, -1) for c in byte_of]
    if min(letters) < 0 or any(a >= b for a, b in zip(made, made[1:])) or sorted(letters + made) != sorted(vocab.values()):
        return None
    if not all(t["special"] for t in spec["added_tokens"]) or not all(c in byte_of for t in vocab for c in t):
        return None
    if not all([x.id for x in tokenizer.model.tokenize(t)] == [i] for t, i in vocab.items()):
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=CUT, mergeable_ranks={pieces[i]: i for i in vocab.values()}, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def sentence_pieces(path: str) -> Tokens:
    """The pieces of a ``sentencepiece`` model, which itself puts a space first: (encode, bytes of each id)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            pieces.append(bytes([int(piece[1:-1], 16)]))
        else:
            pieces.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), pieces


def overlaps(start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of all overlapping tokens of the same document.

    Documents lie one behind the other on one axis; the tokens of each side cover every document without gaps, in order,
    so no start is covered by a token of another document. Each start finds the other side's token that covers it; two
    tokens overlap exactly if one of them starts inside the other, so the union of both directions has all.
    """
    a = pd.DataFrame({"start": start_a, "i": np.arange(len(start_a))})
    b = pd.DataFrame({"start": start_b, "j": np.arange(len(start_b))})
    in_a = pd.merge_asof(a, b, on="start")
    in_b = pd.merge_asof(b, a, on="start")
    # Tokens that start together are found from both sides.
    later = in_b["start"].to_numpy() != start_a[in_b["i"].to_numpy()]
    i = np.concatenate((in_a["i"].to_numpy(), in_b["i"].to_numpy()[later]))
    j = np.concatenate((in_a["j"].to_numpy(), in_b["j"].to_numpy()[later]))
    return i, j


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values, kind))


class _Aligner:
    """The alignment of batches of texts inside a task."""

    def __init__(self, load_a: Callable[[], Tokens], load_b: Callable[[], Tokens], digest: bool) -> None:
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = load_a(), load_b()
        self.size_a, self.size_b = (np.array([len(p) for p in pieces], dtype=np.int64) for pieces in (self.bytes_a, self.bytes_b))
        # Every id as it is written inside a group and at its end.
        self.written_a = np.array([f"{i}," for i in range(len(self.bytes_a))] + [f"{i}|" for i in range(len(self.bytes_a))], dtype=object)
        self.written_b = np.array([f"{i}," for i in range(len(self.bytes_b))] + [f"{i};" for i in range(len(self.bytes_b))], dtype=object)
        self.digest = digest

    def _encoded(self, encode, pieces: list[bytes], texts: list[str], whole: list[bytes]) -> list[list[int]]:
        """Ids of each text, none where their bytes are not the text's."""
        return [ids if b"".join(map(pieces.__getitem__, ids)) == w else [] for ids, w in zip(encode(texts), whole)]

    def batch(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        n = len(texts)
        some = [i for i, t in enumerate(texts) if t]
        shown = [texts[i].decode("utf-8", "surrogatepass") for i in some]
        # A text that is no valid Unicode cannot be encoded as given.
        shown = [s.encode("utf-8", "replace").decode() for s in shown]
        whole = [b" " + texts[i] for i in some]
        both = [(a, b) if a and b else ([], []) for a, b in zip(
            self._encoded(self.encode_a, self.bytes_a, shown, whole), self._encoded(self.encode_b, self.bytes_b, shown, whole))]
        n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        n_a[some], n_b[some] = [len(a) for a, _ in both], [len(b) for _, b in both]
        ids_a = np.fromiter(chain.from_iterable(a for a, _ in both), np.int64, n_a.sum())
        ids_b = np.fromiter(chain.from_iterable(b for _, b in both), np.int64, n_b.sum())
        # One axis for the whole batch: both sides have the same bytes in each document.
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        doc_a = np.repeat(np.arange(n), n_a)
        i, j = overlaps(end_a - self.size_a[ids_a], end_b - self.size_b[ids_b])

        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        n_groups = np.bincount(doc_a[last_a], minlength=n)
        doc, width = doc_a[i], len(self.bytes_a) * len(self.bytes_b)
        # One number for a document and an id pair: the documents of a batch are few.
        linked = np.sort(doc * width + ids_a[i] * len(self.bytes_b) + ids_b[j])
        fresh = np.flatnonzero(np.diff(linked, prepend=-1))
        doc_of, pair = np.divmod(linked[fresh], width)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc, minlength=n), "pair": pair,
            "times": np.diff(np.append(fresh, len(linked))), "n_pairs": np.bincount(doc_of, minlength=n),
            "groups": self._groups(n_a, n_b, ids_a, ids_b, last_a, last_b),
        }

    def _groups(self, n_a, n_b, ids_a, ids_b, last_a, last_b) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document: the ids of both sides, group by group."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        before_b = np.concatenate(([0], np.cumsum(size_b)))
        through_a = np.cumsum(size_a)
        written = np.empty(len(ids_a) + len(ids_b), dtype=object)
        if len(ids_a):
            written[np.arange(len(ids_a)) + before_b[group_a]] = self.written_a[ids_a + len(self.bytes_a) * last_a]
            written[np.arange(len(ids_b)) + through_a[group_b]] = self.written_b[ids_b + len(self.bytes_b) * last_b]
        ends = np.cumsum(n_a + n_b)
        out, low = [], 0
        for high in ends.tolist():
            text = "".join(written[low:high])[:-1]
            out.append(hashlib.sha256(text.encode()).hexdigest() if self.digest and high > low else text)
            low = high
        return out


def align(df: DataFrame, key: str, text: str, load_a: Callable[[], Tokens], load_b: Callable[[], Tokens], digest: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row: how two tokenizers cut its text.

    Both tokenizers cut a space and the whole text; ``load_a`` and ``load_b`` build them in the tasks (``byte_level`` and
    ``sentence_pieces`` for files). ``n_groups``: byte offsets where a token ends on both sides. ``n_links``: pairs of
    an A and a B token that overlap. An id pair counts the rows, in the whole table, that hold it linked. ``n_best``:
    links whose count is the highest that their A id has, ties included. ``count_sum``: counts summed over the links.
    ``groups``: ids by group as ``a1,a2|b1;a3|b2,b3``, or its SHA-256 in hexadecimal with ``digest``.

    A null or empty text, or one whose tokens of either side do not spell the text, has no tokens: zeros and empty
    groups. Every row is a document of its own, also repeated ones and those without a key; keys of any type are handed
    through. Other columns are not read.

    Texts are encoded once, in their own task; distinct pairs of each row and their number are written and counted by
    pair with a combine before the shuffle. Counts come back to the rows by a broadcast if the distinct pairs are few
    enough, checked; else pairs in very many rows are broadcast (fewer than ``HOT_SHARE``) and the others, none of which
    can fill a task, are joined by shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _Aligner(load_a, load_b, digest), task_row_prefix()
        rows = ({"key": k, "text": t.as_py()} for batch in batches for k, t in zip(batch.column(0), batch.column(1)))
        for held, texts in text_batches(rows, "text", BATCH_BYTES):
            found = aligner.batch(texts)
            ends = np.cumsum(found["n_pairs"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(held)), pa.int64()), pa.array([r["key"].as_py() for r in held], key_type),
                 *(pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(found["groups"], pa.string()),
                 _lists(found["pair"], ends, pa.int64()), _lists(found["times"], ends, pa.int32())],
                names=["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
            row += len(held)

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(df.schema[key].dataType)
    made = stored(df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"row bigint, key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
             "pairs array<bigint>, times array<int>"), "align-rows")
    width = len(load_b()[1])
    counts = made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    a_id = F.expr(f"pair div {width}")
    best = F.max("count").over(W.partitionBy(a_id))
    counts = stored(counts.withColumn("best", F.col("count") == best), "align-counts")
    links = made.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = _summed(links, counts).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero: Column = F.lit(0).cast("bigint")
    return made.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups")


def _summed(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``links`` with the count of each pair."""
    if at_most(counts, 5 * BROADCAST_ROWS):  # of three numbers each
        return links.join(F.broadcast(counts), "pair")
    total = counts.agg(F.sum("count")).head()[0]
    hot = counts.filter(F.col("count") > total // HOT_SHARE)
    is_hot = links.join(F.broadcast(hot.select("pair", F.lit(True).alias("hot"))), "pair", "left")
    frequent = is_hot.filter("hot").drop("hot").join(F.broadcast(hot), "pair")
    others = is_hot.filter("hot is null").drop("hot").join(counts.filter(F.col("count") <= total // HOT_SHARE), "pair")
    return frequent.unionByName(others)
