"""Language-model scores from an Elias-Fano n-gram trie that is built and asked in shards."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .shared import hashed_words, mix64, task_row_prefix, text_batches

# Added to every count of single tokens, and taken from every count of longer n-grams.
ADDED, DISCOUNT = 0.1, 0.75
# Text bytes whose tokens are handled together, and tokens (about) of one shard of a level of the model.
BLOCK_BYTES, SHARD_TOKENS = 8 << 20, 1 << 20
# Following tokens are told apart by this many bits of their hash, within one context, and contexts of several tokens by
# the bits of this mask: among 10^13 contexts one in 7,000 shares its name.
CHILD_BITS, CONTEXT_MASK = 28, np.uint64(0xFFFFFFFFFFFFFF00)
# Step of the quantised logarithms; code 0 is "not there".
STEP = 1 / 2_000
END, START = (int(x) for x in mix64(np.array([0x0E0D, 0x57A7], dtype=np.uint64)))


def child_bits(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(64 - CHILD_BITS)


def extended(contexts: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Names of the contexts that are one token longer."""
    return mix64(contexts * np.uint64(0x9FB21C651E98DF25) + children) & CONTEXT_MASK


def start_of(level: int) -> int:
    """The context of a text's first token at a level: nothing but starts."""
    name = np.array([START], dtype=np.uint64)
    for _ in range(level - 2):
        name = extended(name, child_bits(np.array([START], dtype=np.uint64)))
    return int(name[0])


def quantised(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities in (0, 1]."""
    return np.clip(np.round(-np.log10(p) / STEP), 0, 65_534).astype(np.uint16) + np.uint16(1)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(np.float64) - 1) * STEP), 0.0)


def packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: high planes of small numbers take next to nothing."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


# Position of the k-th one of a byte, at k * 256 + byte.
_PLACE = np.array([([b for b in range(8) if i >> b & 1] + [8] * 8)[k] for k in range(8) for i in range(256)], dtype=np.uint64)
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _upto(words: np.ndarray) -> np.ndarray:
    """Ones up to the end of each byte of 64-bit words, byte by byte (lowest first)."""
    n = words - ((words >> np.uint64(1)) & np.uint64(0x5555555555555555))
    n = (n & np.uint64(0x3333333333333333)) + ((n >> np.uint64(2)) & np.uint64(0x3333333333333333))
    return ((n + (n >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES


class EliasFano:
    """A rising sequence of integers in about 2 + log2(range / length) bits each.

    High parts stand as a bit vector (a one for each number, a zero after each value of the high part) with running
    counts per 64-bit word, low parts as packed bits. ``arrays`` can be written to a file and mapped from it.
    """

    def __init__(self, arrays: dict[str, np.ndarray], length: int, low: int):
        self.arrays, self.length, self.low = arrays, length, low

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low)).astype(np.int64)
        bits = np.zeros((n + (universe >> low) + 2 + 63) // 64 * 64, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))))
        lows = np.zeros((n * low + 63) // 64 + 1, dtype=np.uint64)
        if low:
            part = values & np.uint64((1 << low) - 1)
            at = np.arange(n, dtype=np.int64) * low
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(lows, word, part << shift)
            over = shift.astype(np.int64) + low > 64
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls({"words": words, "ones": ones, "lows": lows}, n, low)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one, or zero, of the bit vector."""
        ones = self.arrays["ones"]
        before = ones if one else np.arange(len(ones), dtype=np.int64) * 64 - ones
        word = np.searchsorted(before, k, side="right") - 1
        rest = k - before[word]
        raw = self.arrays["words"][word]
        raw, rest = raw if one else ~raw, rest.astype(np.uint64)
        upto = _upto(raw)
        # The top bit of each byte tells whether no more than ``rest`` ones stand up to its end.
        full = ((((rest * _BYTES) | _TOPS) - upto) & _TOPS) >> np.uint64(7)
        shift = ((full * _BYTES) >> np.uint64(56)) << np.uint64(3)
        rest -= ((upto << np.uint64(8)) >> shift) & np.uint64(255)
        return word * 64 + (shift + _PLACE[(rest << np.uint64(8)) | ((raw >> shift) & np.uint64(255))]).astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        lows = self.arrays["lows"]
        out = lows[word] >> shift
        over = shift > 0
        out[over] |= lows[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low) | self._lows(i)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number not below each of ``x``, and the end of the run of numbers that share its high part."""
        high = (x >> np.uint64(self.low)).astype(np.int64)
        at = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        end = self._select(high, False) - high
        stop, goal = end.copy(), x & np.uint64((1 << self.low) - 1)
        open_ = np.flatnonzero(at < stop)
        while len(open_):  # halves what is left of each run, which is long where numbers crowd
            middle = (at[open_] + stop[open_]) >> 1
            below = self._lows(middle) < goal[open_]
            at[open_[below]] = middle[below] + 1
            stop[open_[~below]] = middle[~below]
            open_ = open_[at[open_] < stop[open_]]
        return at, end

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number not below each of ``x`` (the length if there is none)."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each of ``x``, or -1 where it is not in the sequence."""
        if not self.length:
            return np.full(len(x), -1, dtype=np.int64)
        out = np.full(len(x), -1, dtype=np.int64)
        for start in range(0, len(x), 1 << 16):
            some = x[start: start + (1 << 16)]
            at, end = self._search(some)
            inside = np.flatnonzero(at < end)  # the successor shares the high part, so equal low parts decide
            same = inside[self._lows(at[inside]) == some[inside] & np.uint64((1 << self.low) - 1)]
            out[start + same] = at[same]
        return out


class Trie:
    """One step of n-grams: contexts of one length with monotone pointers to their followers, and the followers.

    A follower is stored relative to its context (context's rank, then ``CHILD_BITS`` of its hash), so that all followers
    form one rising sequence and are found by successor search within the context's range. Payloads are 16-bit codes:
    the discounted share of each follower, and the weight that each context leaves to the next shorter one. All arrays
    lie in one file that is mapped into memory.
    """

    def __init__(self, context: np.ndarray, child: np.ndarray, count: np.ndarray, base: int, width: int,
                 totals: dict[int, int], folder: str):
        """Rows sorted by (context, child), counts above 0. ``totals`` has counts of contexts that other shards share."""
        names, first, kids = np.unique(context, return_index=True, return_counts=True)
        total = np.add.reduceat(count, first) if len(names) else np.zeros(0, dtype=np.int64)
        total = np.array([totals.get(int(c), int(t)) for c, t in zip(names, total)], dtype=np.float64) if totals else total.astype(np.float64)
        rank = np.repeat(np.arange(len(names), dtype=np.uint64), kids)
        self.base, self.names, self.kids = base, names, kids
        levels = {
            "contexts": EliasFano.of(names - np.uint64(base), width),
            "pointers": EliasFano.of(np.concatenate((first, [len(context)])).astype(np.uint64), len(context) + 1),
            "children": EliasFano.of(rank << np.uint64(CHILD_BITS) | child, max(len(names), 1) << CHILD_BITS),
        }
        arrays = {f"{n}.{k}": v for n, level in levels.items() for k, v in level.arrays.items()}
        arrays["weight"] = quantised(np.minimum(DISCOUNT * kids / np.maximum(total, 1), 1.0))
        arrays["share"] = quantised((count - DISCOUNT) / np.repeat(np.maximum(total, 1), kids))
        path, at = os.path.join(folder, "levels"), {}
        with open(path, "wb") as f:
            for name, x in arrays.items():
                at[name] = (f.tell(), x.dtype, len(x))
                f.write(x.tobytes())
                f.write(bytes(-f.tell() % 8))
        mapped = np.memmap(path, dtype=np.uint8, mode="r")
        view = {n: mapped[o: o + d.itemsize * m].view(d) for n, (o, d, m) in at.items()}
        self.levels = {n: EliasFano({k: view[f"{n}.{k}"] for k in level.arrays}, level.length, level.low) for n, level in levels.items()}
        self.weight, self.share = view["weight"], view["share"]

    def ask(self, contexts: np.ndarray, kids: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight code of each context, share code of each of its ``kids`` children); 0 where unknown."""
        at = self.levels["contexts"].find(contexts - np.uint64(self.base))
        weight, share = np.zeros(len(at), dtype=np.uint16), np.zeros(len(child), dtype=np.uint16)
        weight[at >= 0] = self.weight[at[at >= 0]]
        known = np.flatnonzero(at >= 0)
        low, high = (self.levels["pointers"].access(at[known] + i).astype(np.int64) for i in (0, 1))
        some = np.flatnonzero(np.repeat(at >= 0, kids))
        place = self.levels["children"].find(np.repeat(at[known], kids[known]).astype(np.uint64) << np.uint64(CHILD_BITS) | child[some])
        # Pointers bound each context's range; what is found outside it is not a follower of this context.
        inside = np.flatnonzero((place >= np.repeat(low, kids[known])) & (place < np.repeat(high, kids[known])))
        share[some[inside]] = self.share[place[inside]]
        return weight, share


def _block(rows: list[dict], texts: list[bytes]) -> dict:
    """Tokens of a block of documents: distinct tokens by falling count, the sequence of their numbers, counts learned."""
    parts, counts = [], []
    for i in range(0, len(texts), 256):
        words, n = hashed_words(texts[i: i + 256])
        parts.append(words)
        counts.append(n)
    words, counts = np.concatenate(parts), np.concatenate(counts)
    tokens = np.empty(len(words) + len(texts), dtype=np.uint64)
    tokens[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)] = words
    lengths = counts + 1
    tokens[np.cumsum(lengths) - 1] = END
    names, number, n = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    sequence = place[number]
    learns = np.array([bool(r["train"]) for r in rows])
    learned = np.bincount(sequence[np.repeat(learns, lengths)], minlength=len(names)).astype(np.uint64)
    keys = np.array([r["key"] if r["key"] is not None else 0 for r in rows], dtype=np.int64)
    valid = np.array([r["key"] is not None for r in rows], dtype=np.uint8)
    return {
        "tokens": int(lengths[learns].sum()), "texts": int(learns.sum()), "size": len(tokens), "a": names[order].tobytes(),
        "b": packed(learned), "c": packed(sequence),
        "d": keys.tobytes() + lengths.astype(np.int64).tobytes() + valid.tobytes() + learns.astype(np.uint8).tobytes(),
    }


def _documents(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 18
    return (np.frombuffer(raw[: 8 * n], np.int64), np.frombuffer(raw[8 * n: 16 * n], np.int64),
            np.frombuffer(raw[16 * n: 17 * n], np.uint8) > 0, np.frombuffer(raw[17 * n:], np.uint8) > 0)


class _Grams:
    """Distinct n-grams of a block, level by level, in the order in which the shards hold them."""

    def __init__(self, row: dict):
        words, sequence = np.frombuffer(row["a"], np.uint64), unpacked(row["c"], np.uint32)
        _, self.lengths, _, self.learns = _documents(row["d"])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        order = np.argsort(words)
        self.words = words[order]
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        self.token = place[sequence]
        self.level, self.number, self.longer = 1, self.token, self.words

    def next(self, bits: int, shared: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """The n-grams of the next level. ``shared``: contexts whose followers are spread over several shards, by rising
        name, with their counts and numbers of shards."""
        self.level += 1
        before = np.empty(len(self.token), dtype=np.int64)
        before[1:] = self.number[:-1] + 1
        before[self.starts] = 0
        key, self.number = np.unique(before * len(self.words) + self.token, return_inverse=True)
        contexts = np.concatenate((np.array([start_of(self.level)], dtype=np.uint64), self.longer))
        name, child = contexts[key // len(self.words)], child_bits(self.words[key % len(self.words)])
        del before, key, contexts
        self.longer = extended(name, child)
        shard = (name >> np.uint64(64 - bits)).astype(np.int64)
        hot, _, spread = shared
        order = np.argsort(name, kind="stable")
        if len(hot):
            at = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
            shift = ((child * spread[at]) >> np.uint64(CHILD_BITS)).astype(np.int64)
            shard = np.where(hot[at] == name, (shard + shift) & ((1 << bits) - 1), shard)
            order = order[np.argsort(shard[order], kind="stable")]
        self.sorted, self.name, self.child, self.shard = order, name[order], child[order], shard[order]
        self.cuts = np.flatnonzero(np.diff(self.shard, prepend=-1)).tolist() + [len(self.shard)]

    def slices(self) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(shard, low, high, first of each context, followers of each context)."""
        for low, high in zip(self.cuts, self.cuts[1:]):
            first = np.flatnonzero(np.concatenate(([True], self.name[low + 1: high] != self.name[low: high - 1])))
            yield int(self.shard[low]), low, high, first, np.diff(np.append(first, high - low))

    def learned(self) -> np.ndarray:
        """How often each n-gram of the level stands in rows that are learned from."""
        return np.bincount(self.number[np.repeat(self.learns, self.lengths)], minlength=len(self.sorted)).astype(np.uint32)[self.sorted]


def _rising(x: np.ndarray) -> bytes:
    """Rising numbers as packed differences."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def _risen(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


def _tables(rows: Iterator[dict], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about 16 MB of rows with blobs."""
    target, held, size = pa.schema(schema), [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size > 16 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=target)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=target)


def score(df: DataFrame, key: str, text: str, train: Column, order: int = 3) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text.

    Tokens are the lower-cased words ``[^\\x20\\x09-\\x0D]+`` and one end; rows for which ``train`` holds are learned
    from. ``base_score`` is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens, ``score`` that of the
    interpolated model of n-grams up to ``order``: at each length (c - 0.75) / (count of the context) if the n-gram was
    learned, and for every n-gram the weight 0.75 * (followers of the context) / (count of the context) times the
    probability one length shorter; contexts never learned leave all to it. Texts begin with ``order - 1`` starts. A null
    or empty text is one end token. Rows are kept apart, equal ones and those with a null key included; with nothing
    learned every token has probability 1 and N is 0. Other columns are not read.

    Texts are read once, into blocks of tokens written to the shared folder. Level by level, each block sends its
    distinct n-grams with the counts learned to shards of the contexts' hash space, and gets codes back, so an n-gram
    that stands everywhere costs one entry a block. A shard builds its part of the trie from all blocks and answers them
    from the mapped file. Contexts with more than a quarter of a shard's tokens are spread over several shards; each
    level has at most four times as many as shards. Nothing else of the model is ever gathered; shards grow in number
    with the text.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    blob = [("block", pa.int64()), ("size", pa.int64()), ("tokens", pa.int64()), ("texts", pa.int64()),
            *((c, pa.binary()) for c in "abcd")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[dict]:
            for batch in batches:
                for k, t, x in zip(*(batch.column(i) for i in range(3))):
                    yield {"key": k.as_py(), "train": t.as_py(), "text": x.as_py()}

        prefix = task_row_prefix()
        yield from _tables(({"block": prefix + i} | _block(*b) for i, b in enumerate(text_batches(items(), "text", BLOCK_BYTES))), blob)

    blocks = stored(rows.mapInArrow(read, "block bigint, size bigint, tokens bigint, texts bigint, a binary, b binary, c binary, d binary"), "lm-blocks")
    total, learned, texts = blocks.agg(F.sum("size"), F.sum("tokens"), F.sum("texts")).head()
    total, learned, texts = total or 0, learned or 0, texts or 0
    bits = max(2, (total // SHARD_TOKENS).bit_length())
    shards = 1 << bits
    hot_from = learned / (4 * shards)

    asked_sql = "shard int, block bigint, a binary, b binary, c binary, d binary"
    asked = [("shard", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in "abcd")]
    answer_sql = "block bigint, kind int, shard int, types bigint, a binary, b binary, c binary, d binary"
    answer = [("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("types", pa.int64()), *((c, pa.binary()) for c in "abcd")]

    # Level one: single tokens.
    def ask_singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    words, counts = np.frombuffer(row["a"], np.uint64), unpacked(row["b"], np.uint64)
                    by_name = np.argsort(words)
                    words, counts = words[by_name], counts[by_name]
                    shard = (words >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(words)]
                    for low, high in zip(cuts, cuts[1:]):
                        yield {"shard": int(shard[low]), "block": row["block"], "a": _rising(words[low:high]), "b": packed(counts[low:high])}

        yield from _tables(items(), asked)

    def answer_singles(group):
        shard = group.column("shard")[0].as_py()
        got = [(b, _risen(a), unpacked(c, np.uint64)) for b, a, c in zip(*(group.column(n).to_pylist() for n in ("block", "a", "b")))]
        names, at = np.unique(np.concatenate([w for _, w, _ in got]), return_inverse=True)
        counts = np.zeros(len(names), dtype=np.uint64)
        np.add.at(counts, at, np.concatenate([c for _, _, c in got]))
        names, counts = names[counts > 0], counts[counts > 0]
        base = np.uint64(shard << (64 - bits))
        level, payload = EliasFano.of(names - base, 1 << (64 - bits)), np.append(counts, np.uint64(0))  # -1: not learned
        hot = counts > hot_from
        out = [{"block": b, "kind": 1, "shard": shard, "a": packed(payload[level.find(w - base)])} for b, w, _ in got]
        out.append({"block": -1, "kind": 1, "shard": shard, "types": len(names), "c": names[hot].tobytes(), "d": counts[hot].tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema(answer))

    def spread_over(reports: DataFrame, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of a level that several shards share: at most four a shard, and the start of texts."""
        found = [(r.c, r.d) for r in reports.filter("block = -1 and length(c) > 0").select("c", "d").toLocalIterator()]
        names = np.frombuffer(b"".join(bytes(c) for c, _ in found) + (np.uint64(start_of(level)).tobytes() if texts else b""), np.uint64)
        counts = np.frombuffer(b"".join(bytes(d) for _, d in found) + (np.uint64(texts).tobytes() if texts else b""), np.uint64)
        by_name = np.argsort(names)
        names, counts = names[by_name], counts[by_name]
        return names, counts, np.minimum(shards, (2.0 * counts * shards / max(learned, 1)).astype(np.int64) + 1).astype(np.uint64)

    answers = [stored(blocks.select("block", "a", "b").mapInArrow(ask_singles, asked_sql)
                      .groupBy("shard").applyInArrow(answer_singles, answer_sql), "lm-level1")]
    types = answers[0].agg(F.sum("types")).head()[0] or 0

    # Longer n-grams: each level asks with the contexts that the level before it found to be spread.
    spreads, weights = [], []
    for level in range(2, order + 1):
        spreads.append(df.sparkSession.sparkContext.broadcast(spread_over(answers[-1], level)))
        known = list(spreads)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def items() -> Iterator[dict]:
                for batch in batches:
                    for row in batch.to_pylist():
                        grams = _Grams(row)
                        for spread in known:
                            grams.next(bits, spread.value)
                        counts = grams.learned()
                        for shard, low, high, first, kids in grams.slices():
                            yield {"shard": shard, "block": row["block"], "a": _rising(grams.name[low:high][first]),
                                   "b": packed(kids.astype(np.uint32)), "c": packed(grams.child[low:high].astype(np.uint32)), "d": packed(counts[low:high])}

            yield from _tables(items(), asked)

        def answer_level(group):
            shard = group.column("shard")[0].as_py()
            got = [(b, _risen(n), unpacked(k, np.uint32).astype(np.int64), unpacked(c, np.uint32).astype(np.uint64), unpacked(d, np.uint32))
                   for b, n, k, c, d in zip(*(group.column(x).to_pylist() for x in ("block", "a", "b", "c", "d")))]
            # Equal entries of several blocks are asked for once.
            names, rank = np.unique(np.concatenate([x[1] for x in got]), return_inverse=True)
            gram = np.repeat(rank, np.concatenate([x[2] for x in got])).astype(np.uint64) << np.uint64(CHILD_BITS)
            gram |= np.concatenate([x[3] for x in got])
            gram, at = np.unique(gram, return_inverse=True)
            count = np.bincount(at, np.concatenate([x[4] for x in got]), len(gram)).astype(np.int64)
            owner, child = (gram >> np.uint64(CHILD_BITS)).astype(np.int64), gram & np.uint64((1 << CHILD_BITS) - 1)
            context, some = names[owner], count > 0
            hot, totals, _ = known[-1].value
            with tempfile.TemporaryDirectory() as folder:
                # Shared contexts come from other ranges, so the shard's names are taken over the whole hash space.
                trie = Trie(context[some], child[some], count[some], 0, 1 << 64, dict(zip(hot.tolist(), totals.tolist())), folder)
                weight, share = trie.ask(names, np.bincount(owner, minlength=len(names)), child)
                mine = np.isin(trie.names, hot)
            out, low, first = [], 0, 0
            for b, n, _, c, _ in got:
                out.append({"block": b, "kind": level, "shard": shard, "a": packed(weight[rank[low: low + len(n)]]), "b": packed(share[at[first: first + len(c)]])})
                low, first = low + len(n), first + len(c)
            often = count > hot_from
            out.append({"block": -1, "kind": level, "shard": shard, "a": trie.names[mine].tobytes(), "b": trie.kids[mine].astype(np.int64).tobytes(),
                        "c": extended(context[often], child[often]).tobytes(), "d": count[often].astype(np.uint64).tobytes()})
            return pa.Table.from_pylist(out, schema=pa.schema(answer))

        answers.append(stored(blocks.select("block", "a", "c", "d").mapInArrow(ask, asked_sql)
                              .groupBy("shard").applyInArrow(answer_level, answer_sql), f"lm-level{level}"))
        hot, totals, _ = spreads[-1].value
        followers = np.zeros(len(hot))
        for r in answers[-1].filter("block = -1 and length(a) > 0").select("a", "b").toLocalIterator():
            np.add.at(followers, np.searchsorted(hot, np.frombuffer(r.a, np.uint64)), np.frombuffer(r.b, np.int64))
        weights.append(df.sparkSession.sparkContext.broadcast(np.minimum(DISCOUNT * followers / np.maximum(totals, 1), 1.0)))
    below = learned + ADDED * (types + 1)

    def finish(group):
        kind, shard = group.column("kind").to_numpy(), group.column("shard").to_numpy()

        def rows_of(level: int) -> pa.Table:
            at = np.flatnonzero(kind == level)
            return group.take(at[np.argsort(shard[at])]).select(["a", "b", "c", "d"])

        row = rows_of(0).to_pylist()[0]
        grams = _Grams(row)
        keys, lengths, valid, learns = _documents(row["d"])
        single = np.concatenate([unpacked(r.as_py(), np.uint64) for r in rows_of(1).column("a")]).astype(np.float64)  # by rising hash
        alone = (single + ADDED) / below
        likely = alone[grams.token]
        base = np.add.reduceat(np.log10(likely), grams.starts)
        for level, (spread, hot_weight) in enumerate(zip(spreads, weights), 2):
            grams.next(bits, spread.value)
            told = rows_of(level)
            weight, share = np.empty(len(grams.sorted), dtype=np.float32), np.empty(len(grams.sorted), dtype=np.float32)
            for (_, low, high, _, kids), a, b in zip(grams.slices(), told.column("a"), told.column("b")):
                weight[low:high] = np.repeat(restored(unpacked(a.as_py(), np.uint16)), kids)
                share[low:high] = restored(unpacked(b.as_py(), np.uint16))
            hot = spread.value[0]
            if len(hot):
                at = np.minimum(np.searchsorted(hot, grams.name), len(hot) - 1)
                weight = np.where(hot[at] == grams.name, hot_weight.value[at], weight).astype(np.float32)
            back = np.empty(len(grams.sorted), dtype=np.int64)
            back[grams.sorted] = np.arange(len(back))
            at = back[grams.number]
            likely = np.where(weight[at] == 0, likely, share[at] + weight[at] * likely)
        return pa.table({
            "key": pa.array(keys, mask=~valid), "train": pa.array(learns), "n_tokens": pa.array(lengths),
            "n_known": pa.array(np.add.reduceat((single > 0)[grams.token].astype(np.int64), grams.starts)),
            "train_tokens": pa.array(np.full(len(keys), learned, dtype=np.int64)),
            "base_score": pa.array(base), "score": pa.array(np.add.reduceat(np.log10(likely), grams.starts)),
        })

    met = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("types"), "a", "b", "c", "d")
    for told in answers:
        met = met.union(told.filter("block >= 0"))
    return met.groupBy("block").applyInArrow(
        finish, "key bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    ).withColumnRenamed("key", key)
