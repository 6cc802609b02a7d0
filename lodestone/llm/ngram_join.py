"""N-gram Jaccard join: documents linked by the overlap of their word n-grams, joined through prefix trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import at_most, broadcast_if
from ..session import stored
from .shared import components, hashed_words, map_rows, mix64, text_batches

# Chance that the blocks miss a pair exactly at the threshold; it falls quickly above it.
MISS = 1e-9
# Members of one block that meet in one task; larger blocks are cut, and all pairs of cuts are joined.
CUT = 1_500
BROADCAST_ROWS = 200_000


def ngram_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-grams of words as sorted 64-bit hashes; a shorter text is one n-gram, none is empty."""
    words, counts = hashed_words(texts)
    factors = mix64(np.arange(101, 101 + n, dtype=np.uint64)) | np.uint64(1)
    grams = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for i in range(n):
        grams += words[i: i + len(grams)] * factors[i]
    grams = mix64(grams)
    at = 0
    for count in counts:
        if count >= n:
            yield np.unique(grams[at: at + count - n + 1])
        elif count:
            whole = words[at: at + count] * factors[:count]
            yield mix64(np.array([whole.sum(dtype=np.uint64) + np.uint64(count)]))
        else:
            yield np.zeros(0, dtype=np.uint64)
        at += count


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): enough bands that a pair at the threshold shares one, but with probability ``MISS``."""
    rows = max(1, round(math.log(0.4) / math.log(threshold))) if threshold < 1 else 8
    share = min(threshold**rows, 1 - 1e-12)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - share))), rows


def bands(grams: np.ndarray, count: int, rows: int) -> np.ndarray:
    """A hash for each band of minimum hashes of the set."""
    factors = mix64(np.arange(1, count * rows + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(count * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), 2_048):
        np.minimum(least, (factors[:, None] * grams[None, i: i + 2_048]).min(axis=1), out=least)
    mixed = mix64(least.reshape(count, rows) * (mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)))
    return mix64(mixed.sum(axis=1, dtype=np.uint64) + np.arange(count, dtype=np.uint64)).view(np.int64)


def similar(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


class PrefixTree:
    """Sets in one global order (by hash), as a tree of shared prefixes with a run of elements at each node."""

    __slots__ = ("segment", "low", "high", "least", "most", "children", "ends")

    def __init__(self, sets: list[np.ndarray]):
        """``sets`` sorted by their elements. Node ranges [low, high) refer to their positions."""
        todo = [(self, 0, len(sets), 0)]
        while todo:
            node, low, high, depth = todo.pop()
            first, last = sets[low], sets[high - 1]
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:n] != last[depth:n])
            common = depth + int(differ[0]) if len(differ) else n
            node.segment, node.low, node.high = first[depth:common], low, high
            sizes = [len(s) for s in sets[low:high]]
            node.least, node.most = min(sizes), max(sizes)
            node.children, node.ends = [], low
            while node.ends < high and len(sets[node.ends]) == common:
                node.ends += 1
            i = node.ends
            while i < high:
                head, j = sets[i][common], i + 1
                while j < high and sets[j][common] == head:
                    j += 1
                child = PrefixTree.__new__(PrefixTree)
                node.children.append(child)
                todo.append((child, i, j, common))
                i = j

    def partners(self, probe: np.ndarray, percent: int, after: int, skip) -> Iterator[int]:
        """Positions past ``after`` of the sets similar to ``probe``; nodes for which ``skip`` holds are left out.

        The overlap with a prefix is found once for all sets that share it. A subtree ends where even all remaining
        elements could not reach the overlap that its smallest set needs.
        """
        m = len(probe)
        todo = [(self, 0, 0, 0)]
        while todo:
            node, depth, seen, both = todo.pop()
            if node.high <= after or 100 * node.most < percent * m or percent * node.least > 100 * m or skip(node):
                continue
            needed = percent * (node.least + m)
            alive = True
            for i in range(0, len(node.segment), 48):
                run = node.segment[i: i + 48]
                at = np.searchsorted(probe, run)
                both += int(np.count_nonzero(probe[np.minimum(at, m - 1)] == run))
                seen = int(at[-1]) + int(at[-1] < m and probe[at[-1]] == run[-1])
                depth += len(run)
                if (both + min(node.most - depth, m - seen)) * (100 + percent) < needed:
                    alive = False
                    break
            if not alive:
                continue
            if similar(both, depth, m, percent):
                yield from range(max(node.low, after), node.ends)
            todo.extend((child, depth, seen, both) for child in node.children)


def links(left: dict[int, np.ndarray], right: dict[int, np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets, enough to connect all that similarity connects within the block.

    With ``right`` only pairs between the two sides are looked for. Pairs that are connected already are not compared.
    """
    held = sorted((right or left).items(), key=lambda x: x[1].astype(">u8").tobytes())
    names, sets = [k for k, _ in held], [s for _, s in held]
    tree = PrefixTree(sets)
    place = {k: i for i, k in enumerate(names)}
    probes = [(place[k], k, s) for k, s in held] if right is None else []
    label = np.arange(len(names) + (len(left) if right is not None else 0))
    if right is not None:
        probes = [(len(names) + i, k, s) for i, (k, s) in enumerate(left.items())]
    found = []
    for i, name, probe in probes:
        def skip(node, i=i):
            mine = label[i]
            return (label[node.low: node.high] == mine).all() if node.high - node.low < 64 else False

        for j in tree.partners(probe, percent, i + 1 if right is None else 0, skip):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((name, names[j]))
    return found


def join(df: DataFrame, key: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of each row: components of documents linked by n-gram overlap.

    A document's set is its distinct ``words``-grams of lower-cased words ``[^\\x20\\x09-\\x0D]+``; with fewer words the
    whole sequence is one n-gram; a null, empty or blank text has none and links with nothing. Two documents link if
    100 * intersection >= ``percent`` * union. ``component_id`` is the smallest key reachable. Rows with one key count
    as one document (their texts hang together); rows without a key link with nothing and have no component. Other
    columns are not read.

    Equal sets collapse first by a 128-bit digest, so copies cost nothing further. Different sets are brought into
    blocks by bands of minimum hashes, each a key that is combined before the shuffle, and blocks that overlap are put
    together. Each block is joined exactly through a prefix tree. A block too large for one task is first compared with
    one of its members, which connects most of a family of near copies, and the rest is joined with it in cuts. Only
    sets that share a block are read again; no list of all pairs is ever made.
    """
    count, rows = banding(percent / 100)
    base = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def sign(items: Iterator[dict]) -> Iterator[dict]:
        for held, texts in text_batches(items, "text"):
            for r, grams in zip(held, ngram_sets(texts, words)):
                d1, d2 = np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), dtype=np.int64)
                marks = bands(grams, count, rows) if len(grams) else grams
                yield {"key": r["key"], "n": len(grams), "d1": int(d1), "d2": int(d2), "bands": marks}

    sets = stored(map_rows(base, sign, "key bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"), "join-sets")
    known = sets.filter("n > 0 and key is not null")
    classes = known.groupBy("d1", "d2").agg(F.min("key").alias("rep"), F.count("*").alias("members"), F.max("n").alias("size"))
    shared = stored(classes.filter("members > 1").select("d1", "d2", "rep"), "join-copies")
    small = at_most(shared, BROADCAST_ROWS)
    placed = known.join(broadcast_if(shared, small), ["d1", "d2"], "left").withColumn("rep", F.coalesce("rep", "key"))
    one_each = placed.filter("rep = key")

    posted = one_each.select("rep", F.posexplode("bands").alias("band", "mark")).select("rep", F.xxhash64("band", "mark").alias("mark"))
    met = posted.groupBy("mark").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    near = posted.join(met.select("mark", "least"), "mark").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    blocks = stored(components(near, "join-blocks"), "join-blocks")

    # The sets of block members, read again from their texts.
    member = stored(one_each.join(blocks, F.col("rep") == F.col("node")).select(
        "key", "d1", "d2", "n", F.col("component").alias("block")).distinct(), "join-members")
    few = at_most(member, BROADCAST_ROWS)
    again = base.join(broadcast_if(member, few), "key")

    def read(items: Iterator[dict]) -> Iterator[dict]:
        for held, texts in text_batches(items, "text"):
            for r, grams in zip(held, ngram_sets(texts, words)):
                digest = np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), dtype=np.int64)
                if (digest == (r["d1"], r["d2"])).all():
                    yield {"block": r["block"], "key": r["key"], "d1": r["d1"], "d2": r["d2"], "grams": grams.tobytes()}

    # A key may have several sets; equal rows of one key are one.
    read_again = map_rows(again, read, "block bigint, key bigint, d1 bigint, d2 bigint, grams binary")
    grams = stored(read_again, "join-grams")
    sizes = stored(member.groupBy("block").agg(F.count("*").alias("n"), F.max_by("key", F.struct("n", "key")).alias("pivot")), "join-sizes")
    large = sizes.filter(F.col("n") > CUT)
    edges = _joined(grams.join(broadcast_if(sizes.filter(F.col("n") <= CUT).select("block"), few), "block", "left_semi").select(
        "block", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "key", "d1", "grams"), percent)
    if not large.isEmpty():
        edges = edges.union(_large(grams, large, percent, few))

    # Rows of one key with different sets hang together.
    doubled = placed.select("key", "rep").groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).filter("a <> b")
    several = placed.select("key", "rep").join(doubled.select("key", "b"), "key").filter("rep <> b").select(F.col("rep").alias("a"), "b")
    found = stored(components(stored(edges.union(several), "join-links"), "join-links"), "join-found")
    few_found = at_most(found, BROADCAST_ROWS)
    ids = sets.select("key", "n", "d1", "d2").join(broadcast_if(shared, small), ["d1", "d2"], "left")
    ids = ids.withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "key")).otherwise(F.col("key")))
    return ids.join(broadcast_if(found, few_found), (F.col("rep") == F.col("node")) & (F.col("n") > 0), "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNotNull(), F.coalesce("component", "rep")).alias("component_id"),
    )


def _joined(parts: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of each (block, i, j): within the part if all its rows are on side 0, else between the sides."""

    def run(group):
        import pyarrow as pa

        keys, digests, sides, raw = (group.column(c).to_pylist() for c in ("key", "d1", "side", "grams"))
        sides_of: list[dict[tuple[int, int], np.ndarray]] = [{}, {}]
        for k, d, s, g in zip(keys, digests, sides, raw):
            sides_of[s][k, d] = np.frombuffer(g, dtype=np.uint64)
        two = max(sides) > 0
        found = links(sides_of[0], sides_of[1] if two else None, percent) if sides_of[0] else []
        found = [(a[0], b[0]) for a, b in found if a[0] != b[0]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return parts.groupBy("block", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _large(grams: DataFrame, large: DataFrame, percent: int, few: bool) -> DataFrame:
    """Links of the large blocks: every member with the block's largest, then the unlinked in cuts with all cuts."""
    inside = grams.join(broadcast_if(large.select("block", "n", "pivot"), few), "block")
    pivots = inside.filter("key = pivot").select("block", F.col("grams").alias("pivot_grams")).dropDuplicates(["block"])

    def compare(items: Iterator[dict]) -> Iterator[dict]:
        for r in items:
            a, b = np.frombuffer(r["grams"], dtype=np.uint64), np.frombuffer(r["pivot_grams"], dtype=np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            near = similar(both, len(a), len(b), percent)
            yield {"block": r["block"], "key": r["key"], "d1": r["d1"], "pivot": r["pivot"], "near": near}

    compared = stored(map_rows(inside.join(broadcast_if(pivots, at_most(pivots, 1_000)), "block"), compare,
                               "block bigint, key bigint, d1 bigint, pivot bigint, near boolean"), "join-pivots")
    direct = compared.filter("near and key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    cuts = F.ceil(F.col("n") / CUT).cast("int")
    rows = inside.select("block", "key", "d1", "grams", cuts.alias("cuts"), F.pmod(F.xxhash64("key"), cuts).cast("int").alias("cut")).join(
        broadcast_if(compared.select("block", "key", "d1", "near").distinct(), few), ["block", "key", "d1"])
    # The far ones meet every cut of the block; far cuts with each other in one order only.
    far = rows.filter("not near")
    within = far.select("block", F.col("cut").alias("i"), F.col("cut").alias("j"), F.lit(0).alias("side"), "key", "d1", "grams")
    as_left = far.select("block", F.col("cut").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cuts") * 2 - 1)).alias("j"),
                         F.lit(0).alias("side"), "key", "d1", "grams", "cuts").filter("j >= cuts or j > i").drop("cuts")
    # Cut j of the far ones is number j, cut j of the near ones is number cuts + j.
    whole = rows.withColumn("j", F.col("cut") + F.when(F.col("near"), F.col("cuts")).otherwise(0))
    as_right = whole.select("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("i"), "j", F.lit(1).alias("side"),
                            "key", "d1", "grams", "cuts").filter("j >= cuts or j > i").drop("cuts")
    return direct.union(_joined(within.union(as_left).union(as_right), percent))
