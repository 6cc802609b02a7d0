"""Ranked lexical search: bundles of items carry sparse accumulators of documents from one owner of terms to the next."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import top_k
from ..session import stored, work_path
from .shared import task_row_prefix

# Term characters are digits, letters and everything beyond ASCII; A-Z are lower-cased.
SPLIT = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
# Items are answered in rounds whose texts hold about this many bytes, so what a round sends to the tasks is bounded.
ROUND_BYTES = 4 << 20
# Items of a bundle and documents of a block: a task holds a score for each pair of one bundle and one block.
BUNDLE = 256
BLOCK = 4_096
OWNERS = 4


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(SPLIT).split()


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after the other, and the length of each list."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), lengths


def _postings(docs: DataFrame, key: str, text: str, wanted: list[bytes]) -> DataFrame:
    """(row, doc, n, terms, tfs) of the documents that hold any term: their length and their occurrences of ``wanted``."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(sent.value)}
        row = task_row_prefix()
        for batch in batches:
            rows, keep, sizes, ids, tfs = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                words = terms_of(_raw(t.as_py()))
                row += 1
                if not words:
                    continue
                found = Counter(filter(number.__contains__, words))
                rows.append(row)
                keep.append(i)
                sizes.append(len(words))
                ids.append(np.fromiter((number[w] for w in found), np.int32, len(found)))
                tfs.append(np.fromiter(found.values(), np.int64, len(found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                 _lists(ids, pa.int32()), _lists(tfs, pa.int64())], names=["row", "doc", "n", "terms", "tfs"])

    base = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return base.mapInArrow(count, "row bigint, doc bigint, n bigint, terms array<int>, tfs array<bigint>")


def _with_factors(postings: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``postings`` with what each occurrence counts for before it is multiplied with the weight of its term."""
    return postings.withColumn("_m", F.expr(f"10L + (90L * n * {n_docs}L) div {n_terms}L")).select(
        "row", "doc", "terms", F.expr("transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 8L * _m))").alias("factors"))


def _best_possible(factors: DataFrame) -> DataFrame:
    """(term, df, most): documents that hold the term, and the largest factor it has in any of them."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (term, _), (factor, _) = _flat(batch.column(0)), _flat(batch.column(1))
            order = np.lexsort((factor, term))
            term, factor = term[order], factor[order]
            last = np.flatnonzero(np.diff(term, append=-1)) if len(term) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(term[last], pa.int32()), pa.array(np.diff(last, prepend=-1), pa.int64()), pa.array(factor[last], pa.int64())],
                names=["term", "df", "most"])

    return factors.select("terms", "factors").mapInArrow(sums, "term int, df bigint, most bigint").groupBy("term").agg(
        F.sum("df").alias("df"), F.max("most").alias("most"))


def _owned(factors: DataFrame, owner: np.ndarray, owners: int, blocks: int) -> DataFrame:
    """(owner, block, row, doc, terms, factors): each document's occurrences of the terms of each owner, written by owner."""
    spark = factors.sparkSession
    sent = spark.sparkContext.broadcast(owner)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (term, lengths), (factor, _) = _flat(batch.column("terms")), _flat(batch.column("factors"))
            at, by = np.repeat(np.arange(batch.num_rows), lengths), sent.value[term]
            for o in range(owners):
                mine = np.flatnonzero(by == o)
                if not len(mine):
                    continue
                docs, counts = np.unique(at[mine], return_counts=True)
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), o), pa.int32()), *(batch.column(c).take(pa.array(docs)) for c in ("block", "row", "doc")),
                     pa.ListArray.from_arrays(ends, pa.array(term[mine], pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(factor[mine], pa.int32()))],
                    names=["owner", "block", "row", "doc", "terms", "factors"])

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    kind = "owner int, block int, row bigint, doc bigint, terms array<int>, factors array<int>"
    path = work_path(spark, "lexical-owned")
    factors.filter("doc is not null").select(block, "row", "doc", "terms", "factors").mapInArrow(deal, kind).write.partitionBy(
        "owner").parquet(path)
    return spark.read.schema(kind).parquet(path)


BUNDLE_KIND = ("bundle int, block int, item array<int>, term array<int>, weight array<bigint>, bound array<bigint>, "
               "owner array<int>, least array<bigint>, of_item array<int>, row array<bigint>, doc array<bigint>, score array<bigint>")
FOUND_KIND = "bundle int, item int, doc bigint, score bigint"
CARRIED = [part.split()[0] for part in BUNDLE_KIND.split(", ")]


def _visit(owner: int, last: bool, k: int):
    """What an owner does with the bundle of one block: add its terms' contributions, then drop what cannot win any more.

    A document whose score and the most that all later terms could add is below the k-th best score of an item cannot
    be among the item's k best; if the terms that are left could not lift a new document to that score, none is added.
    """
    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        one = {c: left.column(c)[0] for c in CARRIED}
        get = lambda c: np.array(one[c].values.to_numpy(zero_copy_only=False))
        item, term, weight, bound, by, least = (get(c) for c in ("item", "term", "weight", "bound", "owner", "least"))
        n = len(least)
        ahead = np.bincount(item[by >= owner], weights=bound[by >= owner], minlength=n)
        after = np.bincount(item[by > owner], weights=bound[by > owner], minlength=n)
        of_item, rows, docs, scores = (get(c) for c in ("of_item", "row", "doc", "score"))
        (terms, lengths), (factors, _) = _flat(right.column("terms")), _flat(right.column("factors"))
        new_rows, new_docs = right.column("row").to_numpy(), right.column("doc").to_numpy()
        held, first, place = np.unique(np.concatenate((rows, new_rows)), return_index=True, return_inverse=True)
        names = np.concatenate((docs, new_docs))[first]
        total = np.zeros((n, len(held)), np.int64)
        alive = np.zeros((n, len(held)), bool)
        total[of_item, place[: len(rows)]] = scores
        alive[of_item, place[: len(rows)]] = True
        may_add = ahead >= np.maximum(least, 1)

        at = np.repeat(place[len(rows):], lengths)
        order = np.argsort(terms, kind="stable")
        terms, factors, at = terms[order], factors[order].astype(np.int64), at[order]
        asked = np.flatnonzero(by == owner)
        asked = asked[np.argsort(term[asked], kind="stable")]
        cuts = np.flatnonzero(np.diff(term[asked], prepend=-1))
        for group in np.split(asked, cuts[1:]) if len(asked) else []:
            low, high = np.searchsorted(terms, term[group[0]]), np.searchsorted(terms, term[group[0]], side="right")
            if low == high:
                continue
            where = np.ix_(item[group], at[low:high])
            total[where] += weight[group][:, None] * factors[low:high][None, :]
            alive[where] |= may_add[item[group]][:, None]

        best = []
        for i in range(n):
            at = np.flatnonzero(alive[i])
            mine = total[i, at]
            if len(mine) > k:
                least[i] = max(least[i], np.partition(mine, len(mine) - k)[len(mine) - k])
            stay = at[mine + after[i] >= max(least[i], 1)]
            if last:
                stay = stay[np.lexsort((names[stay], -total[i, stay]))[:k]]
            best.append(stay)
        of_item, at = np.repeat(np.arange(n, dtype=np.int32), [len(b) for b in best]), np.concatenate(best).astype(np.int64) if best else np.zeros(0, np.int64)
        rows, docs, scores = held[at], names[at], total[of_item, at]
        if last:
            return pa.table({"bundle": pa.array(np.full(len(at), one["bundle"].as_py()), pa.int32()), "item": of_item,
                             "doc": docs, "score": scores})
        wrap = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        out = [left.column(c).combine_chunks() for c in CARRIED[:7]] + [
            wrap(least, pa.int64()), wrap(of_item, pa.int32()), *(wrap(x, pa.int64()) for x in (rows, docs, scores))]
        return pa.Table.from_arrays(out, names=CARRIED)

    return visit


def _round(terms: DataFrame, docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Results of the items whose (item, term) pairs are given; they are few enough for the driver."""
    spark = docs.sparkSession
    pairs = terms.toArrow()
    wanted, number = np.unique(np.array(pairs.column("term").to_pylist(), dtype=object), return_inverse=True)
    postings = stored(_postings(docs, key, text, [t.encode("utf-8", "surrogatepass") for t in wanted]), "lexical-postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    nothing = spark.createDataFrame([], f"item_id {terms.schema['item_id'].dataType.simpleString()}, doc_id bigint, score bigint")
    if not n_docs or not len(wanted):
        return nothing
    factors = _with_factors(postings, n_docs, n_terms)
    df, most = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    for r in _best_possible(factors).collect():
        df[r.term], most[r.term] = r.df, r.most
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)

    # Rare terms first: they settle most items before frequent ones come. Each owner has about as many occurrences.
    order = np.argsort(df, kind="stable")
    owner = np.zeros(len(wanted), np.int32)
    owner[order] = np.minimum(OWNERS - 1, (np.cumsum(df[order]) - df[order]) * OWNERS // max(1, df.sum()))
    blocks = -(-n_docs // BLOCK)
    owned = _owned(factors, owner, OWNERS, blocks)

    ids = pairs.column("item_id").to_pylist()
    held = {x: i for i, x in enumerate(dict.fromkeys(ids))}
    item = np.array([held[x] for x in ids])
    bundles = []
    for b in range(-(-len(held) // BUNDLE)):
        mine = np.flatnonzero(item // BUNDLE == b)
        t = number[mine]
        bundles.append((b, (item[mine] % BUNDLE).tolist(), t.tolist(), weight[t].tolist(), (weight[t] * most[t]).tolist(), owner[t].tolist(),
                        [0] * min(BUNDLE, len(held) - b * BUNDLE), [], [], [], []))
    kind = T.StructType([f for f in T.StructType.fromDDL(BUNDLE_KIND) if f.name != "block"])
    carried = spark.createDataFrame(bundles, kind).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*CARRIED)
    for o in range(OWNERS):
        mine = owned.filter(F.col("owner") == o).select(
            F.explode(F.sequence(F.lit(0), F.lit(len(bundles) - 1))).alias("bundle"), "block", "row", "doc", "terms", "factors")
        last = o == OWNERS - 1
        carried = carried.groupBy("bundle", "block").cogroup(mine.groupBy("bundle", "block")).applyInArrow(
            _visit(o, last, k), FOUND_KIND if last else BUNDLE_KIND)
    named = spark.createDataFrame([(i // BUNDLE, i % BUNDLE, x) for x, i in held.items()],
                                  f"bundle int, item int, item_id {terms.schema['item_id'].dataType.simpleString()}")
    return carried.join(F.broadcast(named), ["bundle", "item"]).select("item_id", F.col("doc").alias("doc_id"), "score")


def search(items: DataFrame, item_key: str, item_text: str, docs: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item, ties by ``key``.

    Terms are maximal runs of digits, letters and characters beyond ASCII in the whole text, with A-Z lower-cased. A term's
    weight is floor(1000 * ln((2 N + 2) / (2 df + 1))); a document of n terms scores, summed over the item's distinct
    terms, weight * ((10^9 tf) div (1000 tf + 8 m)) with m = 10 + (90 n N) div L. N counts the documents with a term, L
    all their terms, df the documents that hold the term, tf its occurrences in the document.

    The terms of the items are dealt to ``OWNERS``, rare ones first. Documents are cut by hash into blocks; a bundle of
    items travels through the owners by cogroup, once per block, with the scores of the documents that can still win.
    Nothing but integers is added, in any order, so results are equal on every run. Dropping is exact: only documents
    that cannot be among the ``k`` best any more go. Only the items' own terms are broadcast, in rounds of bounded size;
    documents move once, as counts of those terms.

    An item without text, without terms or without an id gets no rows. Rows that share an item id are one item with the
    terms of all. A document without text or terms counts for nothing; one without an id counts in N, L and df but is not
    returned; rows that share an id are documents of their own, and each may be returned. ``key`` must be integer. Other
    columns are not read.
    """
    words = F.regexp_extract_all(F.col(item_text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    lower = F.translate(F.col("term"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.filter(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item_id"), F.explode(words).alias("term"))
    terms = stored(terms.select("item_id", lower.alias("term")).distinct(), "lexical-items")
    size = terms.agg(F.sum(F.octet_length("term") + 16)).head()[0] or 0
    rounds = max(1, -(-size // ROUND_BYTES))
    found = None
    for i in range(rounds):
        mine = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == i)
        part = _round(mine, docs, key, text, k)
        found = part if found is None else found.union(part)
    ranked = top_k(found, ["item_id"], [F.desc("score"), F.asc("doc_id")], k)
    return ranked.select("item_id", "rank", "doc_id", "score")
