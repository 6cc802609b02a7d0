"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import at_most, broadcast_if
from ..session import stored

# Hexadecimal digits of the row's hash: all of them, and those of the two histograms' buckets.
HASH_DIGITS, FIRST_DIGITS, SECOND_DIGITS = 15, 3, 4
BROADCAST_SOURCES = 100_000
MAX_REPEATS = 3


def row_hash(key: Column) -> Column:
    """Even 60-bit hash of a key, equal on every run and in other SQL engines."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_DIGITS), 16, 10).cast("bigint")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: list[float], repeats: int) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row per source.

    Sources in order of code points, null last, weigh ``weights`` in turn. They share the sum of all sizes by weight;
    none gets more than ``repeats`` times its size, and what is over goes to the others by weight. The common level is
    found from running sums over the sources by the share at which each is full.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")
    weighed = sizes.select(
        "source", "source_size", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn).alias("w"),
        (F.col("source_size") * repeats).cast("double").alias("cap"),
    )
    full_first = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(W.unboundedPreceding, -1)
    after = full_first.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    levels = weighed.withColumn("open", F.sum("w").over(after)).withColumn(
        "left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    )
    # Sources that are full at their share come first; the first one that is not sets the level of all after it.
    first_open = F.min(F.when(
        F.col("cap") * F.col("open") > F.col("left") * F.col("w"),
        F.struct((F.col("cap") / F.col("w")).alias("at"), (F.col("left") / F.col("open")).alias("level")),
    )).over(everything)
    held = levels.withColumn("level", first_open["level"])
    return held.select("source", "source_size", F.least(F.col("level") * F.col("w"), "cap").alias("target"))


def _boundary(buckets: DataFrame, budget: DataFrame, small: bool) -> DataFrame:
    """For (source, bucket, n) and (source, rest): the bucket in which the running sum passes ``rest``.

    (source, bucket, n, rest): ``rest`` is what remains of the budget when the bucket begins. Buckets are bounded by the
    histogram's digits, however many rows a source has.
    """
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    run = buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    joined = run.join(broadcast_if(budget, small).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return joined.filter("before <= rest and rest < before + n").select(
        "source", "bucket", "n", (F.col("rest") - F.col("before")).alias("rest")
    )


def _sized(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"),
                     row_hash(F.col(key)).alias("hash"))


def limits(rows: DataFrame, weights: list[float], repeats: int) -> DataFrame:
    """(of, source_size, target, whole, limit) for each source of (source, size, hash), ready to be joined.

    Every row is taken ``whole`` times, and once more if its hash is below ``limit``. Sums by source and hash bucket
    give the bucket in which the budget ends, a second histogram refines that bucket alone, and single hashes decide
    only within what is left of it: about one row in 16^7. Nothing is sorted but buckets, and sums are combined before
    the shuffle, so a source with a third of all rows is no more work than another.
    """
    first = F.shiftright("hash", 4 * (HASH_DIGITS - FIRST_DIGITS))
    second = F.shiftright("hash", 4 * (HASH_DIGITS - FIRST_DIGITS - SECOND_DIGITS))
    top = stored(rows.groupBy("source", first.alias("bucket")).agg(F.sum("size").alias("n")), "mix-buckets")
    plan = stored(targets(top.groupBy("source").agg(F.sum("n").alias("source_size")), weights, repeats), "mix-targets")
    small = at_most(plan, BROADCAST_SOURCES)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = plan.select("source", (F.col("target") - whole * F.col("source_size")).alias("rest"))

    def inside(edges: DataFrame, bucket: Column, finer: Column) -> DataFrame:
        """Sums by ``finer`` of the rows within each source's bucket."""
        cut = broadcast_if(edges.select(F.col("source").alias("of"), F.col("bucket").alias("within")), small)
        held = rows.join(cut, F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("within")))
        return held.groupBy("source", finer.alias("bucket")).agg(F.sum("size").alias("n"))

    at_first = stored(_boundary(top, budget, small), "mix-first")
    at_second = stored(_boundary(inside(at_first, first, second), at_first.select("source", "rest"), small), "mix-second")
    at_hash = _boundary(inside(at_second, second, F.col("hash")), at_second.select("source", "rest"), small)
    # The hash that passes the budget is in if more than half of it lies below.
    edge = at_hash.select(
        F.col("source").alias("of"), (F.col("bucket") + F.when(F.col("rest") * 2 > F.col("n"), 1).otherwise(0)).alias("limit")
    )
    decided = plan.join(broadcast_if(edge, small), F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("of"), "source_size", "target", whole.alias("whole"), F.coalesce("limit", F.lit(0)).alias("limit")
    )
    return broadcast_if(stored(decided, "mix-limits"), small)


def _times(hashed: Column) -> Column:
    return F.col("whole") + F.when(hashed < F.col("limit"), 1).otherwise(0)


def mix(df: DataFrame, key: str, text: str, source: str, weights: list[float], repeats: int = MAX_REPEATS) -> DataFrame:
    """(key, source, size, source_size, target, taken) of each row.

    ``size`` is the number of white-space separated words (null: 0). A source whose target is k whole times its size
    and a rest takes each row k times, and once more the rows of smallest hash until the rest is filled; the row that
    meets the limit is taken if that comes closer to it (not at a tie). So ``taken`` is at most ``repeats`` times
    ``size``, larger targets take supersets, and a rerun decides alike. Rows of one key share a hash and so a decision,
    repeated rows included; null keys count as one. A null source is a source. An empty table gives no rows. Other
    columns are not read.
    """
    rows = stored(_sized(df, key, text, source), "mix-sizes")
    decided = limits(rows, weights, repeats)
    return rows.join(decided, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        (F.col("size") * _times(F.col("hash"))).alias("taken"),
    )


def draw(df: DataFrame, key: str, text: str, source: str, weights: list[float], repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``df`` as the mix takes them: each as often as ``mix`` decides, with all its columns.

    Texts are not shuffled; only their sizes are summed.
    """
    decided = limits(stored(_sized(df, key, text, source), "mix-sizes"), weights, repeats)
    decided = decided.select(*(F.col(c).alias(f"_mix_{c}") for c in ("of", "whole", "limit")))
    times = F.col("_mix_whole") + F.when(row_hash(F.col(key)) < F.col("_mix_limit"), 1).otherwise(0)
    taken = df.join(decided, F.col(source).eqNullSafe(F.col("_mix_of"))).withColumn("_mix_times", times.cast("int"))
    copies = F.explode(F.array_repeat(F.lit(True), F.col("_mix_times")))
    return taken.withColumn("_mix_copy", copies).select(*(F.col(f"`{c}`") for c in df.columns))
