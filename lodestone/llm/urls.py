"""URL filters: rules on hosts and path prefixes, found by hashed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import at_most, broadcast_if
from .shared import lower_ascii

# Hexadecimal digits of the digest by which expressions and rules are joined; the full digest confirms.
PREFIX_DIGITS = 8
# Rules are broadcast if there are at most this many; else both sides are shuffled by hash prefix.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it: ``a.b.c``, ``b.c``, ``c``."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_DIGITS), 16, 10).cast("bigint")


def judge(pages: DataFrame, key: str, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of each page.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains if the path starts with its path; the
    longest rule (host and path together, then host) wins, and of equal rules with different verdicts ``block``. Pages
    without a rule get ``default``, as do null addresses and those without ``://`` (empty host and path). Rules with a
    null part are left out. Equal rows are judged once and come back as often as they were; other columns are not read.

    Each address is expanded into its host suffixes and its path prefixes (of the lengths that the rules have), each
    such expression is joined on a short hash prefix alone, and the full SHA-256 digest decides within the aggregate. Pages are shuffled once, by
    their own key; nothing of one host is ever gathered in one task.
    """
    listed = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna()
        .groupBy("host", "path").agg(F.max_by("verdict", F.col("verdict") == "block").alias("rule_verdict"))
        .withColumn("rule", F.concat("host", "path")).withColumn("digest", F.sha2(F.concat_ws("\n", "host", "path"), 256))
        .select(_short(F.col("digest")).alias("prefix"), "digest",
                F.struct(F.char_length("rule").alias("n"), F.char_length("host").alias("h"), "rule", "rule_verdict").alias("listed"))
    )
    # One small number for each distinct length of a rule's path; no more than the longest path has characters.
    lengths = [n for (n,) in rules.select(F.char_length("path")).dropna().distinct().collect()]
    once = pages.groupBy(F.col(key).alias("key"), F.col(url).alias("url")).agg(F.count("*").alias("copies"))
    parts = once.select("key", "copies", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.char_length("path")),
        lambda n: F.col("path").substr(F.lit(1), n),
    )
    digests = F.flatten(F.transform(
        host_suffixes(F.col("host")),
        lambda h: F.transform(F.col("prefixes"), lambda p: F.sha2(F.concat_ws("\n", h, p), 256)),
    ))
    asked = (
        parts.withColumn("prefixes", prefixes)
        .select("key", "copies", "url", "host", "path", F.explode_outer(digests).alias("asked"))
        .withColumn("asked_prefix", _short(F.col("asked")))
    )
    # The short prefix alone is the key; an expression may meet several rules by it, and the digest tells which is meant.
    found = asked.join(
        broadcast_if(listed, at_most(listed, BROADCAST_RULES)), F.col("asked_prefix") == F.col("prefix"), "left"
    )
    best = found.groupBy("key", "url").agg(
        F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("asked") == F.col("digest"), F.col("listed"))).alias("won"),
    )
    return best.select(
        F.col("key").alias(key), "host", "path", F.col("won.rule").alias("rule"),
        F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy"),
    ).drop("_copy")
