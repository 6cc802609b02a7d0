"""Sitemaps and files that a crawl has fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import stored

ENTRY = "loc STRING, lastmod STRING"


def _locations(spark: SparkSession, paths: str | list[str], row: str) -> DataFrame:
    entries = spark.read.format("xml").option("rowTag", row).schema(ENTRY).load(paths)
    return entries.filter(F.col("loc").isNotNull()).withColumn("loc", strip("loc"))


def read_urls(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(loc, lastmod) of every page entry of sitemap files, plain or gzipped."""
    return _locations(spark, paths, "url")


def read_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(loc, lastmod) of the sitemaps that sitemap index files list; fetch those and pass them to ``read_urls``."""
    return _locations(spark, paths, "sitemap")


def read_tree(spark: SparkSession, paths: str | list[str], catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """(loc, lastmod) of the page entries of every sitemap that ``roots`` (loc) name, directly or through indexes.

    ``paths`` holds the fetched files, ``catalog`` (loc, name) tells under which last path segment each was saved. Indexes
    may nest to any depth and name each other in circles; each file is followed once, files that were not fetched and
    files that no index names are left out. All indexes are read in one scan; each round joins the files found last with
    their links and drops those already seen, so the rounds are the depth of the tree.
    """
    def entries(row: str) -> DataFrame:
        read = spark.read.format("xml").option("rowTag", row).schema(ENTRY).load(paths)
        name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
        return read.filter(F.col("loc").isNotNull()).select(name.alias("name"), strip("loc").alias("loc"), "lastmod")

    saved = catalog.select("loc", "name").dropna().distinct()
    links = stored(entries("sitemap").select("name", "loc").join(saved.withColumnRenamed("name", "child"), "loc")
                   .select("name", "child").distinct(), "sitemap-links")
    last = stored(roots.join(saved, "loc").select("name").distinct(), "sitemap-found")
    seen = last
    while not last.isEmpty():
        found = last.join(links, "name").select(F.col("child").alias("name")).distinct()
        last = stored(found.join(seen, "name", "left_anti"), "sitemap-found")
        seen = seen.union(last)
    return entries("url").join(seen, "name", "left_semi").select("loc", "lastmod")


def read_binaries(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, name, length, content) of fetched binary files; the name is the last path segment."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length", "content")
