"""Captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..operators.ranking import bottom_k


def lenient_text(content: Column) -> Column:
    """UTF-8 with undecodable bytes dropped: they are first marked by the replacement character."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def html_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, html) of every *.html below the given folders."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.html")
        .load(list(paths))
    )
    return raw.select(F.col("path").alias("file"), lenient_text(F.col("content")).alias("html"))


def captured_pages(spark: SparkSession, curated: str | None, crawl: str | None) -> DataFrame:
    """(slug, url, html): curated captures first, crawled pages for the slugs they lack.

    Curated files are flat and carry no origin; crawled ones are ``<host>/<path>.html``.
    """
    parts = []
    if curated:
        c = html_files(spark, curated)
        slug = F.regexp_replace(urls.basename(F.col("file")), r"\.html$", "")
        parts.append(c.select(urls.percent_decode(slug).alias("slug"), F.lit(None).cast("string").alias("url"), "html"))
    if crawl:
        c = html_files(spark, crawl)
        root = crawl.rstrip("/").rsplit("/", 1)[-1]
        rel = F.regexp_replace(F.substring_index("file", f"/{root}/", -1), r"\.html$", "")
        url = F.concat(F.lit("https://"), rel)
        parts.append(c.select(urls.page_slug(url).alias("slug"), url.alias("url"), "html"))
    return parts[0] if len(parts) == 1 else merge_captures(*parts)


def merge_captures(curated: DataFrame, crawled: DataFrame) -> DataFrame:
    """All curated captures, and crawled ones for the slugs they lack."""
    return curated.unionByName(crawled.join(curated.select("slug"), "slug", "left_anti"))


def sample_pages(pages: DataFrame, by: list[str], key: str = "page_id", n: int = 8) -> DataFrame:
    """``n`` pages per site, the same ones however the table is partitioned."""
    return bottom_k(pages, by, key, n)


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Use all cores for a table too small to fill them; a table with enough splits is not shuffled.

    ``rows``: at most about so many in a partition, for small rows from which much is made.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        want = max(want, -(-df.count() // rows))
    return df.repartition(want, key) if df.rdd.getNumPartitions() < want else df


def cached_bodies(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Read-only cache lookup: every request stays, ``hit`` says whether a non-empty body exists."""
    from ..operators.joins import skew_join

    out = skew_join(requests, cache.select(key, "body"), [key])
    return out.withColumn("hit", F.coalesce(F.length("body") > 0, F.lit(False)))
