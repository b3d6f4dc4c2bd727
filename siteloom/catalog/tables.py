"""Inputs of the registered queries: the given tables and what Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..sources.pages import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _s(c) -> Column:
    return F.col(c).cast("string")


# one shop page per part; the number of cards, images and optional sections follows from the row
PART_CARDS = "p_size % 4"
PART_IMAGES = "p_size % 4 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` in partitions that stay small however well its file compresses."""
    return spread(table(spark, sf_dir, "part"), "p_partkey", rows=20_000)


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, slug, p_*): structured pages rendered from ``part``, one per row."""
    p = _s("p_partkey")
    cards = F.expr(f"CAST({PART_CARDS} AS INT)")
    images = F.expr(f"CAST({PART_IMAGES} AS INT)")

    def repeat(n: Column, fn) -> Column:
        return F.array_join(
            F.when(n > 0, F.transform(F.sequence(F.lit(1), n), fn)).otherwise(F.array().cast("array<string>")), ""
        )

    def text(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    head = text(
        "<!DOCTYPE html><html><head><title>", F.col("p_name"), " | ", F.col("p_brand"), "</title>",
        '<meta property="og:image" content="/-/media/og-', p, '.png">',
        '<link rel="shortcut icon" href="/favicon.ico">',
        "<style>.p", p, "{background:url('/-/media/bg-", p, ".jpg')}</style></head><body>",
        '<header><nav><ul><li><a href="/home">Home</a></li></ul></nav></header><main>',
    )
    title = text(
        '<div class="component title col-12"><div class="component-content">',
        '<h1 class="field-titre">', F.col("p_name"), " | ", F.col("p_brand"), "</h1>",
        '<p class="field-date">Du ', F.expr("lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0')"), "/",
        F.expr("lpad(CAST(p_partkey % 12 + 1 AS STRING), 2, '0')"), "/2021</p>",
        '<img src="/-/media/hero/', p, '.jpg?w=800" srcset="/-/media/hero/', p, ".jpg?w=400 400w, /-/media/hero/", p,
        '.jpg?w=1600 1600w" alt="', F.col("p_name"), '"></div></div>',
    )
    grid = text(
        '<div class="component picture-grid row"><div class="component-content">',
        repeat(images, lambda i: text('<img data-src="/-/media/pics/', p, "-", i.cast("string"), '.png">')),
        repeat(
            cards,
            lambda i: text(
                '<div class="card col"><h2 class="field-title">Card ', i.cast("string"), "</h2>",
                '<p class="field-text">', F.col("p_type"), " ", i.cast("string"), "</p>",
                '<a href="/en/item/', p, "/", i.cast("string"), '">More</a></div>',
            ),
        ),
        "</div></div>",
    )
    rich = F.when(
        F.col("p_size") % 5 == 0,
        text('<div class="component rich-text"><div class="component-content"><div class="field-content">Body of ', F.col("p_name"), "</div></div></div>"),
    ).otherwise("")
    video = (
        F.when(F.col("p_partkey") % 7 == 0, text('<div class="component video"><iframe src="https://v.example/', p, '"></iframe></div>'))
        .when(F.col("p_partkey") % 7 == 1, F.lit('<div class="component video"><video><source type="video/youtube" src="https://v.example/x"></video></div>'))
        .otherwise("")
    )
    error = F.when(F.col("p_partkey") % 50 == 0, text("<!-- javax.jcr.PathNotFoundException: /x/", p, " -->")).otherwise("")
    tail = text('<div class="component spacer"></div>', error, "</main><footer><p>Imprint</p></footer></body></html>")
    return parts(spark, sf_dir).select(
        F.col("p_partkey").alias("page_id"),
        text("https://shop.example.com/en/", F.lower("p_type"), "/", p).alias("url"),
        F.concat(head, title, grid, rich, video, tail).alias("html"),
        text("p", p).alias("slug"),
        "p_name", "p_brand", "p_type", "p_size",
    )


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content tree /home/<region>/<nation>/<customer> with one category per customer."""
    c = table(spark, sf_dir, "customer")
    where = places(spark, sf_dir)
    # a nation is an ordinary foreign key: a busy one is spread, small dimensions broadcast themselves
    return skew_join(c.withColumnRenamed("c_nationkey", "n_nationkey"), where, ["n_nationkey"], "inner").select(
        _s("c_custkey").alias("uuid"),
        F.concat("nation_path", F.lit("/"), _s("c_custkey")).alias("path"),
        F.col("nation_path").alias("parent_path"),
        _s("c_custkey").alias("name"),
        F.col("c_name").alias("title"),
        F.array("c_mktsegment").alias("categories"),
        "c_custkey", "c_mktsegment", "c_acctbal", "n_name", "r_name", "n_nationkey",
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "n_name", "r_regionkey", "r_name",
        F.concat(F.lit("/home/"), "r_name").alias("region_path"),
        F.concat(F.lit("/home/"), "r_name", F.lit("/"), "n_name").alias("nation_path"),
    )


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as leaf nodes below their customer."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = customer_nodes(spark, sf_dir).select("c_custkey", F.col("path").alias("parent_path"), "categories", "c_mktsegment")
    return skew_join(o, c, ["c_custkey"], "inner").select(
        _s("o_orderkey").alias("uuid"),
        F.concat("parent_path", F.lit("/"), _s("o_orderkey")).alias("path"),
        "parent_path", "categories", "c_mktsegment", "c_custkey",
        "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority",
    )
