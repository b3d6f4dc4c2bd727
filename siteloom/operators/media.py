"""Media references of a page and their best variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, urls


def media_hits(dom: DataFrame, keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keys, seq, slot, kind, src, alt, cls): every image reference form, in document order.

    All forms are read from one pass over the elements: each element yields an array of candidate
    hits and empty ones drop out after the explode.
    """
    attr = F.col("attrs")
    cls = F.array_join("classes", " ")
    alt = F.coalesce(attr["alt"], F.lit(""))
    tag = F.col("tag")
    rel = F.lower(F.coalesce(attr["rel"], F.lit("")))
    meta = F.lower(F.coalesce(F.nullif(attr["property"], F.lit("")), attr["name"], F.lit("")))

    def hit(slot: int, kind: str, cond: Column, src: Column, alt_: Column, cls_: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(slot).alias("slot"), F.lit(kind).alias("kind"),
                F.when(cond, src).alias("src"), alt_.alias("alt"), cls_.alias("cls"),
            )
        )

    none = F.lit("")
    single = [
        hit(i, "img", tag == "img", attr[name], alt, cls) for i, name in enumerate(rules.LAZY_ATTRS)
    ] + [
        hit(10, "srcset", tag == "img", urls.largest_srcset(attr["srcset"]), alt, cls),
        hit(11, "source", tag == "source", urls.largest_srcset(attr["srcset"]), none, cls),
        hit(12, "icon", (tag == "link") & rel.contains("icon"), attr["href"], none, F.lit("favicon")),
        hit(13, "social", (tag == "meta") & meta.isin("og:image", "twitter:image"), attr["content"], none, F.lit("og")),
    ]

    def styled(kind: str, first: int, found: Column, cls_: Column) -> Column:
        return F.transform(
            F.coalesce(found, F.array().cast("array<string>")),
            lambda u, i: F.struct(
                (i + first).alias("slot"), F.lit(kind).alias("kind"), u.alias("src"), none.alias("alt"), cls_.alias("cls")
            ),
        )

    sheet = F.when(
        tag == "style",
        F.filter(urls.css_urls(F.col("text")), lambda u: u.rlike(rules.IMAGE_EXT)),
    )
    hits = F.concat(
        *single,
        styled("inline", 100, urls.css_urls(attr["style"]), cls),
        styled("sheet", 100000, sheet, none),
    )
    bearing = tag.isin("img", "source", "link", "meta", "style") | attr["style"].isNotNull()
    rows = dom.where(bearing).select(*keys, "seq", F.inline(hits))
    src = F.trim(F.col("src"))
    return rows.where(F.col("src").isNotNull() & (src != "") & ~F.col("src").startswith("data:")).withColumn("src", src)


def best_variant(hits: DataFrame, keys: list[str], width: str, order: list[str]) -> DataFrame:
    """Widest variant per key, the earliest on a tie; ``first_pos`` keeps the first-seen position."""
    cols = [c for c in hits.columns if c not in keys]
    rank = F.struct(-F.col(width), *[F.col(c) for c in order])
    return (
        hits.groupBy(*keys)
        .agg(
            F.min_by(F.struct(*cols), rank).alias("_best"),
            F.min(F.struct(*order)).alias("first_pos"),
        )
        .select(*keys, "_best.*", "first_pos")
    )


def media_refs(dom: DataFrame, key: str = "page_id", base: str = "url", origin: str | None = None) -> DataFrame:
    """(key, seq, src, file, role, alt, kind, width) per page and file, largest variant kept.

    A reference is resolved against the page's address; on a page without one against ``origin``
    (``corpus_origin``), and without that it stays as it is written.
    """
    # resolving keeps the end of a reference, so the extension test can run on the short form first
    hits = media_hits(dom, (key, base)).where(F.col("src").rlike(rules.IMAGE_EXT))
    own = F.nullif(F.col(base), F.lit(""))
    own = F.coalesce(own, F.lit(origin.rstrip("/") + "/")) if origin else own
    rows = hits.withColumn("src", F.coalesce(urls.resolve(own, F.col("src")), F.col("src")))
    rows = rows.select(
        key,
        urls.filename_for(F.col("src")).alias("file"),
        "seq",
        "slot",
        "kind",
        "src",
        "alt",
        urls.role_for(F.col("src"), F.col("alt"), F.col("cls")).alias("role"),
        urls.width_param(F.col("src")).alias("width"),
    )
    best = best_variant(rows, [key, "file"], "width", ["seq", "slot"])
    at = W.partitionBy(key).orderBy("first_pos")  # one page per partition key
    return best.select(
        key, F.row_number().over(at).alias("seq"), "src", "file", "role", "alt", "kind", "width"
    )


def media_totals(media: DataFrame, key: str = "page_id") -> DataFrame:
    return media.agg(
        F.count_distinct(key).alias("pages"),
        F.count(F.lit(1)).alias("refs"),
        F.count_distinct("src").alias("distinct_srcs"),
    )


def role_histogram(media: DataFrame, key: str = "page_id") -> DataFrame:
    roles = sorted({r for _, r in rules.ROLE_HINTS} | {rules.DEFAULT_ROLE})
    return media.groupBy(key).pivot("role", roles).count().na.fill(0)


def corpus_origin(pages: DataFrame, order: str = "page_id", url: str = "url") -> DataFrame:
    """Origin of the first page that has one."""
    rows = pages.select(F.nullif(urls.origin(F.col(url)), F.lit("")).alias("base"), F.col(order).alias("_o"))
    return rows.where(F.col("base").isNotNull()).agg(F.min_by("base", "_o").alias("base"))


def hero_images(heroes: DataFrame, media: DataFrame, home: str, path: str = "path") -> DataFrame:
    """Image for each hero node: role 'hero' first, else the page's first image.

    ``media(page, seq, src, file, role)``; ``status`` is ok or skipped.
    """
    from .joins import skew_join
    from .ranking import pick

    keyed = heroes.withColumn("page", urls.page_key_of_node(F.col(path), home))
    best = pick(media, ["page"], [F.when(F.col("role") == "hero", 0).otherwise(1), "seq"], ["src", "file"])
    return skew_join(keyed, best, ["page"]).withColumn(
        "status", F.when(F.col("src").isNull(), "skipped").otherwise("ok")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def url_image_references(nodes: DataFrame, pairs: DataFrame, root: str) -> DataFrame:
    """Nodes below ``root`` that hold an image as a URL string.

    ``nodes(path, primary_type, props map)``; ``pairs(primary_type, url_field, ref_field)``.
    """
    rows = nodes.where(F.col("path").startswith(root.rstrip("/") + "/")).join(pairs, "primary_type")
    url = F.col("props")[F.col("url_field")]
    return rows.where(url.isNotNull()).select("path", "primary_type", "url_field", "ref_field", url.alias("url"))
