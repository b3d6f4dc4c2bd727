"""Generic content blocks: headings, text, links and images outside page chrome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text, urls


def content_blocks(dom: DataFrame, keys: tuple[str, ...] = ("page_id",), min_chars: int = 2) -> DataFrame:
    """(keys, seq, type, text, href, file, alt) in document order of ``seq``.

    Text is the element's own subtree text; a link inside a paragraph is a row of its own and the
    paragraph keeps its text.
    """
    attr = F.col("attrs")
    body = text.clean(F.col("text"))
    src = F.coalesce(F.nullif(attr["src"], F.lit("")), F.nullif(attr["data-src"], F.lit("")))
    kind = (
        F.when(F.col("tag").isin(rules.HEADING_TAGS), "heading")
        .when(F.col("tag").isin(rules.TEXT_TAGS), "text")
        .when((F.col("tag") == "a") & (F.coalesce(attr["href"], F.lit("")) != ""), "link")
        .when((F.col("tag") == "img") & urls.is_image(src), "image")
    )
    rows = dom.where(~F.col("chrome")).select(
        *keys,
        "seq",
        kind.alias("type"),
        body.alias("_text"),
        attr["href"].alias("_href"),
        urls.filename_for(src).alias("_file"),
        text.clean(attr["alt"]).alias("_alt"),
    )
    is_img, is_link = F.col("type") == "image", F.col("type") == "link"
    enough = F.when(is_img, F.lit(0)).when(is_link, F.lit(1)).otherwise(min_chars)
    return rows.where(F.col("type").isNotNull() & (is_img | (F.length("_text") >= enough))).select(
        *keys,
        "seq",
        "type",
        F.when(~is_img, F.col("_text")).alias("text"),
        F.when(is_link, F.col("_href")).alias("href"),
        F.when(is_img, F.col("_file")).alias("file"),
        F.when(is_img, F.col("_alt")).alias("alt"),
    )


def headings(
    dom: DataFrame, keys: tuple[str, ...] = ("page_id",), tags=("h1", "h2", "h3", "h4"), min_chars: int = 1, max_chars: int | None = None
) -> DataFrame:
    """Distinct normalised headings of the main region (else the body) with their first position.

    ``min_chars`` leaves out short ones where they say nothing, as for matching; ``max_chars`` leaves out long ones where that is wanted.
    """
    rows = dom.where(F.col("tag").isin(*tags) & F.col("main")).select(
        *keys, "seq", text.heading_norm(F.col("spaced")).alias("heading")
    )
    size = F.length("heading")
    rows = rows.where((size >= min_chars) & (size <= max_chars) if max_chars else size >= min_chars)
    return rows.groupBy(*keys, "heading").agg(F.min("seq").alias("seq"))


def links(dom: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep, pos, href, text) of every anchor with a target, however it is quoted; none from comments."""
    href = F.col("attrs")["href"]
    return dom.where((F.col("tag") == "a") & href.isNotNull()).select(
        *keep, F.col("seq").alias("pos"), F.trim(href).alias("href"), text.clean(F.col("spaced")).alias("text")
    )


def error_markers(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",), extra: tuple[str, ...] = ()) -> DataFrame:
    """Repository and rendering errors left in the markup, comments included, each up to the next tag.

    ``extra`` holds further patterns, such as a vendor's own exceptions.
    """
    pattern = "|".join([rules.ERROR_MARKERS, *[f"(?:{p})[^<]*" for p in extra]])
    hits = F.regexp_extract_all(F.col(html), F.lit(f"({pattern})"), F.lit(1))
    return pages.select(*keep, hits.alias("markers")).where(F.size("markers") > 0).select(
        *keep, F.size("markers").alias("hits"), "markers"
    )
