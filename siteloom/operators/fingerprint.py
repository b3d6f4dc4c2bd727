"""Per-page measurements: fingerprints, SEO baseline, platform detection, static player check."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from .ranking import bottom_k


def fingerprint(
    pages: DataFrame,
    html: str = "html",
    region: str = "main",
    fallback: str | None = None,
    keep: tuple[str, ...] = ("page_id",),
    max_headings: int | None = None,
    exact: bool = True,
) -> DataFrame:
    """Text length, image counts by source, headings, block count; narrow, no shuffle.

    ``max_headings`` keeps the first so many, for a preview; all by default.
    """
    doc = text.region(F.col(html), region, fallback)
    base = pages.select(*keep, doc.alias("_doc"))
    imgs = F.regexp_extract_all("_doc", F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))
    kinds = F.transform(
        imgs, lambda t: urls.image_source_kind(F.regexp_extract(t, r'src\s*=\s*"([^"]*)"', 1))
    )
    h2 = F.transform(
        F.regexp_extract_all("_doc", F.lit(r"(?is)<h2\b[^>]*>(.*?)</h2>"), F.lit(1)),
        lambda h: text.strip_tags(h, ""),
    )
    # decoded in one piece, as entities of every kind need Python
    whole = F.split(text.unescape_all(F.array_join(h2, "\x01")), "\x01")
    h2 = F.when(F.size(h2) > 0, F.transform(whole, lambda h: F.trim(h))).otherwise(F.array().cast("array<string>"))

    def kind_count(kind: str) -> Column:
        return F.size(F.filter("_kinds", lambda k: k == kind))

    return base.select(
        *keep,
        F.length(text.visible_text(F.col("_doc"), exact)).alias("text_len"),
        kinds.alias("_kinds"),
        (F.slice(h2, 1, max_headings) if max_headings else h2).alias("h2"),
        F.regexp_count("_doc", F.lit(rules.BLOCK_CLASS)).alias("blocks"),
    ).select(
        *keep,
        "text_len",
        F.size("_kinds").alias("imgs"),
        kind_count("repository").alias("img_real"),
        kind_count("fallback").alias("img_fallback"),
        kind_count("empty").alias("img_empty"),
        "h2",
        "blocks",
    )


def seo_baseline(dom: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Title, meta description, exactly one h1, alt text on every image."""
    attr = F.col("attrs")
    filled = text.clean(F.col("text")) != ""
    has_alt = text.clean(attr["alt"]) != ""
    described = (
        (F.col("tag") == "meta")
        & (F.lower(F.coalesce(attr["name"], F.lit(""))) == "description")
        & (text.clean(attr["content"]) != "")
    )
    counted = dom.groupBy(*keys).agg(
        F.count_if((F.col("tag") == "title") & filled).alias("titles"),
        F.count_if(described).alias("descriptions"),
        F.count_if(F.col("tag") == "h1").alias("h1"),
        F.count_if(F.col("tag") == "img").alias("images"),
        F.count_if((F.col("tag") == "img") & ~has_alt).alias("images_without_alt"),
    )
    checks = {
        "title": F.col("titles") > 0,
        "description": F.col("descriptions") > 0,
        "single_h1": F.col("h1") == 1,
        "alt": F.col("images_without_alt") == 0,
    }
    missing = F.filter(
        F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull()
    )
    return counted.withColumn("missing", missing)


def required_text(pattern: str) -> tuple[str, bool]:
    """The longest text that every match of ``pattern`` contains, and whether that is all of the pattern.

    Empty where a pattern has alternatives, groups, flags or quantified signs, of which nothing is known.
    """
    parts = re.findall(r"\\[A-Za-z]|\[[^\]]*\][*+?]?|\\.|.", pattern, re.S)
    if any(p in "|(){?*+^$." for p in parts):
        return "", False
    runs, whole = [""], True
    for p in parts:
        if len(p) == 1 or (p[0] == "\\" and not p[1].isalpha()):
            runs[-1] += p[-1]
        else:
            runs.append("")
            whole = False
    return max(runs, key=len), whole


def _matches(html: Column, pattern: str) -> Column:
    """A plain search of what the pattern needs settles most pages; only the others are matched."""
    needed, whole = required_text(pattern)
    if not needed:
        return html.rlike(pattern)
    found = F.contains(html, F.lit(needed))
    return found if whole else F.when(found, html.rlike(pattern)).otherwise(F.when(html.isNotNull(), F.lit(False)))


def signature_hits(html: Column, signatures=None) -> Column:
    """array<struct<platform, ord, hits>> for one page."""
    table = signatures or rules.SIGNATURES
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("platform"),
                F.lit(i).alias("ord"),
                reduce(lambda a, b: a + b, [_matches(html, p).cast("int") for p in patterns]).alias("hits"),
            )
            for i, (name, patterns) in enumerate(table)
        ]
    )


def detect_platform(
    pages: DataFrame,
    by: list[str],
    html: str = "html",
    order: str = "page_id",
    sample: int | None = None,
    signatures=None,
    min_hits: int = rules.MIN_SIGNATURE_HITS,
) -> DataFrame:
    """(by, pages, platform, score): best-scoring platform per group, 'generic' below ``min_hits``."""
    if sample:
        pages = bottom_k(pages, by, order, sample)
    table = signatures or rules.SIGNATURES
    scored = pages.select(*by, signature_hits(F.col(html), table).alias("_s"))
    sums = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        *[F.sum(F.col("_s")[i]["hits"]).alias(f"_p{i}") for i in range(len(table))],
    )
    best = F.array_max(
        F.array(
            *[
                F.struct(F.col(f"_p{i}").alias("score"), F.lit(-i).alias("o"), F.lit(name).alias("name"))
                for i, (name, _) in enumerate(table)
            ]
        )
    )
    return sums.withColumn("_b", best).select(
        *by,
        "pages",
        F.when(F.col("_b.score") >= min_hits, F.col("_b.name")).otherwise("generic").alias("platform"),
        F.col("_b.score").alias("score"),
    )


def structure_signals(dom: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, cards, max_cards, images): list items and card-like classes, the largest cluster of
    one class string (repeats below two count as none), images. One pass, two-level grouping."""
    cls = F.array_join("classes", " ")
    carded = (F.col("tag") == "li") | cls.rlike(rules.CARD_CLASS)
    level = dom.groupBy(*keys, cls.alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(carded).alias("_cards"), F.count_if(F.col("tag") == "img").alias("_imgs")
    )
    repeated = F.when((F.col("_c") != "") & (F.col("_n") >= 2), F.col("_n"))
    return level.groupBy(*keys).agg(
        F.sum("_cards").alias("cards"), F.coalesce(F.max(repeated), F.lit(0)).alias("max_cards"), F.sum("_imgs").alias("images")
    )


def video_players(dom: DataFrame, key: str = "page_id", section: str = "video") -> DataFrame:
    """(key, section, playable): does a video section hold an iframe or a playable video source?

    A section is a component whose classes name ``section``. The parser already attached every
    descendant to its component, so this is one grouping by (page, component).
    """
    attr = F.col("attrs")
    is_section = (F.col("tag") == "div") & F.array_contains("classes", "component") & F.array_contains("classes", section)
    src = F.coalesce(attr["src"], F.lit("")) != ""
    hosted = F.coalesce(attr["type"], F.lit("")).rlike("(?i)youtube|vimeo")
    playable = (
        (F.col("tag") == "iframe")
        | ((F.col("tag") == "video") & src)
        | ((F.col("tag") == "source") & src & ~hosted)
    )
    rows = dom.where(is_section | F.col("tag").isin("iframe", "video", "source")).select(
        key, F.when(is_section, F.col("seq")).otherwise(F.col("component")).alias("section"),
        is_section.alias("_is"), playable.alias("_play"),
    )
    found = rows.groupBy(key, "section").agg(F.bool_or("_is").alias("_is"), F.bool_or("_play").alias("playable"))
    return found.where("_is").select(key, "section", "playable")


def page_sections(dom: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, headings array, facet_options array, max_cards, imgs): what ``audit.section_gate`` compares.

    All from the main region (else the body): texts of h1 to h3 and of the options of selects, in order;
    the largest cluster of one class string (two or more); images. A group is one page's elements.
    """
    piece = text.clean(F.col("spaced"))
    main = dom.where("main")
    cls = F.when(F.size("classes") > 0, F.array_join("classes", " "))
    said = lambda test: F.transform(
        F.array_sort(F.collect_list(F.when(test & (piece != ""), F.struct("seq", piece.alias("t"))))), lambda x: x["t"]
    )
    parts = main.groupBy(key).agg(
        said(F.col("tag").isin("h1", "h2", "h3")).alias("headings"),
        said(F.col("tag") == "option").alias("facet_options"),
        F.count_if(F.col("tag") == "img").alias("imgs"),
    )
    clusters = main.where(cls.isNotNull()).groupBy(key, cls.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    clusters = clusters.where("_n >= 2").groupBy(key).agg(F.max("_n").alias("max_cards"))
    return parts.join(clusters, key, "left").select(
        key, "headings", "facet_options", F.coalesce("max_cards", F.lit(0)).alias("max_cards"), "imgs"
    )
