"""Site audit and content gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..operators.audit import audit_pages
from ..operators.fingerprint import fingerprint
from ..operators.tree import descendants_of, of_type


def site_audit(local_pages: DataFrame, reference: DataFrame, page: str = "page", new_section: str | None = None, **kw) -> DataFrame:
    """Fingerprint the local pages, join the reference fingerprints, classify."""
    prints = fingerprint(local_pages, keep=(page,), **kw).withColumnRenamed(page, "page")
    return audit_pages(prints.select("page", "text_len", "imgs"), reference, new_section)


def content_gate(
    nodes: DataFrame,
    closure: DataFrame,
    root: str,
    expected_details: int,
    regions: tuple[str, ...] = ("nav", "footer"),
    langs: tuple[str, str] = ("fr", "en"),
    sample: int | None = None,
) -> DataFrame:
    """(check, status, detail): five checks over ``nodes(uuid, path, parent_path, primary_type, titles
    map<lang,string>, refs map<string,string>)``.
    """
    scope = nodes.where(descendants_of(F.col("path"), root))
    home = root.rstrip("/") + "/home"
    kids = scope.where(F.col("parent_path").startswith(home + "/")).groupBy("parent_path").agg(F.count(F.lit(1)).alias("n"))
    hidden = closure.where("ancestor = 'hiddenType'").select(F.col("type").alias("primary_type"), F.lit(True).alias("hidden"))
    wanted = nodes.sparkSession.createDataFrame([(r, f"{home}/{r}") for r in regions], "region string, path string")
    shell = (
        wanted.join(scope.select("path", "primary_type"), "path", "left")
        .join(kids, F.col("path") == F.col("parent_path"), "left")
        .join(hidden, "primary_type", "left")
        .select(
            F.concat(F.lit("shell:"), F.col("region")).alias("check"),
            F.when(F.col("primary_type").isNull(), "note")
            .when(F.coalesce("n", F.lit(0)) > 0, "ok")
            .when(F.col("hidden"), "note")
            .otherwise("fail")
            .alias("status"),
            F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" children")).alias("detail"),
        )
    )
    content = of_type(scope, closure, "content")
    has_image = F.exists(
        F.map_entries("refs"), lambda e: e["key"].isin(rules.GATE_IMAGE_PROPERTIES) & (F.coalesce(e["value"], F.lit("")) != "")
    )
    images = content.agg(F.count_if(has_image).alias("n"), F.count(F.lit(1)).alias("total")).select(
        F.lit("images").alias("check"),
        F.when((F.col("total") > 0) & (F.col("n") == 0), "fail").otherwise("ok").alias("status"),
        F.format_string("%d of %d nodes", "n", "total").alias("detail"),
    )
    details = of_type(scope, closure, "mainResource").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("listings").alias("check"),
        F.when(F.col("n") == 0, "fail")
        .when(F.lit(expected_details) * rules.LISTING_MIN_RATIO > F.col("n"), "fail")
        .otherwise("ok")
        .alias("status"),
        F.format_string(f"%d of about {expected_details}", "n").alias("detail"),
    )
    titled = scope.where(F.size(F.map_keys("titles")) > 0)
    if sample:
        titled = titled.orderBy("path").limit(sample)
    source, target = langs
    filled = lambda l: F.coalesce(F.col("titles")[l], F.lit("")) != ""
    translations = titled.agg(
        F.count_if(filled(source) & ~filled(target)).alias("gap"), F.count(F.lit(1)).alias("total")
    ).select(
        F.lit("translations").alias("check"),
        F.when(F.col("gap") > F.col("total") * rules.TRANSLATION_MAX_GAP, "fail")
        .when(F.col("gap") > 0, "note")
        .otherwise("ok")
        .alias("status"),
        F.format_string("%d of %d without a title", "gap", "total").alias("detail"),
    )
    pages = of_type(scope, closure, "page")
    debris = content.select("path").unionByName(pages.select("path")).distinct().where(
        urls.is_debris(urls.basename(F.col("path")))
    )
    cleanup = debris.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("cleanup").alias("check"),
        F.when(F.col("n") > 0, "fail").otherwise("ok").alias("status"),
        F.format_string("%d leftover nodes", "n").alias("detail"),
    )
    return reduce(lambda a, b: a.unionByName(b), [shell, images, details, translations, cleanup])


def region_population(nodes: DataFrame, regions: DataFrame, hidden_types: DataFrame) -> DataFrame:
    """(path, children, status) for shared regions; hidden types may be empty."""
    kids = nodes.groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("children"))
    flagged = regions.join(kids, "path", "left").join(
        hidden_types.select("primary_type", F.lit(True).alias("_hidden")), "primary_type", "left"
    )
    n = F.coalesce("children", F.lit(0))
    return flagged.select(
        "path", n.alias("children"), F.when(n > 0, "ok").when(F.col("_hidden"), "exempt").otherwise("empty").alias("status")
    )
