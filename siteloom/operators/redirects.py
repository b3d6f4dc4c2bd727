"""Old URLs -> new nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, urls
from .joins import skew_join
from .ranking import pick


def redirect_map(
    old: DataFrame, nodes: DataFrame, aliases: DataFrame, home: str, url: str = "old_url", default_lang: str = "en"
) -> DataFrame:
    """(old_url, lang, target, vanity, match_type, reason).

    Tried in order: locale root -> home, path below the locale -> node path, then a language alias
    ``aliases(lang, alias, path)`` -> node path. Nothing is dropped: an unmatched row has a reason.
    """
    vanity = F.regexp_replace(urls.url_path(F.col(url)), r"(?<=.)/+$", "")
    first = F.regexp_extract(vanity, r"^/([a-z]{2})(?:-[A-Z]{2})?(?=/|$)", 1)
    rest = urls.strip_locale(F.regexp_replace(vanity, r"\.html$", ""))
    rows = old.select(
        F.col(url).alias("old_url"),
        F.when(first == "", default_lang).otherwise(first).alias("lang"),
        vanity.alias("vanity"),
        rest.alias("_rest"),
    )
    prefix = home.rstrip("/") + "/"
    targets = nodes.where(F.col("path").startswith(prefix)).select(
        F.substr("path", F.lit(len(prefix) + 1)).alias("_rest"), F.col("path").alias("_direct")
    ).distinct()
    alias = pick(aliases, ["lang", "alias"], ["path"], ["path"]).select(
        "lang", F.col("alias").alias("_rest"), F.concat(F.lit(prefix), F.col("path")).alias("_aliased")
    )
    alias = alias.join(nodes.select(F.col("path").alias("_aliased")).distinct(), "_aliased", "left_semi")
    out = skew_join(skew_join(rows, targets, ["_rest"]), alias, ["lang", "_rest"])
    is_home = (F.col("_rest") == "") | F.col("_rest").rlike(rules.LOCALE_ROOT)
    kind = (
        F.when(is_home, "home").when(F.col("_direct").isNotNull(), "direct").when(F.col("_aliased").isNotNull(), "alias")
    )
    return out.select(
        "old_url",
        "lang",
        F.when(is_home, F.lit(home)).otherwise(F.coalesce("_direct", "_aliased")).alias("target"),
        "vanity",
        kind.alias("match_type"),
        F.when(kind.isNull(), "no node at this path").alias("reason"),
    )


def unmatched(redirects: DataFrame) -> DataFrame:
    return redirects.where(F.col("match_type").isNull()).select("old_url", "reason")
