"""What is required, what is there, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import skew_join
from .ranking import bottom_k
from ..functions import rules


def canonical(df: DataFrame, key: str, aliases: DataFrame | None) -> DataFrame:
    """Replace known aliases (alias, canonical) by their canonical name."""
    rows = df.select(F.col(key).alias(key)).distinct()
    if aliases is None:
        return rows
    dim = aliases.select(F.col("alias").alias(key), F.col("canonical").alias("_c"))
    return rows.join(dim, key, "left").select(F.coalesce("_c", key).alias(key)).distinct()


def coverage(required: DataFrame, provided: DataFrame, key: str, aliases: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """Required keys that are neither provided nor deliberately ignored."""
    out = required.select(key).distinct().join(canonical(provided, key, aliases), key, "left_anti")
    if ignored is not None:
        out = out.join(canonical(ignored, key, aliases), key, "left_anti")
    return out


def drift(declared: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """(key, change): 'new' against the baseline or 'dropped' from it."""
    d, b = declared.select(key).distinct(), baseline.select(key).distinct()
    return (
        d.join(b, key, "left_anti").withColumn("change", F.lit("new"))
        .unionByName(b.join(d, key, "left_anti").withColumn("change", F.lit("dropped")))
    )


def label_gaps(used: DataFrame, labels: DataFrame, langs: list[str], key: str = "key", lang: str = "lang") -> DataFrame:
    """(key, missing): the languages that lack a label for a used key, comma separated.

    The languages are a short literal list, so the requirement is an explode, and a key's labels
    are reduced to a set of at most that many languages before the join.
    """
    wanted = F.array(*[F.lit(x) for x in sorted(langs)])
    have = labels.where(F.col(lang).isin(langs)).select(key, lang).distinct().groupBy(key).agg(
        F.collect_set(lang).alias("_have")
    )
    gaps = F.array_except(wanted, F.coalesce("_have", F.array().cast("array<string>")))
    return (
        used.select(key).distinct().join(have, key, "left").select(key, F.array_join(gaps, ",").alias("missing"))
        .where(F.col("missing") != "")
    )


def orphan_artifacts(produces: DataFrame, consumes: DataFrame, key: str = "artifact") -> DataFrame:
    return produces.join(consumes.select(key).distinct(), key, "left_anti")


def stub_reason(exists: Column, size: Column, json: Column) -> Column:
    """Why an artifact is no real delivery; null if it is one."""
    keys = F.json_object_keys(json)
    pages = F.get_json_object(json, "$.pages")
    return (
        F.when(~F.coalesce(exists, F.lit(False)), "missing")
        .when(size <= 2, F.concat(F.lit("empty ("), size.cast("string"), F.lit("b)")))
        .when(json.isNotNull() & F.try_parse_json(json).isNull(), "unreadable JSON")
        .when(F.size(keys) == 0, "empty object")
        .when(F.json_array_length(json) == 0, "empty array")
        .when(pages.isin("{}", "[]", ""), "no pages")
    )


def contract_check(expectations: DataFrame, observed: DataFrame) -> DataFrame:
    """(step, direction, artifact, producer, reason) for outputs not delivered and inputs unavailable.

    ``expectations(step, direction, artifact)``; ``observed(artifact, exists, size, json)``.
    """
    producer = expectations.where(F.col("direction") == "produces").groupBy("artifact").agg(
        F.min("step").alias("producer")
    )
    checked = expectations.join(observed, "artifact", "left").join(producer, "artifact", "left")
    return checked.withColumn("reason", stub_reason(F.col("exists"), F.col("size"), F.col("json"))).where(
        F.col("reason").isNotNull()
    ).select("step", "direction", "artifact", F.when(F.col("direction") == "consumes", F.col("producer")).alias("producer"), "reason")


def folder_population(folders: DataFrame, children: DataFrame, child_type: str = "child_type") -> DataFrame:
    """(path, children, published, failure) per folder.

    ``folders(path, folder_type, child_type)``; ``children(parent_path, primary_type, status)``.
    """
    per = children.groupBy(F.col("parent_path").alias("path"), F.col("primary_type").alias(child_type)).agg(
        F.count(F.lit(1)).alias("children"), F.count_if(F.col("status") == "PUBLISHED").alias("published")
    )
    out = folders.join(per, ["path", child_type], "left").na.fill(0, ["children", "published"])
    return out.withColumn(
        "failure",
        F.when(F.col("folder_type").isNull(), "folder missing")
        .when(F.col("folder_type") != "contentFolder", "not a content folder")
        .when(F.col("children") == 0, "no children")
        .when(F.col("published") == 0, "none published"),
    )


def import_rate(imported: DataFrame, page: str = "page", target: str = "target_path") -> DataFrame:
    """Per page and (page null) overall: wanted, imported, rate, failure; one grouping pass."""
    rolled = imported.rollup(page).agg(
        F.count(F.lit(1)).alias("wanted"),
        F.count(F.col(target)).alias("imported"),
        F.grouping(F.col(page)).cast("int").alias("is_total"),
    )
    rate = F.col("imported") / F.col("wanted")
    return rolled.withColumn("rate", rate).withColumn(
        "failure",
        F.when((F.col("is_total") == 1) & (rate < rules.IMPORT_MIN_RATE), "import largely failed").when(
            (F.col(page) == "home") & (F.col("imported") == 0), "nothing imported for home"
        ),
    )


def extraction_gate(media: DataFrame, units: DataFrame, page: str = "page") -> DataFrame:
    """One row: totals and the list of failures.

    ``media(page)`` has one row per image; ``units(page, chars)`` one per content unit.
    """
    m = media.agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col(page) == "home").alias("home_images")
    )
    u = units.agg(
        F.count_if(F.col(page) == "home").alias("home_units"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")
    )
    both = m.crossJoin(F.broadcast(u))  # one row each
    checks = [
        (F.col("home_images") == 0, "media: home page has no images"),
        (F.col("images") < rules.MIN_IMAGES, "media: too few images"),
        (F.col("home_units") == 0, "content: home page has no units"),
        (F.col("chars") < rules.MIN_TEXT_CHARS, "content: too little text"),
    ]
    failures = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in checks]), lambda x: x.isNotNull())
    return both.withColumn("failures", failures)


def listing_ratio(found: Column, expected: Column) -> Column:
    return (
        F.when(found == 0, "empty")
        .when((expected > 0) & (found < expected * rules.LISTING_MIN_RATIO), "below half of the source")
        .otherwise("ok")
    )


def with_category_name(rows: DataFrame, names: DataFrame, key: str = "category") -> DataFrame:
    """Display name of a category id, the id itself where it cannot be resolved."""
    dim = names.select(F.col("category_uuid").alias(key), F.col("name").alias("_name"))
    return skew_join(rows, dim, [key]).withColumn(
        "category_name", F.coalesce("_name", F.col(key).cast("string"))
    ).drop("_name")


def translation_coverage(nodes: DataFrame, source: str, target: str, max_gap: float = rules.TRANSLATION_MAX_GAP) -> DataFrame:
    """One row: titled nodes, those with a ``source`` but no ``target`` title, status.

    ``nodes(titles map<lang,string>)``; a gap above ``max_gap`` of the titled nodes fails, a smaller one is a note.
    """
    filled = lambda lang: F.coalesce(F.col("titles")[lang], F.lit("")) != ""
    titled = nodes.where(F.size(F.map_keys("titles")) > 0)
    counted = titled.agg(F.count(F.lit(1)).alias("total"), F.count_if(filled(source) & ~filled(target)).alias("gap"))
    status = F.when(F.col("gap") > F.col("total") * max_gap, "fail").when(F.col("gap") > 0, "note").otherwise("ok")
    return counted.withColumn("status", status)


def sampled_translation_coverage(
    nodes: DataFrame, source: str, target: str, key: str, k: int, max_gap: float = rules.TRANSLATION_MAX_GAP
) -> DataFrame:
    """``translation_coverage`` of all nodes, and of the ``k`` titled ones with the least hash of ``key``, as rows."""
    titled = nodes.where(F.size(F.map_keys("titles")) > 0)
    parts = [("all", titled), ("sample", bottom_k(titled, [], key, k))]
    both = [translation_coverage(rows, source, target, max_gap).select(F.lit(name).alias("rows"), "*") for name, rows in parts]
    return both[0].unionByName(both[1])


def image_references(nodes: DataFrame, names: tuple[str, ...] = tuple(rules.GATE_IMAGE_PROPERTIES)) -> DataFrame:
    """One row: nodes, and how many image references are set on them, each counted."""
    filled = F.filter(F.map_entries("refs"), lambda e: e["key"].isin(*names) & (F.coalesce(e["value"], F.lit("")) != ""))
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum(F.size(filled)), F.lit(0)).alias("references"))


def type_baseline(found: DataFrame, declared: DataFrame, column: str = "type") -> DataFrame:
    """(type, found, declared): types that pages use or declarations name, once each."""
    yes, no = F.lit(True), F.lit(False)
    both = found.select(column, yes.alias("found"), no.alias("declared")).unionByName(
        declared.select(column, no.alias("found"), yes.alias("declared"))
    )
    return both.where(F.col(column).isNotNull()).groupBy(column).agg(F.bool_or("found").alias("found"), F.bool_or("declared").alias("declared"))


def shell_units(units: DataFrame, manifest: DataFrame, on: str) -> DataFrame:
    """Units whose type the manifest marks as needing a resource of its own."""
    return units.join(manifest.select(on).distinct(), on, "left_semi")
