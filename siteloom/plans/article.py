"""Article cores from component instances, and their load plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators.joins import tiered_lookup
from ..session import cut_lineage


def body_fragment(title: Column, desc: Column, page_title: Column) -> Column:
    """Heading unless it repeats the page title, then the text, wrapped unless already markup."""
    head = F.when(
        (title != "") & (F.lower(title) != F.lower(page_title)), F.concat(F.lit("<h2>"), title, F.lit("</h2>"))
    )
    para = F.when(desc.contains("<"), desc).otherwise(F.concat(F.lit("<p>"), desc, F.lit("</p>")))
    return F.concat_ws("\n", head, F.when(desc != "", para))


def article_core(
    instances: DataFrame,
    field_map: dict[str, str],
    title_type: str = "title",
    body_types: tuple[str, ...] = ("content", "rich-text"),
    key: str = "page_id",
    slug: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(key, title, publish_date, date, summary, location, body, hero_file, hero_alt) per page.

    One grouping by page. ``field_map`` names the source field of each property; ``limit`` cuts title,
    summary and location for a store that cannot hold more.
    """
    fields = F.col("fields")

    def source(prop: str) -> Column:
        name = field_map.get(prop, "titre" if prop == "title" else None)
        return fields[name] if name else F.lit(None).cast("string")

    is_title = (F.col("type") == title_type) & (F.size("fields") > 0)
    head = F.struct(
        source("title").alias("title"),
        source("publishDate").alias("publish"),
        source("date").alias("date"),
        source("summary").alias("summary"),
        source("location").alias("location"),
        F.try_element_at("images", F.lit(1)).alias("img"),
    )
    desc = F.coalesce(F.nullif(fields["description"], F.lit("")), fields["content"], F.lit(""))
    part = F.struct(
        "idx",
        F.trim(F.coalesce(fields["title"], F.lit(""))).alias("t"),
        F.trim(desc).alias("d"),
    )
    extra = [F.first(slug).alias("_slug")] if slug else []
    pages = instances.groupBy(key).agg(
        F.min_by(F.when(is_title, head), F.when(is_title, F.col("idx"))).alias("_h"),
        F.array_sort(F.collect_list(F.when(F.col("type").isin(*body_types), part))).alias("_parts"),
        *extra,
    )
    fallback = F.col("_slug") if slug else F.col(key).cast("string")
    titled = pages.withColumn("title", text.title_clean(F.col("_h.title"), fallback, limit))
    frags = F.filter(
        F.transform("_parts", lambda p: body_fragment(p["t"], p["d"], F.col("title"))), lambda x: x != ""
    )
    body = F.array_join(frags, "\n")

    def short(c: str) -> Column:
        whole = F.trim(F.col(c))
        return F.nullif(text.truncate(whole, limit) if limit else whole, F.lit(""))

    return titled.select(
        key,
        "title",
        dates.dmy_to_iso(F.col("_h.publish")).alias("publish_date"),
        dates.dmy_to_iso(F.col("_h.date")).alias("date"),
        short("_h.summary").alias("summary"),
        short("_h.location").alias("location"),
        F.when(body == "", F.concat(F.lit("<p>"), F.col("title"), F.lit("</p>"))).otherwise(body).alias("body"),
        F.col("_h.img.file").alias("hero_file"),
        F.col("_h.img.alt").alias("hero_alt"),
    )


def article_plan(
    cores: DataFrame, folders: DataFrame, imported: DataFrame, page: str = "page"
) -> DataFrame:
    """Node path, type and hero reference of each article.

    ``cores`` carries (page, folder, ...); ``folders(folder, path, type)``;
    ``imported(page, seq, file, target_path)``. The placed articles are written once, because the
    image lookup reads them several times.
    """
    dim = folders.select("folder", F.col("path").alias("folder_path"), F.col("type").alias("node_type"))
    placed = cut_lineage(cores.join(dim, "folder"), "articles")
    known = imported.where(F.col("target_path").isNotNull()).select(page, "seq", F.col("file").alias("hero_file"), "target_path")
    wired = tiered_lookup(placed, known, ["hero_file"], [[page], []], [page, "seq"], ["target_path"])
    return wired.withColumnRenamed("target_path", "image").withColumn(
        "image_alt", F.when(F.col("image").isNotNull(), F.coalesce(F.nullif("hero_alt", F.lit("")), F.col("title")))
    ).withColumn("node_path", F.concat_ws("/", "folder_path", urls.node_name(F.col(page))))


def manifest_articles(articles: DataFrame, folder: str) -> DataFrame:
    """Desired nodes of an article manifest: done or untitled entries are left out."""
    ok = ~F.coalesce(F.col("done"), F.lit(False)) & (F.coalesce(F.col("title"), F.lit("")) != "")
    return articles.where(ok).select(
        F.concat(F.lit(folder.rstrip("/") + "/"), F.col("name")).alias("path"),
        "title",
        F.coalesce("excerpt", F.lit("")).alias("excerpt"),
        F.coalesce(F.array_join("body", ""), F.lit("")).alias("body"),
        dates.day_to_instant(F.nullif(F.col("date"), F.lit(""))).alias("publish_date"),
        "image",
    )
