"""Component instances, their inventory, and shape reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from .dom import field_names, semantic_class
from .joins import skew_join


def _image(src: Column, alt: Column, seq: Column) -> Column:
    return F.struct(seq.alias("seq"), urls.filename_for(src).alias("file"), text.clean(alt).alias("alt"))


def component_instances(
    dom: DataFrame,
    key: str = "page_id",
    item_markers: tuple[str, ...] = tuple(rules.ITEM_MARKERS),
    layout_pattern: str = rules.LAYOUT_CLASS,
    field_prefix: str = rules.FIELD_PREFIX,
) -> DataFrame:
    """(key, idx, type, parent, is_item, fields, images, links, empty); ``idx`` is the element's seq.

    Fields, images and links go to the nearest enclosing component or item, or to the component
    itself when its own element carries the field class. One read of ``dom`` and one shuffle, by
    page; both groupings below reuse that partitioning and no group exceeds one page.
    """
    markers = F.array(*[F.lit(m) for m in item_markers])
    is_component = F.array_contains("classes", "component") & ~F.array_contains("classes", "component-content")
    is_item = F.col("component").isNotNull() & F.arrays_overlap("classes", markers) & ~is_component
    marked = (F.col("tag") == "div") & (is_component | is_item)
    head = F.when(
        marked,
        F.struct(
            F.when(is_item, F.filter("classes", lambda c: F.array_contains(markers, c))[0])
            .otherwise(semantic_class(F.col("classes"), layout_pattern))
            .alias("type"),
            F.when(is_item, F.col("component")).otherwise(F.col("owner")).alias("parent"),
            is_item.alias("is_item"),
        ),
    )
    attr = F.col("attrs")
    src = F.coalesce(F.nullif(attr["src"], F.lit("")), F.nullif(attr["data-src"], F.lit("")))
    names = field_names(F.col("classes"), field_prefix)
    is_img = (F.col("tag") == "img") & urls.is_image(src)
    is_link = (F.col("tag") == "a") & (F.coalesce(attr["href"], F.lit("")) != "")
    value = text.clean(F.col("spaced"))
    facts = dom.select(
        key,
        F.when(marked, F.col("seq")).otherwise(F.col("owner")).alias("idx"),
        head.alias("_head"),
        F.when((F.size(names) > 0) & (value != ""), F.struct("seq", names.alias("names"), value.alias("value"))).alias("_field"),
        F.when(is_img, _image(src, attr["alt"], F.col("seq"))).alias("_img"),
        F.when(is_link, F.struct("seq", value.alias("text"), attr["href"].alias("href"))).alias("_link"),
    ).where(
        F.col("idx").isNotNull()
        & (F.col("_head").isNotNull() | F.col("_field").isNotNull() | F.col("_img").isNotNull() | F.col("_link").isNotNull())
    )
    packed = (
        facts.repartition(key)
        .groupBy(key, "idx")
        .agg(
            F.max("_head").alias("_h"),
            F.array_sort(F.collect_list("_field")).alias("_f"),
            F.array_sort(F.collect_list("_img")).alias("_i"),
            F.array_sort(F.collect_list("_link")).alias("_l"),
        )
        .where(F.col("_h").isNotNull())
    )
    pairs = F.flatten(
        F.transform("_f", lambda f: F.transform(f["names"], lambda n: F.struct(n.alias("k"), f["value"].alias("v"))))
    )
    uniq = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    fields = F.map_from_arrays(
        uniq,
        F.transform(
            uniq,
            lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), " "),
        ),
    )
    rows = packed.select(
        key,
        "idx",
        "_h.type",
        "_h.parent",
        "_h.is_item",
        fields.alias("fields"),
        F.transform("_i", lambda i: F.struct(i["file"].alias("file"), i["alt"].alias("alt"))).alias("images"),
        F.transform("_l", lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href"))).alias("links"),
    )
    return finish_page(rows, key)


def finish_page(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Hand out container images and flag empty leaves.

    A container's images go to its item children, n-th to n-th, only where no item has an image of
    its own; surplus images stay behind. ``empty``: no fields, images or links, nothing nested.

    Two groupings below the page, one by parent and one by element. Both keep the partitioning by
    page, so nothing is shuffled, and work grows with the number of elements of a page.
    """
    cols = ["idx", "type", "parent", "is_item", "fields", "images", "links"]
    roles = F.array(
        F.struct(F.col("idx").alias("_gid"), F.lit(False).alias("_child")), F.struct(F.col("parent").alias("_gid"), F.lit(True).alias("_child"))
    )
    each = rows.select(key, F.struct(*cols).alias("_row"), F.inline(roles)).where(F.col("_gid").isNotNull())
    item = F.col("_child") & F.col("_row.is_item")
    met = each.groupBy(key, "_gid").agg(
        F.first(F.when(~F.col("_child"), F.col("_row")), ignorenulls=True).alias("_own"),
        F.array_sort(F.collect_list(F.when(item, F.col("_row.idx")))).alias("_items"),
        F.bool_or(item & (F.size("_row.images") > 0)).alias("_busy"),
        F.count_if("_child").alias("_kids"),
    )
    images = F.col("_own.images")
    gives = (F.size("_items") > 0) & ~F.col("_busy") & (F.size(images) > 0)
    nothing = F.array().cast("array<struct<file:string,alt:string>>")
    kept = F.when(gives, F.slice(images, F.size("_items") + 1, F.size(images))).otherwise(images)
    given = F.transform(
        F.slice("_items", F.lit(1), F.size(images)),
        lambda x, n: F.struct(x.alias("idx"), F.lit(None).cast("bigint").alias("kids"), F.slice(images, n + 1, F.lit(1)).alias("images"), F.lit(True).alias("given")),
    )
    own = F.array(F.struct(F.col("_gid").alias("idx"), F.col("_kids").alias("kids"), F.coalesce(kept, nothing).alias("images"), F.lit(False).alias("given")))
    parts = met.select(key, "_gid", "_own", F.inline(F.concat(own, F.when(gives, given).otherwise(F.filter(own, lambda _: F.lit(False))))))
    mine = F.col("idx") == F.col("_gid")
    done = parts.groupBy(key, "idx").agg(
        F.first(F.when(mine, F.col("_own")), ignorenulls=True).alias("_r"),
        F.max("kids").alias("_kids"),
        F.first(F.when(F.col("given"), F.col("images")), ignorenulls=True).alias("_given"),
        F.first(F.when(~F.col("given"), F.col("images")), ignorenulls=True).alias("_left"),
    ).where(F.col("_r").isNotNull())
    flat = done.select(
        key, *[F.col(f"_r.{c}").alias(c) for c in cols if c != "images"], F.coalesce("_given", "_left").alias("images"), "_kids"
    )
    bare = (F.size("fields") == 0) & (F.size("images") == 0) & (F.size("links") == 0)
    return flat.select(key, *cols, (bare & (F.coalesce("_kids", F.lit(0)) == 0)).alias("empty"))


def source_components(
    dom: DataFrame, key: str = "page_id", layout_pattern: str = rules.INVENTORY_LAYOUT_CLASS
) -> DataFrame:
    """Per component element: type, aliases, field names, child types, series counts, icons.

    One read of ``dom``, one shuffle by page.
    """
    is_component = (F.col("tag") == "div") & F.array_contains("classes", "component")
    after = F.filter("classes", lambda c: ~c.isin("component", "component-content"))
    named = F.filter(after, lambda c: ~c.rlike(layout_pattern))
    sem = F.when(F.size(named) > 0, named).when(F.size(after) > 0, after).otherwise(F.array(F.lit("unknown")))
    none = F.array().cast("array<string>")
    rows = dom.select(
        key,
        F.when(is_component, F.col("seq")).otherwise(F.col("component")).alias("idx"),
        F.when(is_component, F.struct(F.col("component").alias("parent"), sem.alias("aliases"))).alias("_head"),
        field_names(F.col("classes")).alias("_fields"),
        (F.col("tag") == "a").cast("int").alias("_a"),
        (F.col("tag") == "li").cast("int").alias("_li"),
        F.when(F.col("tag") == "i", F.filter("classes", lambda c: c.startswith("fa-"))).otherwise(none).alias("_icons"),
    ).where(F.col("idx").isNotNull())
    packed = (
        rows.repartition(key)
        .groupBy(key, "idx")
        .agg(
            F.max("_head").alias("_h"),
            F.array_distinct(F.flatten(F.collect_list("_fields"))).alias("fields"),
            F.sum("_a").alias("links"),
            F.sum("_li").alias("list_items"),
            F.array_distinct(F.flatten(F.collect_list("_icons"))).alias("icons"),
        )
        .where(F.col("_h").isNotNull())
        .select(
            key, "idx", "_h.parent", F.col("_h.aliases")[0].alias("type"), "_h.aliases", "fields", "links", "list_items", "icons"
        )
    )
    cols = [c for c in packed.columns if c != key]
    page = packed.groupBy(key).agg(F.collect_list(F.struct(*cols)).alias("_all"))
    return page.select(
        key,
        F.inline(
            F.transform(
                "_all",
                lambda i: F.struct(
                    *[i[c].alias(c) for c in cols],
                    F.array_distinct(
                        F.transform(F.filter("_all", lambda c: c["parent"] == i["idx"]), lambda c: c["type"])
                    ).alias("children"),
                ),
            )
        ),
    )


def component_values(components: DataFrame, key: str = "page_id") -> DataFrame:
    """(type, kind, value, n, links, list_items, at): each page, field, child type, alias and icon of a type, once.

    Rows, not lists: a type's pages and vocabulary may be of any length.
    """

    def named(kind: str, column: str) -> Column:
        return F.transform(column, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    page = F.array(F.struct(F.lit("page").alias("kind"), F.col(key).cast("string").alias("value")))
    entries = F.concat(page, named("field", "fields"), named("child", "children"), named("alias", "aliases"), named("icon", "icons"))
    flat = components.select("type", "links", "list_items", F.struct(key, "idx").alias("at"), F.inline(entries))
    return flat.groupBy("type", "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("links").alias("links"), F.max("list_items").alias("list_items"), F.min("at").alias("at")
    )


def component_inventory(components: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per component type, most frequent first: instances, and how many pages, fields, child types,
    aliases and icons. ``component_values`` names these."""
    kind = F.col("kind")
    icon = (kind == "icon") & (F.col("value").startswith("fa-brand") | F.col("value").isin(rules.BRAND_ICONS))
    out = component_values(components, key).groupBy("type").agg(
        F.sum(F.when(kind == "page", F.col("n"))).alias("instances"),
        F.count_if(kind == "page").alias("pages"),
        F.max("links").alias("link_series"),
        F.max("list_items").alias("list_items"),
        F.count_if(kind == "field").alias("fields"),
        F.count_if(kind == "child").alias("child_types"),
        F.count_if(kind == "alias").alias("aliases"),
        F.count_if(kind == "icon").alias("icons"),
        F.bool_or(icon).alias("_branded"),
        F.min("at").alias("_first"),
    )
    hint = (
        F.when((F.col("link_series") >= 3) & F.col("_branded"), "social link series")
        .when(F.col("link_series") >= 3, "link series")
        .when((F.col("list_items") >= 3) & (F.col("child_types") == 0), "repeating list items")
    )
    out = out.withColumn("is_container", F.col("child_types") > 0).withColumn("hint", hint)
    return out.orderBy(F.desc("instances"), "_first").drop("_first", "_branded")


def extraction_totals(instances: DataFrame, key: str = "page_id") -> DataFrame:
    chars = F.aggregate(F.map_values("fields"), F.lit(0), lambda a, v: a + F.length(v))
    return instances.agg(
        F.count_distinct(key).alias("pages"),
        F.count(F.lit(1)).alias("instances"),
        F.coalesce(F.sum(chars), F.lit(0)).alias("field_chars"),
        F.coalesce(F.sum(F.size("images")), F.lit(0)).alias("images"),
    )


def shape_duplicates(records: DataFrame, names: Column, type_col: str = "type", min_keys: int = 2) -> DataFrame:
    """(shape, type, type_count): types that share one set of property names with another type.

    One row per type, so a shape shared by very many types needs no list of them anywhere.
    """
    shape = F.array_join(F.array_sort(F.array_distinct(names)), ",")
    rows = records.where(F.size(F.array_distinct(names)) >= min_keys).select(
        shape.alias("shape"), F.col(type_col).alias("type")
    ).distinct()
    shared = rows.groupBy("shape").agg(F.count(F.lit(1)).alias("type_count")).where(F.col("type_count") > 1)
    return skew_join(rows, shared, ["shape"], "inner")


def duplicate_keys(rows: DataFrame, keys: list[str], source: str | None = None) -> DataFrame:
    """Composite keys registered more than once."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if source:
        aggs += [F.min(source).alias("first_source"), F.max(source).alias("last_source")]
    return rows.groupBy(*keys).agg(*aggs).where(F.col("n") > 1)


def hook_orphans(views: DataFrame, css_classes: DataFrame, prefix: str = rules.FIELD_PREFIX) -> DataFrame:
    """(view, token) used bare although the style sheet knows only the prefixed form.

    ``views(view, token)`` and ``css_classes(token)`` hold class tokens.
    """
    known = css_classes.select("token").distinct()
    prefixed = known.where(F.col("token").startswith(prefix)).select(
        F.substr("token", F.lit(len(prefix) + 1)).alias("token")
    )
    only = prefixed.join(known, "token", "left_anti")
    used = views.select("view", "token").distinct()
    paired = used.where(F.col("token").startswith(prefix)).select(
        "view", F.substr("token", F.lit(len(prefix) + 1)).alias("token")
    )
    return used.join(only, "token", "left_semi").join(paired, ["view", "token"], "left_anti").select("view", "token")
