"""The content tree: type closure, references, breadcrumbs, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..session import cut_lineage
from .joins import hot_keys, skew_join


def type_closure(type_edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(type, ancestor, depth) over ``type_edges(name, supertype)``, each type being its own ancestor.

    Declarations are schema, not data. Each step adds the distinct pairs one level up that were not
    known before, until there is none (or ``max_depth`` levels): work grows with the pairs, not with
    the paths between them, and cycles end.
    """
    edges = type_edges.select("name", "supertype").where("supertype IS NOT NULL AND name IS NOT NULL").distinct()
    edges = cut_lineage(edges, "type-edges")
    names = type_edges.select(F.explode(F.array("name", "supertype")).alias("type")).where("type IS NOT NULL").distinct()
    known = cut_lineage(names.select("type", F.col("type").alias("ancestor"), F.lit(0).alias("depth")), "closure")
    last, depth = known, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        up = last.join(edges, F.col("ancestor") == F.col("name")).select("type", F.col("supertype").alias("ancestor")).distinct()
        last = up.join(known.select("type", "ancestor"), ["type", "ancestor"], "left_anti").withColumn("depth", F.lit(depth))
        last = cut_lineage(last, "closure")
        if last.isEmpty():
            break
        known = known.unionByName(last)
    return known


def of_type(nodes: DataFrame, closure: DataFrame, wanted: str, type_col: str = "primary_type") -> DataFrame:
    """Nodes whose type is, or inherits from, ``wanted``."""
    subs = closure.where(F.col("ancestor") == wanted).select(F.col("type").alias(type_col))
    return nodes.join(subs, type_col, "left_semi")


def descendants_of(path: Column, root: str) -> Column:
    """Strict subtree predicate; a plain prefix test that reaches the Parquet scan."""
    return path.startswith(root.rstrip("/") + "/")


def children(nodes: DataFrame, parent: str, wanted: Column | None = None) -> DataFrame:
    rows = nodes.where(F.col("parent_path") == parent)
    return rows.where(wanted) if wanted is not None else rows


def resolve_refs(
    rows: DataFrame, ref: str, targets: DataFrame, uuid: str, keep: dict[str, str], skew: bool = False
) -> DataFrame:
    """Left-join reference targets; ``keep`` maps target columns to output names, null when unresolved.

    ``skew`` salts the most referenced targets, at the price of one more scan of the ``ref`` column.
    """
    dim = targets.select(F.col(uuid).alias(ref), *[F.col(a).alias(b) for a, b in keep.items()])
    return skew_join(rows, dim, [ref], hot=hot_keys(rows, [ref]) if skew else None)


def breadcrumbs(
    nodes: DataFrame,
    home: str,
    is_page: Column | None = None,
    path: str = "path",
    title: str = "title",
    name: str = "name",
) -> DataFrame:
    """(path, depth, crumb_path, crumb_title): trail below ``home`` down to each page, pages only.

    A path names its own ancestors, so the walk is an explode plus a lookup. Paths near the root
    are ancestors of nearly everything; the lookup spreads those hot keys. Reads ``nodes`` several
    times: pass a stored table.
    """
    pages = nodes.where(is_page) if is_page is not None else nodes
    below = pages.where(descendants_of(F.col(path), home))
    dim = below.select(
        F.col(path).alias("crumb_path"),
        F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(name)).alias("crumb_title"),
    )
    home_depth = len([p for p in home.split("/") if p])
    trail = below.select(F.col(path), F.posexplode(urls.path_prefixes(F.col(path))).alias("_i", "crumb_path"))
    trail = trail.where(F.col("_i") >= home_depth).withColumn("depth", F.col("_i") - home_depth + 1).drop("_i")
    hot = hot_keys(trail, ["crumb_path"])
    return skew_join(trail, dim, ["crumb_path"], "inner", hot).select(path, "depth", "crumb_path", "crumb_title")


def is_active(path: Column, current: Column) -> Column:
    """The item is the current page or one of its ancestors."""
    return (path == current) | current.startswith(F.concat(path, F.lit("/")))


def nav_items(nodes: DataFrame, closure: DataFrame, item: str = "navMenuItem", menu: str = "navMenu") -> DataFrame:
    """Nodes that are navigation items but not navigation menus."""
    types = closure.groupBy(F.col("type").alias("primary_type")).agg(
        F.bool_or(F.col("ancestor") == item).alias("_item"), F.bool_or(F.col("ancestor") == menu).alias("_menu")
    )
    wanted = types.where(F.col("_item") & ~F.col("_menu")).select("primary_type")
    return nodes.join(wanted, "primary_type", "left_semi")


def nav_tree(items: DataFrame, home: str, depth: int = 3) -> DataFrame:
    """Flattened menu: (level, path_1.., title_1.., ord_1..) from ``home`` down ``depth`` levels.

    Reads ``items`` once per level: pass a stored table. One row per leaf of the cut tree; parents without children stay as rows with null lower levels.
    """
    level = items.select("parent_path", "path", "title", "ord")
    out = level.where(F.col("parent_path") == home).select(
        F.col("path").alias("path_1"), F.col("title").alias("title_1"), F.col("ord").alias("ord_1")
    )
    for i in range(2, depth + 1):
        below = level.select(
            F.col("parent_path").alias(f"path_{i - 1}"),
            F.col("path").alias(f"path_{i}"),
            F.col("title").alias(f"title_{i}"),
            F.col("ord").alias(f"ord_{i}"),
        )
        out = out.join(below, f"path_{i - 1}", "left")
    filled = [F.col(f"path_{i}").isNotNull().cast("int") for i in range(1, depth + 1)]
    total = filled[0]
    for f in filled[1:]:
        total = total + f
    return out.withColumn("level", total)


def item_link(kind: Column, own_url: Column, target_url: Column, external_url: Column) -> Column:
    """Page -> its url, internal link -> target url, external link -> its url, anything else '#'."""
    return F.coalesce(
        F.when(kind == "page", own_url).when(kind == "nodeLink", target_url).when(kind == "externalLink", external_url),
        F.lit("#"),
    )


def filled_or_referenced(
    rows: DataFrame, ref: str, targets: DataFrame, uuid: str, chains: dict[str, list[str | Column]], skew: bool = False
) -> DataFrame:
    """Fallback chains that go on over a reference: ``chains`` maps a new column to its sources in order.

    A source is a column, or ``ref.<column>`` of the referenced row; the first that is neither null nor empty counts, and a
    reference that does not resolve has nothing to give. One join serves all chains.
    """
    wanted = sorted({s[4:] for own in chains.values() for s in own if isinstance(s, str) and s.startswith("ref.")})
    found = resolve_refs(rows, ref, targets, uuid, {c: f"_ref_{c}" for c in wanted}, skew)
    named = {
        name: text.first_filled(*[f"_ref_{s[4:]}" if isinstance(s, str) and s.startswith("ref.") else s for s in own]) for name, own in chains.items()
    }
    return found.withColumns(named).drop(*[f"_ref_{c}" for c in wanted])


def language_alternates(pages: DataFrame, locales: list[str], lang: str = "lang") -> DataFrame:
    """One row per page and site locale (a short literal list), the page's own flagged."""
    each = F.explode(F.array(*[F.lit(x) for x in locales])).alias("alternate")
    return pages.select("*", each).withColumn("current", F.col("alternate") == F.col(lang))


def wide_to_rows(df: DataFrame, ids: list[str], groups: dict[int, tuple[str, ...]], names: tuple[str, ...]) -> DataFrame:
    """Numbered repeated columns -> rows, empty ones dropped by their first value.

    ``groups`` maps the number to its columns, in the order of ``names``.
    """
    packed = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), *[F.col(c).cast("string").alias(n) for c, n in zip(cols, names)])
            for i, cols in groups.items()
        ]
    )
    rows = df.select(*ids, F.inline(packed))
    return rows.where(F.coalesce(F.col(names[0]), F.lit("")) != "")


def folder_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every folder a set of paths implies, once each, shallow first."""
    folders = paths.select(F.explode(urls.path_prefixes(F.col(path))).alias("folder")).distinct()
    return folders.withColumn("depth", F.size(F.split("folder", "/")) - 1)


def pricing_table(cells: DataFrame, ids: list[str], label: str = "label") -> DataFrame:
    """(ids, label, cells map<string,string>, headers array): one row per label, whatever the headers are.

    ``cells(ids, label, pos, header, cell)``, as ``labelled_cells`` gives them. An open pivot: cells go into a map by their
    header, a cell without one under its number; each table's headers, in order of position, come from the same grouping, so
    no list of columns passes the driver and tables may differ in theirs. Of cells with the same header the first counts.
    """
    named = F.coalesce("header", (F.col("pos") + 1).cast("string"))
    packed = cells.withColumn("_name", named).groupBy(*ids, label, "_name").agg(F.min_by(F.struct("pos", "cell"), "pos").alias("_c"))
    rows = packed.groupBy(*ids, label).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_c.cell")))).alias("cells"),
        F.array_sort(F.collect_list(F.struct("_c.pos", "_name"))).alias("_heads"),
    )
    return rows.select(*ids, label, "cells", F.transform("_heads", lambda h: h["_name"]).alias("headers"))


def labelled_cells(df: DataFrame, ids: list[str], cells: Column, headers: Column) -> DataFrame:
    """(ids, pos, header, cell) of a row of cells; a cell beyond the headers has none."""
    flat = df.select(*ids, headers.alias("_h"), F.posexplode(cells).alias("pos", "cell"))
    return flat.withColumn("header", F.try_element_at("_h", F.col("pos") + 1)).drop("_h")
