"""Load plan: component instances -> nodes to create, with type, place and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..operators.joins import skew_join, slug_lookup, tiered_lookup, unsent
from ..operators.ranking import pick
from ..session import cut_lineage


def type_map(manifest: DataFrame) -> DataFrame:
    """(source, node_type, area_type, is_container): aliases lower-cased, the last declaration wins.

    ``manifest(ord, nodeType, areaType, isContainer, sources array)``.
    """
    flat = manifest.select(
        F.explode(F.transform("sources", lambda x: F.lower(x))).alias("source"), "ord",
        F.col("nodeType").alias("node_type"), F.col("areaType").alias("area_type"),
        F.coalesce("isContainer", F.lit(False)).alias("is_container"),
    )
    return pick(flat, ["source"], [-F.col("ord")], ["node_type", "area_type", "is_container"])


def short_name(node_type: Column) -> Column:
    return F.substring_index(node_type, ":", -1)


def area_path(node_type: Column, area_type: Column, main_area: Column, home: str) -> Column:
    """Absolute areas hang directly below home under their own name; others use the page's area."""
    short = short_name(node_type)
    name = None
    for kind, area in rules.AREA_NAMES:
        name = F.when(short == kind, area) if name is None else name.when(short == kind, area)
    return F.when(area_type == "absolute", F.concat(F.lit(home.rstrip("/") + "/"), name.otherwise(short))).otherwise(
        main_area
    )


def property_lists(node_types: DataFrame, title: str = "jcr:title") -> DataFrame:
    """(node_type, text array, weakref array, names array): properties by kind, mandatory first, then as declared.

    ``node_types(node_type, ord, name, ptype, mandatory)`` has a row per declared property; the title and
    names of the system prefixes (``j:``, ``jcr:``) are not for loading. A group is one type's declaration.
    """
    loaded = (F.col("name") != title) & ~F.col("name").startswith("j:") & ~F.col("name").startswith("jcr:")
    entry = F.struct((~F.coalesce("mandatory", F.lit(False))).alias("m"), "ord", "name", F.lower("ptype").alias("ptype"))
    packed = node_types.where(loaded).groupBy("node_type").agg(F.array_sort(F.collect_list(entry)).alias("_p"))

    def named(kind: str | None) -> Column:
        return F.transform(F.filter("_p", lambda p: (p["ptype"] == kind) if kind else F.lit(True)), lambda p: p["name"])

    return packed.select("node_type", named("string").alias("text"), named("weakreference").alias("weakref"), named(None).alias("names"))


def area_plan(instances: DataFrame, manifest: DataFrame, home: str = "/home", page: str = "page") -> DataFrame:
    """(area, node_type, instances, first_page): absolute areas of a site, once each, where their first instance is.

    Types declared with area ``absolute`` (menus, footers) are built once per site below ``home``.
    """
    typed = instances.withColumn("source", F.lower("type")).join(type_map(manifest), "source")
    typed = typed.where(F.col("area_type") == "absolute")
    area = area_path(F.col("node_type"), F.col("area_type"), F.lit(None).cast("string"), home)
    return typed.groupBy(area.alias("area"), "node_type").agg(F.count(F.lit(1)).alias("instances"), F.min(page).alias("first_page"))


def _image_names(props: Column) -> Column:
    allowed = F.array(*[F.lit(n) for n in rules.IMAGE_PROPERTIES])
    return F.filter(props, lambda p: F.array_contains(allowed, p))


def load_plan(
    instances: DataFrame,
    manifest: DataFrame,
    properties: DataFrame,
    media: DataFrame,
    sitemap: DataFrame,
    home: str = "/home",
    page: str = "page",
) -> DataFrame:
    """(page, idx, node_type, parent_path, node_path, name, props map<string,string>).

    ``properties(node_type, text array, weakref array, names array)`` lists property names in
    declared order, mandatory first. ``media(page, seq, file, target_path)``. Values meet
    properties by position inside the row; no shuffle is needed for that. Three intermediate tables
    are written, because each is read more than once.
    """
    typed = instances.withColumn("source", F.lower("type")).join(type_map(manifest), "source").drop("source")
    typed = typed.where(F.coalesce(F.col("area_type"), F.lit("")) != "absolute").join(properties, "node_type")
    typed = cut_lineage(typed, "typed-instances")

    pics = typed.select(page, "idx", F.posexplode("images").alias("_n", "_im")).select(
        page, "idx", "_n", F.col("_im.file").alias("file"), F.col("_im.alt").alias("alt")
    )
    known = media.where(F.col("target_path").isNotNull())
    found = tiered_lookup(cut_lineage(pics, "pictures"), known, ["file"], [[page], []], [page, "seq"], ["target_path"])
    wired = found.where(F.col("target_path").isNotNull()).groupBy(page, "idx").agg(
        F.array_sort(F.collect_list(F.struct("_n", "target_path", "alt"))).alias("_pics")
    )
    rows = typed.join(unsent(wired), [page, "idx"], "left")

    def zipped(names: Column, values: Column) -> Column:
        n = F.least(F.size(names), F.size(values))
        return F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(values, F.lit(1), n))

    none = F.array().cast("array<string>")
    paths = F.coalesce(F.transform("_pics", lambda p: p["target_path"]), none)
    vals = F.transform(F.filter(F.map_values("fields"), lambda v: F.trim(v) != ""), lambda v: F.trim(v))
    image_props = zipped(_image_names(F.col("weakref")), paths)
    text_props = zipped(F.col("text"), vals)
    has = lambda p: F.array_contains("names", p)
    link = F.try_element_at("links", F.lit(1))

    def optional(name: str, cond: Column, value: Column) -> Column:
        empty = F.create_map().cast("map<string,string>")
        return F.when(cond, F.create_map(F.lit(name), value)).otherwise(empty)

    alt = F.coalesce(F.nullif(F.try_element_at("_pics", F.lit(1))["alt"], F.lit("")), F.lit("image"))
    extras = [
        optional("imageAltText", (F.size(paths) > 0) & has("imageAltText"), alt),
        optional(
            "ctaLabel",
            link.isNotNull() & has("ctaLabel") & ~F.map_contains_key(text_props, "ctaLabel"),
            F.coalesce(link["text"], F.lit("")),
        ),
        optional(
            "linkType",
            link.isNotNull() & has("linkType") & link["href"].startswith("http") & ~F.map_contains_key(text_props, "linkType"),
            F.lit("external"),
        ),
    ]
    staged = rows.select(
        page, "idx", "parent", "node_type", "is_container",
        image_props.alias("_p0"), extras[0].alias("_p1"), text_props.alias("_p2"), extras[1].alias("_p3"), extras[2].alias("_p4"),
    )

    # a text value replaces an earlier entry of the same name
    def overlay(base: Column, top: Column) -> Column:
        return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k)), top)

    merged = F.map_concat(overlay(overlay(F.col("_p0"), F.col("_p1")), F.col("_p2")), "_p3", "_p4")
    planned = staged.select(page, "idx", "parent", "node_type", "is_container", merged.alias("props"))

    located = slug_lookup(planned, page, sitemap, home).withColumn("main_area", F.concat("target_path", F.lit("/main")))
    named = located.withColumn(
        "name", F.concat_ws("-", short_name(F.col("node_type")), F.col(page), F.col("idx").cast("string"))
    )
    # tested on the written table: pushed further down, the test would rebuild every property map
    named = cut_lineage(named, "named").where((F.size("props") > 0) | F.col("is_container"))
    created = named.select(page, F.col("idx").alias("parent"), F.lit(True).alias("_nested"))
    chained = named.join(unsent(created), [page, "parent"], "left").withColumn("_up", F.when(F.col("_nested"), F.col("parent")))
    return nested_paths(chained, page).select(
        page, "idx", "node_type", "parent_path", F.concat_ws("/", "parent_path", "name").alias("node_path"), "name", "props"
    )


def nested_paths(rows: DataFrame, page: str, rounds: int = 40) -> DataFrame:
    """Resolve ``_up`` (created parent of the same page, if any) to ``parent_path``, by pointer doubling.

    A row carries its nearest unresolved ancestor and the names from below that one down to itself. Each round
    joins it to the row it points to and takes over what that one has, so the distance doubles: nesting of depth
    d takes log2(d) rounds, no row ever holds its page, and pages without nesting take none. Only rows still open are
    joined; every round is written, so a lost executor repeats one round.
    """
    reached = rows.select(page, "idx", F.col("_up").alias("at"), F.col("name").alias("path"))
    nested = rows.where(F.col("_up").isNotNull())
    if not nested.isEmpty():
        reached = cut_lineage(reached, "reached")
        for n in range(rounds):
            open_ = reached.where(F.col("at").isNotNull())
            above = reached.select(page, F.col("idx").alias("at"), F.col("at").alias("_next"), F.col("path").alias("_above"))
            farther = open_.join(unsent(above), [page, "at"], "left").select(page, "idx", F.col("_next").alias("at"), F.concat_ws("/", "_above", "path").alias("path"))
            reached = cut_lineage(reached.where(F.col("at").isNull()).unionByName(farther), f"reached{n}")
            if reached.where(F.col("at").isNotNull()).isEmpty():
                break
        else:
            raise ValueError(f"rows are nested in themselves, or deeper than 2**{rounds}")
        parents = reached.select(page, F.col("idx").alias("_up"), F.col("path").alias("_chain"))
        rows = rows.join(unsent(parents), [page, "_up"], "left")
    else:
        rows = rows.withColumn("_chain", F.lit(None).cast("string"))
    return rows.withColumn("parent_path", F.concat_ws("/", "main_area", "_chain")).drop("_chain")


def start_node_plan(queries: DataFrame, folders: DataFrame, listing_pages: DataFrame) -> DataFrame:
    """(path, type, target, rule): the folder each managed listing reads from.

    ``queries(path, type)``; ``folders(ord, type, path)``; ``listing_pages(ord, page, path)``. With
    several folders of a type, the listing page named by the query's page path decides, else the
    first folder. The suffix test becomes an equi-join on the suffixes of the page path.
    """
    counted = folders.groupBy("type").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("path", "ord").alias("_first")
    )
    managed = skew_join(queries, counted, ["type"], "inner")
    page = F.substring_index("path", "/main/", 1)
    # only suffixes as long as some listing page; their lengths are one row
    lengths = listing_pages.agg(F.collect_set(F.length("page")).alias("_lens"))
    tails = F.transform(F.filter("_lens", lambda n: (n > 0) & (n <= F.length(page))), lambda n: F.right(page, n))
    suffix = managed.where("_n > 1").crossJoin(F.broadcast(lengths)).select("path", F.explode(tails).alias("page"))
    hits = skew_join(
        suffix, pick(listing_pages, ["page"], ["ord"], ["ord", "path"]).withColumnRenamed("path", "_target"), ["page"], "inner"
    )
    best = hits.groupBy("path").agg(F.min_by("_target", "ord").alias("_target"))
    out = managed.join(best, "path", "left")
    rule = F.when(F.col("_n") == 1, "only folder").when(F.col("_target").isNotNull(), "listing page").otherwise("first folder")
    return out.select(
        "path", "type", F.when(F.col("_n") == 1, F.col("_first")).otherwise(F.coalesce("_target", "_first")).alias("target"), rule.alias("rule")
    )


def start_node_check(queries: DataFrame, managed_types: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, type, failure) of managed listings: start node set, resolvable, and a content folder.

    ``queries(path, type, start_node)``; ``nodes(uuid, path, primary_type)``.
    """
    kept = queries.join(managed_types.select("type"), "type", "left_semi")
    dim = nodes.select(F.col("uuid").alias("start_node"), F.col("primary_type").alias("_t"))
    out = skew_join(kept, dim, ["start_node"])
    failure = (
        F.when(F.coalesce("start_node", F.lit("")) == "", "start node empty")
        .when(F.col("_t").isNull(), "start node does not resolve")
        .when(F.col("_t") != "contentFolder", "start node is no content folder")
    )
    return out.select("path", "type", failure.alias("failure"))


def image_repair_plan(rows: DataFrame, edit: DataFrame, live: DataFrame, sources: DataFrame, site: str) -> DataFrame:
    """How each URL-string image becomes a reference.

    ``rows(path, url)``; ``edit/live(path, uuid)`` repository files; ``sources(file, src)`` original
    sources. Same id in both workspaces: reference it. Else re-import from the original source;
    an external URL is imported; anything else fails.
    """
    marker = f"/sites/{site}/files/"
    inside = F.col("url").contains(marker)
    file = urls.basename(F.col("url"))
    keyed = rows.withColumn(
        "_repo", F.when(inside, F.concat(F.lit("/sites/"), F.regexp_extract("url", r"/sites/(.*)$", 1)))
    ).withColumn("_file", F.when(inside, file))
    out = skew_join(keyed, edit.select(F.col("path").alias("_repo"), F.col("uuid").alias("_edit")), ["_repo"])
    out = skew_join(out, live.select(F.col("path").alias("_repo"), F.col("uuid").alias("_live")), ["_repo"])
    best = sources.groupBy(F.col("file").alias("_file")).agg(F.max("src").alias("_src"))
    out = skew_join(out, best, ["_file"])
    action = (
        F.when(inside & F.col("_edit").isNotNull() & (F.col("_edit") == F.col("_live")), "reference")
        .when(inside & F.col("_src").isNotNull(), "reimport")
        .when(~inside & F.col("url").startswith("http"), "import")
        .otherwise("fail")
    )
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    return out.select(
        "path",
        "url",
        action.alias("action"),
        F.when(action == "reference", F.col("_edit")).alias("uuid"),
        F.when(action == "reimport", F.col("_src")).when(action == "import", F.col("url")).alias("source"),
        F.when(action == "reimport", F.concat(stem, F.lit("-dam."), F.substring_index(file, ".", -1)))
        .when(action == "import", urls.upload_name(F.col("url")))
        .alias("file"),
    )
