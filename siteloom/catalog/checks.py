"""Queries over gates, reports, sinks and lists that the other modules do not reach."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import audit, components, coverage, dom, fingerprint, listing, media, tokens, tree, upsert
from ..operators.joins import prefix_classify
from ..plans import article, load
from ..session import stage_folder
from ..sources import captures, lists, manifests, sinks
from ..sources import pages as captured
from . import query
from .audits import _AUDIT, _fingerprints, _gate_nodes
from .loads import _manifest, part_instances
from .listings import _NODES
from .markup import _INST, _MEDIA, part_dom
from .sheets import _FONTS, _TOKENS, _sheets
from .tables import PART_CARDS, PART_IMAGES, customer_nodes, part_pages, table


def _s(c):
    return F.col(c).cast("string")


def _folder(spark, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _with_facets(spark, sf):
    """Part pages with a select of two or three options and a heading outside the main region."""
    options = F.concat(
        F.lit("<select><option>All  types</option><option>"), F.col("p_type"), F.lit("</option>"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<option>"), F.col("p_brand"), F.lit("<br></option>"))).otherwise(""), F.lit("</select></main>"),
    )
    html = F.replace(F.replace("html", F.lit("</main>"), options), F.lit("<footer>"), F.lit("<footer><h2>Imprint</h2>"))
    return part_pages(spark, sf).withColumn("html", html)


def _sections(spark, sf, dropped=None):
    site = _with_facets(spark, sf)
    if dropped is not None:
        site = site.withColumn("html", F.when(dropped, F.replace("html", F.lit('class="card col"'), F.lit("id=x"))).otherwise(F.col("html")))
    return fingerprint.page_sections(dom.dom_nodes(site, keep=("page_id",)))


_CARDS_MAX = f"greatest(CASE WHEN {PART_CARDS} >= 2 THEN {PART_CARDS} ELSE 0 END, 2 + (p_size % 5 = 0)::INT)::BIGINT"


@query(
    "q92_page_sections",
    f"""WITH c AS (SELECT p_partkey, string_agg('Card ' || k, '>' ORDER BY k) AS cards FROM (SELECT p_partkey, unnest(generate_series(1, {PART_CARDS})) AS k FROM part) GROUP BY p_partkey)
        SELECT p_partkey AS page_id, p_name || ' | ' || p_brand || coalesce('>' || cards, '') AS headings,
          'All types>' || p_type || CASE WHEN p_size % 2 = 0 THEN '>' || p_brand ELSE '' END AS options,
          {_CARDS_MAX} AS max_cards, (1 + {PART_IMAGES})::BIGINT AS imgs FROM part LEFT JOIN c USING (p_partkey)""",
)
def page_sections(spark, sf):
    return _sections(spark, sf).select(
        "page_id", F.array_join("headings", ">").alias("headings"), F.array_join("facet_options", ">").alias("options"), "max_cards", "imgs"
    )


@query(
    "q92_section_gate_pages",
    f"""SELECT p_partkey AS page_id, (p_partkey % 2 = 0 AND {_CARDS_MAX} >= 3 AND (2 + (p_size % 5 = 0)::INT) < {_CARDS_MAX} * 0.5)::INT AS fails, 0 AS warns FROM part""",
)
def section_gate_pages(spark, sf):
    gate = audit.section_gate(_sections(spark, sf), _sections(spark, sf, F.col("page_id") % 2 == 0), "page_id")
    return gate.select("page_id", F.size("fails").alias("fails"), F.size("warns").alias("warns"))


@query(
    "q93_structure_gate",
    f"""SELECT p_partkey AS page_id, (1 + {PART_CARDS})::BIGINT AS ref_cards, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 1 ELSE 1 + {PART_CARDS} END::BIGINT AS local_cards,
          CASE WHEN 1 + {PART_CARDS} >= 4 AND CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 1 ELSE 1 + {PART_CARDS} END * 2 < 1 + {PART_CARDS} THEN 'fail' ELSE 'pass' END AS status FROM part""",
)
def structure_gate(spark, sf):
    site = part_pages(spark, sf)
    plain = F.replace("html", F.lit('class="card col"'), F.lit("id=x"))
    local = site.where("page_id % 5 <> 0").withColumn("html", F.when(F.col("page_id") % 2 == 0, plain).otherwise(F.col("html")))
    ref, mine = (fingerprint.structure_signals(dom.dom_nodes(d, keep=("page_id",))) for d in (site, local))
    return audit.structure_gate(ref, mine, "page_id")


@query(
    "q94_article_pipeline",
    f"""WITH d AS (SELECT '/contents/' || lower(p_type) || '/p' || p_partkey AS node_path, p_name || ' ' || p_brand AS title, p_partkey FROM part WHERE p_partkey % 6 <> 5),
        e AS (SELECT '/contents/' || lower(p_type) || '/p' || p_partkey AS node_path, p_name || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' ' || p_brand END AS title FROM part WHERE p_partkey % 3 = 0)
        SELECT coalesce(d.node_path, e.node_path) AS node_path, coalesce(d.title, e.title) AS title,
          CASE WHEN e.node_path IS NULL THEN 'create' WHEN d.node_path IS NULL THEN 'orphan' WHEN d.title <> e.title THEN 'update' ELSE 'unchanged' END AS action
        FROM d FULL JOIN e ON d.node_path = e.node_path""",
)
def article_pipeline(spark, sf):
    """Leaf slug -> path of the site map -> folder by prefix -> core -> hero image -> node -> upsert."""
    part = table(spark, sf, "part").withColumn("page", F.concat(F.lit("p"), _s("p_partkey")))
    leaf = part.where("p_partkey % 6 <> 5").select("page", F.concat(F.lower("p_type"), F.lit("/articles/"), "page").alias("path"))
    folders = part.select(F.lower("p_type").alias("folder")).distinct().withColumn("ord", F.xxhash64("folder"))
    placed = prefix_classify(leaf, "path", folders.withColumn("prefix", F.concat("folder", F.lit("/articles"))), "prefix", "folder", "ord")
    core = article.article_core(part_instances(spark, sf), {"title": "titre", "publishDate": "date"}, body_types=("rich-text",), key="page")
    places = folders.select("folder", F.concat(F.lit("/contents/"), "folder").alias("path"), F.concat(F.lit("ns:"), "folder").alias("type"))
    file = F.concat(_s("p_partkey"), F.lit(".jpg"))
    imported = part.select("page", F.lit(0).alias("seq"), file.alias("file"), F.concat(F.lit("/dam/"), file).alias("target_path"))
    desired = article.article_plan(core.join(placed.select("page", "folder"), "page"), places, imported).select("node_path", "title")
    node = F.concat(F.lit("/contents/"), F.lower("p_type"), F.lit("/"), "page").alias("node_path")
    old = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), "p_brand")).alias("title")
    plan = upsert.upsert_plan(desired, part.where("p_partkey % 3 = 0").select(node, old), ["node_path"], ["title"])
    return plan.select("node_path", "title", "action")


@query(
    "q95_property_lists",
    """WITH p AS (SELECT p_brand AS node_type, p_partkey AS ord, p_name || '-' || p_partkey AS name, p_size % 3 = 0 AS m, p_size % 2 AS t FROM part WHERE p_partkey % 9 <> 0)
        SELECT node_type, string_agg(name, ',' ORDER BY NOT m, ord) AS names, coalesce(string_agg(name, ',' ORDER BY NOT m, ord) FILTER (t = 0), '') AS text,
          coalesce(string_agg(name, ',' ORDER BY NOT m, ord) FILTER (t = 1), '') AS weakref FROM p GROUP BY node_type""",
)
def property_lists(spark, sf):
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("j:"), "p_name")).otherwise(F.concat("p_name", F.lit("-"), _s("p_partkey")))
    declared = table(spark, sf, "part").select(
        F.col("p_brand").alias("node_type"), F.col("p_partkey").alias("ord"), name.alias("name"),
        F.when(F.col("p_size") % 2 == 0, "String").otherwise("WeakReference").alias("ptype"), (F.col("p_size") % 3 == 0).alias("mandatory"),
    )
    return load.property_lists(declared).select("node_type", *[F.array_join(c, ",").alias(c) for c in ("names", "text", "weakref")])


@query(
    "q95_area_plan",
    "SELECT '/home/footer' AS area, 'ns:footer' AS node_type, count(*) AS instances, min('p' || p_partkey) AS first_page FROM part HAVING count(*) > 0",
)
def area_plan(spark, sf):
    return load.area_plan(part_instances(spark, sf), _manifest(spark, sf))


@query(
    "q96_translation_coverage",
    f"""WITH {_NODES}, n AS (SELECT count(*) FILTER (c_custkey % 2 = 0 OR c_custkey % 8 <> 0) AS total, count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 8 = 0) AS gap FROM cust)
        SELECT total, gap, CASE WHEN gap > total * 0.2 THEN 'fail' WHEN gap > 0 THEN 'note' ELSE 'ok' END AS status FROM n""",
)
def translation_coverage(spark, sf):
    return coverage.translation_coverage(_gate_nodes(spark, sf), "fr", "en")


@query(
    "q96_image_references",
    f"WITH {_NODES} SELECT count(*) + 2 AS nodes, (count(*) FILTER (c_custkey % 10 = 0))::BIGINT AS references FROM cust",
)
def image_references(spark, sf):
    return coverage.image_references(_gate_nodes(spark, sf))


@query(
    "q97_type_baseline",
    f"""WITH {_INST}, f AS (SELECT DISTINCT type FROM inst WHERE type <> 'card'), d AS (SELECT DISTINCT lower(p_type) AS type FROM part UNION SELECT 'title')
        SELECT type, f.type IS NOT NULL AS found, d.type IS NOT NULL AS declared FROM f FULL JOIN d USING (type)""",
)
def type_baseline(spark, sf):
    found = components.source_components(part_dom(spark, sf)).select("type")
    declared = table(spark, sf, "part").select(F.explode(F.array(F.lower("p_type"), F.lit("title"))).alias("type"))
    folder = _folder(spark, "types")
    base = coverage.type_baseline(found, declared)
    sinks.write_type_baseline(base, folder)
    return spark.read.text(folder).withColumnRenamed("value", "type").join(base, "type")


@query(
    "q97_media_manifest",
    f"WITH {_MEDIA} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS seq, file, role FROM m",
)
def media_manifest(spark, sf):
    folder = _folder(spark, "media")
    sinks.write_media_manifest(media.media_refs(part_dom(spark, sf)), folder, "page_id")
    item = "page_id bigint, media array<struct<seq int, src string, file string, role string, alt string>>"
    return spark.read.schema(item).json(folder).select("page_id", F.inline("media")).select("page_id", "seq", "file", "role")


@query(
    "q97_content_folders",
    "SELECT source AS host, doc_id, text, 'p' || doc_id AS page FROM documents",
)
def content_folders(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("host"), "doc_id", "text", F.concat(F.lit("p"), _s("doc_id")).alias("page"))
    content, imported, mapped = (_folder(spark, n) for n in ("content", "imported", "folders"))
    sinks.write_content(rows.select("host", "doc_id", "text"), content)
    sinks.write_import_result(rows.select("doc_id", "page"), imported)
    sinks.write_folder_map(rows.select("doc_id", "host"), mapped)
    back = spark.read.schema("doc_id bigint, host string").json(mapped)
    return spark.read.parquet(content).join(spark.read.parquet(imported), "doc_id").join(back, ["doc_id", "host"]).select("host", "doc_id", "text", "page")


@query(
    "q97_punch_report",
    """WITH a AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'THIN' ELSE 'MISSING' END AS class, doc_id FROM documents)
        SELECT value FROM (SELECT '# Audit' AS value UNION ALL SELECT '- pages: ' || count(*) FROM a UNION ALL SELECT '- ' || class || ': ' || count(*) FROM a GROUP BY class)""",
)
def punch_report(spark, sf):
    cls = F.expr("CASE doc_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'THIN' ELSE 'MISSING' END")
    folder = _folder(spark, "report")
    sinks.write_report(audit.punch_summary(table(spark, sf, "documents").select(cls.alias("class"), "doc_id")), folder, ["# Audit"], ("rank", "value"))
    return spark.read.text(folder)


@query(
    "q97_read_lines",
    """SELECT trim(p_name) || '/' || p_partkey AS path, p_partkey AS nth FROM part""",
)
def read_lines(spark, sf):
    folder = _folder(spark, "lines")
    lines = table(spark, sf, "part").select("p_partkey", F.explode(F.array(F.concat(F.lit("  "), F.trim("p_name"), F.lit("/"), _s("p_partkey"), F.lit("\r")), F.lit(" "))).alias("value"))
    lines.select("value").write.text(folder)
    found = lists.path_list(lists.read_lines(spark, folder))
    return found.select("path", F.substring_index("path", "/", -1).cast("bigint").alias("nth"))


@query(
    "q97_captured_pages",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'curated ' || doc_id ELSE 'crawled ' || doc_id END AS html, CASE WHEN doc_id % 3 <> 0 THEN 'https://h.example/s' || doc_id END AS url FROM documents""",
)
def captured_pages(spark, sf):
    """Captures as files, a third of them curated too, with undecodable bytes in between."""
    one, two = _folder(spark, "curated"), f"{_folder(spark, 'crawl')}/site"
    k = table(spark, sf, "documents").select("doc_id")
    bad = F.unhex(F.lit("FF"))

    def stored(rows, word, folder):
        # one binary value per capture, as a file store would hold them
        rows.select("doc_id", F.concat(F.lit(word).cast("binary"), bad, _s("doc_id").cast("binary")).alias("content")).write.parquet(folder)
        back = spark.read.parquet(folder)
        return back.select(F.concat(F.lit("s"), _s("doc_id")).alias("slug"), captured.lenient_text(F.col("content")).alias("html"))

    curated = stored(k.where("doc_id % 3 = 0"), "curated ", one).withColumn("url", F.lit(None).cast("string"))
    crawled = stored(k, "crawled ", two).withColumn("url", F.concat(F.lit("https://h.example/"), "slug"))
    both = captured.merge_captures(curated, crawled)
    return both.select(F.substr("slug", F.lit(2)).cast("bigint").alias("doc_id"), "html", "url")


@query(
    "q97_token_sheet",
    f"""WITH {_TOKENS}, {_FONTS} SELECT ':root {{' AS value UNION ALL SELECT '}}' UNION ALL SELECT '  ' || CASE n WHEN 1 THEN '--font-body' ELSE '--font-heading' END || ': ' || stack || ';' FROM fonts
        UNION ALL SELECT CASE WHEN token SIMILAR TO '--color-[a-z]+' THEN '  ' || token || ': ' || value || ';' ELSE '  ' || token || ': ' || value || '; /* used ' || uses || 'x */' END FROM colors""",
)
def token_sheet(spark, sf):
    sheets = _sheets(spark, sf)
    return tokens.stylesheet(tokens.color_tokens(sheets), tokens.font_tokens(sheets)).select("value")


@query(
    "q98_image_kinds",
    """SELECT p_partkey AS page_id, 2::BIGINT + p_size % 2 AS imgs, 1::BIGINT AS img_real, 1::BIGINT AS img_fallback, (p_size % 2)::BIGINT AS img_empty, 'Part ’ ' || p_partkey AS h2,
          length('Part ’ ' || p_partkey || ' ' || p_name)::BIGINT AS text_len FROM part""",
)
def image_kinds(spark, sf):
    html = F.format_string(
        '<main><h2>Part &#8217; %d</h2> <img src="/files/%d.png"><img src="/static/x.png">%s%s</main>', "p_partkey", "p_partkey",
        F.when(F.col("p_size") % 2 == 1, '<img alt="x">').otherwise(""), F.col("p_name"),
    )
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    found = fingerprint.fingerprint(rows)
    return found.select(
        "page_id", *[F.col(c).cast("bigint").alias(c) for c in ("imgs", "img_real", "img_fallback", "img_empty", "text_len")],
        F.array_join("h2", "|").alias("h2"),
    )


@query(
    "q98_seo_pages",
    """SELECT p_partkey AS page_id, (p_size % 4 <> 0)::INT::BIGINT AS descriptions, 2::BIGINT AS images, (p_size % 3 = 0)::INT::BIGINT AS images_without_alt FROM part""",
)
def seo_pages(spark, sf):
    described = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit('<META NAME="Description" content="'), "p_name", F.lit('">'))).otherwise('<meta name=description content=" ">')
    alt = F.when(F.col("p_size") % 3 == 0, ' alt=" "').otherwise(" alt=x")
    html = F.concat(described, F.lit("<h1>x</h1><img alt='y' src=/a.png><img src=/b.png"), alt, F.lit(">"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    return fingerprint.seo_baseline(dom.dom_nodes(rows)).select("page_id", "descriptions", "images", "images_without_alt")


@query(
    "q98_active_items",
    f"""WITH {_NODES} SELECT c_custkey, p.nation_path AS item, starts_with(cust.path, p.nation_path || '/') AS active
        FROM cust JOIN places p ON cust.c_custkey % 25 = p.n_nationkey""",
)
def active_items(spark, sf):
    c = customer_nodes(spark, sf)
    from .tables import places

    items = places(spark, sf).select("n_nationkey", F.col("nation_path").alias("item"))
    rows = c.select("c_custkey", "path", (F.col("c_custkey") % 25).cast("int").alias("n_nationkey")).join(items, "n_nationkey")
    return rows.select("c_custkey", "item", tree.is_active(F.col("item"), F.col("path")).alias("active"))


@query(
    "q98_children",
    f"WITH {_NODES} SELECT path FROM cust WHERE n_nationkey = 3 AND c_mktsegment = 'BUILDING'",
)
def children(spark, sf):
    from .tables import places

    home = places(spark, sf).where("n_nationkey = 3").select("nation_path").first()[0]
    return tree.children(customer_nodes(spark, sf), home, F.col("c_mktsegment") == "BUILDING").select("path")


@query(
    "q98_value_fallbacks",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Order ' || o_orderkey WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE o_orderpriority END AS shown,
          CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS label FROM orders""",
)
def value_fallbacks(spark, sf):
    k = F.col("o_orderkey")
    title = F.when(k % 3 == 0, F.concat(F.lit("Order "), _s("o_orderkey"))).when(k % 3 == 1, "")
    name = F.when(k % 3 == 1, F.col("o_orderstatus")).otherwise("")
    return table(spark, sf, "orders").select(
        "o_orderkey", text.first_filled(title, name, F.col("o_orderpriority")).alias("shown"),
        text.label_or_self(F.col("o_orderstatus"), {"O": "open", "F": "done"}).alias("label"),
    )


@query(
    "q98_heading_sets",
    """WITH l AS (SELECT doc_id, list_distinct(string_split(text, chr(10))) AS mine FROM documents)
        SELECT doc_id, len(list_filter(mine, lambda x: x[1] = 'T'))::BIGINT AS missing FROM l""",
)
def heading_sets(spark, sf):
    mine = F.split("text", "\n")
    lacking = audit.heading_set_missing(mine, F.filter(mine, lambda x: ~x.startswith("T")))
    return table(spark, sf, "documents").select("doc_id", F.size(lacking).cast("bigint").alias("missing"))


@query(
    "q98_media_totals",
    f"WITH {_MEDIA} SELECT count(DISTINCT page_id) AS pages, count(*) AS refs, count(DISTINCT ref) AS distinct_srcs FROM m",
)
def media_totals(spark, sf):
    return media.media_totals(media.media_refs(part_dom(spark, sf)))


@query(
    "q98_facet_attributes",
    """SELECT p_type, CASE WHEN contains(lower(p_type), 'type') THEN 'type' ELSE regexp_replace(lower(p_type), '[^a-z0-9]', '-', 'g') END AS attr, count(*) AS n FROM part GROUP BY p_type""",
)
def facet_attributes(spark, sf):
    counted = table(spark, sf, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("p_type", listing.facet_attribute(F.col("p_type")).alias("attr"), "n")


@query(
    "q84_write_tally",
    """SELECT count(*) AS total, count(*) FILTER (o_orderkey % 9 <> 0 AND o_totalprice >= 20000) AS ok, count(*) FILTER (o_orderkey % 9 <> 0 AND o_totalprice < 20000) AS failed,
          count(*) FILTER (o_orderkey % 9 = 0) AS skipped, round(sum(o_totalprice)) AS value FROM orders""",
)
def write_tally(spark, sf):
    """The tallies of a run, taken while its rows are written: no second pass over them."""
    status = F.when(F.col("o_orderkey") % 9 == 0, "skipped").when(F.col("o_totalprice") < 20000, "failed").otherwise("ok")
    rows = table(spark, sf, "orders").withColumn("status", status)
    got = sinks.write_observed(rows, _folder(spark, "run"), **sinks.run_metrics(), value=F.round(F.sum("o_totalprice")))
    return spark.createDataFrame([got], "total bigint, ok bigint, failed bigint, skipped bigint, value double")


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(
    "q98_page_sample",
    f"""SELECT {_HOST} AS host, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY {_HOST} ORDER BY md5(page_id::VARCHAR), page_id) <= 8""",
)
def page_sample(spark, sf):
    """Eight pages of every site, those of least hash: the same for any partitioning."""
    p = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"), "page_id")
    return captured.sample_pages(p.repartition(7), ["host"], "page_id", 8)


@query(
    "q96_sampled_translations",
    f"""WITH {_NODES}, t AS (SELECT *, c_custkey % 2 = 0 AND c_custkey % 8 = 0 AS gap FROM cust WHERE c_custkey % 2 = 0 OR c_custkey % 8 <> 0),
        s AS (SELECT * FROM t QUALIFY row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey) <= 60),
        n AS (SELECT 'all' AS rows, count(*) AS total, count(*) FILTER (gap) AS gap FROM t UNION ALL SELECT 'sample', count(*), count(*) FILTER (gap) FROM s)
        SELECT rows, total, gap, CASE WHEN gap > total * 0.2 THEN 'fail' WHEN gap > 0 THEN 'note' ELSE 'ok' END AS status FROM n""",
)
def sampled_translations(spark, sf):
    """The gate over all titled nodes, and over sixty of them as the short probe takes it."""
    k = F.col("c_custkey")
    titles = F.map_filter(
        F.create_map(F.lit("fr"), F.when(k % 2 == 0, "t"), F.lit("en"), F.when(k % 8 != 0, "t")), lambda _, v: v.isNotNull()
    )
    nodes = customer_nodes(spark, sf).select("c_custkey", titles.alias("titles"))
    return coverage.sampled_translation_coverage(nodes, "fr", "en", "c_custkey", 60)


@query(
    "q97_capture_tree",
    """WITH c AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'curated' ELSE 'crawled' END AS src, html FROM pages)
        SELECT 'p' || page_id AS slug, CASE WHEN src = 'crawled' THEN 'https://h.example/p' || page_id END AS url, md5(CASE WHEN src = 'curated' THEN 'curated ' ELSE '' END || html) AS digest FROM c""",
)
def capture_tree(spark, sf):
    """Pages written as capture files, a third of them curated too, and read back by the data source."""
    root = _folder(spark, "tree").removeprefix("file:")
    p = table(spark, sf, "pages").select(F.concat(F.lit("p"), _s("page_id")).alias("slug"), "html", "page_id")
    captures.write_captures(p.select(F.concat(F.lit("h.example/"), "slug", F.lit(".html")).alias("file"), "html"), f"{root}/crawl")
    curated = p.where("page_id % 3 = 0").select(F.concat("slug", F.lit(".html")).alias("file"), F.concat(F.lit("curated "), "html").alias("html"))
    captures.write_captures(curated, f"{root}/curated")
    found = captures.captures(spark, f"{root}/curated", f"{root}/crawl")
    return found.select("slug", "url", F.md5("html").alias("digest"))


@query(
    "q97_capture_stream",
    """SELECT 'p' || page_id || '.html' AS file, length(html) AS n_chars FROM pages WHERE page_id % 2 = 0""",
)
def capture_stream(spark, sf):
    """The same files as a stream of two runs: what arrives between them follows, nothing comes twice."""
    root = _folder(spark, "stream").removeprefix("file:")
    p = table(spark, sf, "pages").where("page_id % 2 = 0").select(F.concat(F.lit("p"), _s("page_id"), F.lit(".html")).alias("file"), "html", "page_id")
    for part in (0, 2):
        captures.write_captures(p.where(F.col("page_id") % 4 == part), f"{root}/in")
        found = captures.capture_stream(spark, f"{root}/in").select("file", F.length("html").cast("bigint").alias("n_chars"))
        run = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(
    "q98_reference_fallbacks",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'line ' || l_linenumber WHEN p_size > 10 THEN p_name ELSE l_shipmode END AS title,
          CASE WHEN p_size > 10 THEN p_brand ELSE '-' END AS subtitle FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey""",
)
def reference_fallbacks(spark, sf):
    """A card's own title, else that of what it refers to, else a general one; some references do not resolve."""
    own = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("line "), _s("l_linenumber"))).otherwise("")
    cards = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", own.alias("own"), F.concat("l_returnflag", "l_linestatus").alias("mode"))
    targets = table(spark, sf, "part").where("p_size > 10")
    found = tree.filled_or_referenced(cards, "l_partkey", targets, "p_partkey", {"title": ["own", "ref.p_name", "mode"], "subtitle": ["ref.p_brand", F.lit("-")]})
    return found.select("l_orderkey", "l_linenumber", "title", "subtitle")


@query(
    "q98_facet_specs",
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type || '|' || p_brand WHEN 1 THEN p_type ELSE 'My Theme|' || p_name || '|x' END AS spec FROM part)
        SELECT p_partkey, split_part(spec, '|', 1) AS field, CASE WHEN contains(spec, '|') THEN split_part(spec, '|', 2) ELSE spec END AS label,
          CASE WHEN contains(lower(split_part(spec, '|', 1)), 'theme') THEN 'theme' WHEN contains(lower(split_part(spec, '|', 1)), 'type') THEN 'type'
            ELSE regexp_replace(lower(split_part(spec, '|', 1)), '[^a-z0-9]', '-', 'g') END AS attr FROM s""",
)
def facet_specs(spark, sf):
    k = F.col("p_partkey") % 3
    spec = F.when(k == 0, F.concat_ws("|", "p_type", "p_brand")).when(k == 1, F.col("p_type")).otherwise(F.concat(F.lit("My Theme|"), "p_name", F.lit("|x")))
    return table(spark, sf, "part").select("p_partkey", listing.facet_spec(spec).alias("f")).select("p_partkey", "f.*")


@query(
    "q65_fingerprint_maps",
    """SELECT 'p' || p_partkey AS page, p_size AS t, p_size % 4 AS i FROM part""",
)
def fingerprint_maps(spark, sf):
    """Fingerprint files, one page-keyed dictionary per brand, read back as rows."""
    folder = _folder(spark, "fingerprints")
    entry = F.struct(F.concat(F.lit("p"), _s("p_partkey")), F.struct(F.col("p_size").alias("t"), (F.col("p_size") % 4).alias("i")))
    part = table(spark, sf, "part")
    # a file holds a hundred pages, as one site's would
    part.groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.map_from_entries(F.collect_list(entry)).alias("pages")).select("pages").write.json(folder)
    doc = spark.read.schema("pages map<string, struct<t: int, i: int>>").json(folder)
    return manifests.fingerprints(doc)


@query(
    "q98_joined_fragments",
    "SELECT doc_id, md5(array_to_string(string_split(text, chr(10)), '')) AS body FROM documents",
)
def joined_fragments(spark, sf):
    """Bodies given as fragments, joined without anything between."""
    return table(spark, sf, "documents").select("doc_id", F.md5(text.join_fragments(F.split("text", "\n"))).alias("body"))


@query(
    "q27_audit_notes",
    f"""WITH {_AUDIT}, x AS (SELECT *, printf('%.2f', CASE WHEN ref_text = 0 THEN 99 ELSE local_text / ref_text END) AS r FROM a)
        SELECT page, CASE class WHEN 'N/A' THEN 'no reference fingerprint captured' WHEN 'N/A-REF' THEN 'reference page errors' WHEN 'N/A-NEW' THEN 'new section, no reference'
          WHEN 'FABRICATED' THEN 'reference is nearly empty (' || ref_text || ' chars); local has ' || local_text || ' chars'
          WHEN 'STUB' THEN 'thin stub: ' || local_text || ' vs ' || ref_text || ' chars (x' || r || ')'
          WHEN 'THIN' THEN 'thinner than reference: ' || local_text || ' vs ' || ref_text || ' chars (x' || r || ')'
          WHEN 'MISSING-IMG' THEN 'reference has ' || ref_imgs || ' images, local has ' || local_imgs
          WHEN 'OK' THEN 'comparable (' || local_text || ' vs ' || ref_text || ' chars, ' || local_imgs || ' vs ' || ref_imgs || ' images)'
          ELSE local_text || ' vs ' || ref_text || ' chars (x' || r || '), ' || local_imgs || ' vs ' || ref_imgs || ' images' END AS note FROM x""",
)
def audit_notes(spark, sf):
    """What the punch list says of each page, word for word."""
    return audit.audit_pages(*_fingerprints(spark, sf), "new/").select("page", "note")
