"""Queries over the content tree and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing as ls
from ..operators import tree
from ..operators.coverage import with_category_name
from ..operators.joins import skew_join
from ..session import cut_lineage
from . import query
from .tables import customer_nodes, order_nodes, places, table

_NODES = """places AS (SELECT n_nationkey, n_name, r_regionkey, r_name, '/home/' || r_name AS region_path,
        '/home/' || r_name || '/' || n_name AS nation_path FROM nation JOIN region ON n_regionkey = r_regionkey),
      cust AS (SELECT c_custkey, nation_path || '/' || c_custkey AS path, nation_path AS parent_path, c_name AS title,
        c_mktsegment, c_acctbal, n_name, r_name, n_nationkey FROM customer JOIN places ON c_nationkey = n_nationkey),
      ord AS (SELECT orders.*, path || '/' || o_orderkey AS path, c_mktsegment FROM orders JOIN cust ON o_custkey = c_custkey)"""


@query(
    "q10_listing_top",
    f"""WITH {_NODES} SELECT path, c_mktsegment, round(o_totalprice, 2) AS o_totalprice FROM ord
        WHERE path LIKE '/home/ASIA/%' AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY o_totalprice DESC, path LIMIT 20""",
)
def listing_top(spark, sf):
    rows = ls.listing(
        order_nodes(spark, sf), root="/home/ASIA", criteria="o_totalprice", limit=20, categories=["BUILDING", None, "MACHINERY"]
    )
    return rows.select("path", "c_mktsegment", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(
    "q11_listing_exclude",
    f"""WITH {_NODES} SELECT path, c_custkey, title FROM cust WHERE path LIKE '/home/EUROPE/%'
        AND c_custkey NOT IN (SELECT c_custkey FROM cust WHERE c_custkey IN (3, 7, 11, 19, 42)) """,
)
def listing_exclude(spark, sf):
    rows = ls.listing(
        customer_nodes(spark, sf), root="/home/EUROPE", criteria="c_acctbal", direction="asc", exclude=["3", "7", None, "11", "19", "42"]
    )
    return rows.select("path", "c_custkey", "title")


@query(
    "q12_listing_pages",
    f"""WITH {_NODES}, f AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER () AS n
          FROM ord WHERE c_mktsegment = 'BUILDING')
        SELECT o_orderkey, rn, (rn - 1) // 6 AS page_no, greatest(n - ((rn - 1) // 6 + 1) * 6, 0) AS remaining,
          greatest(1, ceil(n / 6.0))::BIGINT AS page_count FROM f""",
)
def listing_pages(spark, sf):
    nodes = order_nodes(spark, sf).select("o_orderkey", "o_totalprice", "c_mktsegment")
    paged = ls.paginate(nodes, [F.col("o_totalprice").desc(), "o_orderkey"], 6, F.col("c_mktsegment") == "BUILDING")
    total = paged.agg(ls.page_count(F.count(F.lit(1)), 6).alias("page_count"))  # one row
    return paged.select("o_orderkey", "rn", "page_no", "remaining").crossJoin(F.broadcast(total))


@query(
    "q13_featured_slots",
    """SELECT o_orderkey, rn, CASE WHEN rn = 1 THEN 'featured' ELSE 'compact' END AS slot FROM
        (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rn FROM orders) WHERE rn <= 3""",
)
def featured_slots(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = ls.slots(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], ["featured", "compact", "compact"])
    return out.select("o_orderkey", "rn", "slot")


@query(
    "q14_facet_counts",
    f"""WITH {_NODES}, r AS (SELECT * FROM ord WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'),
        f AS (SELECT 'status' AS attr, o_orderstatus AS value, o_orderkey AS o, o_orderstatus AS label FROM r
              UNION ALL SELECT 'priority', o_orderpriority, o_orderkey, split_part(o_orderpriority, '-', 2) || ' ' || (o_orderkey % 3) FROM r)
        SELECT attr, value, arg_min(label, o) AS label, count(*) AS n FROM f GROUP BY attr, value""",
)
def facet_counts(spark, sf):
    label = F.concat(F.substring_index("o_orderpriority", "-", -1), F.lit(" "), (F.col("o_orderkey") % 3).cast("string"))
    nodes = order_nodes(spark, sf).withColumn("p_label", label)
    kept = ls.apply_facets(nodes, {"categories": "BUILDING", "o_orderstatus": "F", "o_orderpriority": ""})
    return ls.facets(kept, {"status": ("o_orderstatus", "o_orderstatus"), "priority": ("o_orderpriority", "p_label")}, "o_orderkey")


_CAT = "CASE WHEN c_acctbal < 500 THEN NULL ELSE c_mktsegment END"


@query(
    "q15_category_groups",
    f"""SELECT coalesce({_CAT}, '') AS category, count(*) AS n, arg_min(c_custkey, struct_pack(a := -c_acctbal, b := c_custkey)) AS first_member
        FROM customer GROUP BY 1""",
)
def category_groups(spark, sf):
    rows = table(spark, sf, "customer").withColumn("category", F.expr(_CAT))
    out = ls.group_by_category(rows, "category", [-F.col("c_acctbal"), "c_custkey"], ["c_custkey"])
    return out.select("category", "n", F.col("c_custkey").alias("first_member"))


@query(
    "q15_category_members",
    f"""SELECT coalesce({_CAT}, '') AS category, row_number() OVER (PARTITION BY coalesce({_CAT}, '') ORDER BY -c_acctbal, c_custkey) AS position, c_custkey
        FROM customer""",
)
def category_members(spark, sf):
    rows = table(spark, sf, "customer").withColumn("category", F.expr(_CAT))
    return ls.category_members(rows, "category", [-F.col("c_acctbal"), "c_custkey"], ["c_custkey"])


@query(
    "q15_available_categories",
    f"""WITH {_NODES} SELECT c_mktsegment AS category, 'Segment ' || lower(c_mktsegment) AS name, min(c_custkey) AS first_seen
        FROM cust WHERE path LIKE '/home/AFRICA/%' GROUP BY c_mktsegment""",
)
def available_categories(spark, sf):
    rows = ls.listing(customer_nodes(spark, sf), root="/home/AFRICA", criteria="c_custkey", direction="asc")
    names = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("category_uuid")).distinct().withColumn(
        "name", F.concat(F.lit("Segment "), F.lower("category_uuid"))
    )
    found = ls.available_categories(rows, "c_custkey", names=names)
    first = rows.groupBy(F.col("c_mktsegment").alias("category")).agg(F.min("c_custkey").alias("first_seen"))
    return found.join(first, "category")


@query(
    "q15_present_categories",
    """SELECT DISTINCT c_mktsegment AS category, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'HOUSEHOLD' THEN 4 END AS place
        FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING', 'HOUSEHOLD')""",
)
def present_categories(spark, sf):
    rows = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "category")
    return ls.present_categories(rows, "category", ["MACHINERY", "BUILDING", "TOYS", "HOUSEHOLD"])


def _tree(spark, sf):
    """Regions, nations and customers as one page tree."""
    p = places(spark, sf)
    regions = p.select(F.col("region_path").alias("path"), F.col("r_name").alias("title"), F.col("r_name").alias("name")).distinct()
    nations = p.select(F.col("nation_path").alias("path"), F.lit("").alias("title"), F.col("n_name").alias("name"))
    customers = customer_nodes(spark, sf).select("path", "title", "name")
    return regions.unionByName(nations).unionByName(customers)


@query(
    "q16_breadcrumbs",
    f"""WITH {_NODES}, pg AS (SELECT DISTINCT region_path AS path, r_name AS title FROM places
          UNION ALL SELECT nation_path, n_name FROM places UNION ALL SELECT path, title FROM cust)
        SELECT a.path, len(string_split(b.path, '/')) - 2 AS depth, b.path AS crumb_path, b.title AS crumb_title
        FROM pg a JOIN pg b ON a.path = b.path OR starts_with(a.path, b.path || '/')""",
)
def breadcrumbs(spark, sf):
    out = tree.breadcrumbs(cut_lineage(_tree(spark, sf), "tree"), "/home")
    return out.select("path", F.col("depth").cast("bigint").alias("depth"), "crumb_path", "crumb_title")


@query(
    "q17_nav_tree",
    """WITH s AS (SELECT * FROM supplier WHERE s_acctbal > 0)
        SELECT r_name AS title_1, n_name AS title_2, s_name AS title_3, 1 + (n_name IS NOT NULL)::INT + (s_name IS NOT NULL)::INT AS level,
          n_name = 'NATION_3' AND s_name IS NULL AS active
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 6 <> 0 LEFT JOIN s ON s_nationkey = n_nationkey""",
)
def nav_tree(spark, sf):
    p = places(spark, sf)
    s = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    t = "primary_type"
    regions = p.select(
        F.lit("/home").alias("parent_path"), F.col("region_path").alias("path"), F.col("r_name").alias("title"),
        F.col("r_regionkey").cast("bigint").alias("ord"), F.lit("page").alias(t),
    ).distinct()
    nations = p.select(
        F.col("region_path").alias("parent_path"), F.col("nation_path").alias("path"), F.col("n_name").alias("title"),
        F.col("n_nationkey").cast("bigint").alias("ord"), F.when(F.col("n_nationkey") % 6 == 0, "menu").otherwise("page").alias(t),
    )
    leaves = skew_join(s, p, ["n_nationkey"], "inner").select(
        F.col("nation_path").alias("parent_path"), F.concat("nation_path", F.lit("/"), F.col("s_suppkey").cast("string")).alias("path"),
        F.col("s_name").alias("title"), F.col("s_suppkey").alias("ord"), F.when(F.col("s_acctbal") > 0, "link").otherwise("text").alias(t),
    )
    edges = spark.createDataFrame(
        [("page", "navMenuItem"), ("link", "navMenuItem"), ("menu", "navMenu"), ("navMenu", "navMenuItem"), ("text", "content")],
        "name string, supertype string",
    )
    items = tree.nav_items(regions.unionByName(nations).unionByName(leaves), tree.type_closure(edges))
    items = cut_lineage(items, "nav-items")  # read once per level
    flat = tree.nav_tree(items, "/home")
    here = F.coalesce(F.col("title_2") == "NATION_3", F.lit(False)) & F.col("title_3").isNull()
    return flat.select("title_1", "title_2", "title_3", "level", here.alias("active"))


_EDGES = """edges AS (SELECT DISTINCT p_name AS name, p_type AS supertype FROM part
        UNION SELECT DISTINCT p_name, split_part(p_name, ' ', 2) FROM part
        UNION SELECT DISTINCT split_part(p_name, ' ', 2), 'Thing' FROM part
        UNION SELECT DISTINCT p_type, 'Product' FROM part UNION SELECT 'Thing', 'Product')"""


def _type_edges(spark, sf):
    part = table(spark, sf, "part")
    noun = F.split("p_name", " ")[1]
    pairs = F.array(
        F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("supertype")),
        F.struct(F.col("p_name").alias("name"), noun.alias("supertype")),
        F.struct(noun.alias("name"), F.lit("Thing").alias("supertype")),
        F.struct(F.col("p_type").alias("name"), F.lit("Product").alias("supertype")),
        F.struct(F.lit("Thing").alias("name"), F.lit("Product").alias("supertype")),
    )
    return part.select(F.inline(pairs)).distinct()


@query(
    "q18_type_closure",
    f"""WITH RECURSIVE {_EDGES}, names AS (SELECT name AS type FROM edges UNION SELECT supertype FROM edges),
        up AS (SELECT type, type AS ancestor, 0 AS depth FROM names
               UNION SELECT up.type, e.supertype, up.depth + 1 FROM up JOIN edges e ON e.name = up.ancestor WHERE up.depth < 20),
        c AS (SELECT type, ancestor, min(depth) AS depth FROM up GROUP BY type, ancestor),
        n AS (SELECT p_name AS type, count(*) AS parts FROM part GROUP BY p_name)
        SELECT c.type, ancestor, depth, coalesce(parts, 0) AS parts FROM c LEFT JOIN n ON n.type = c.type""",
)
def type_closure(spark, sf):
    closure = tree.type_closure(_type_edges(spark, sf))
    parts = table(spark, sf, "part").groupBy(F.col("p_name").alias("type")).agg(F.count(F.lit(1)).alias("parts"))
    return closure.join(parts, "type", "left").na.fill(0, ["parts"])


@query(
    "q61_type_counts",
    """SELECT p_name AS primary_type, count(*) AS n FROM part WHERE split_part(p_name, ' ', 2) = 'ring' GROUP BY p_name""",
)
def type_counts(spark, sf):
    nodes = table(spark, sf, "part").withColumnRenamed("p_name", "primary_type")
    return ls.type_counts(tree.of_type(nodes, tree.type_closure(_type_edges(spark, sf)), "ring"))


@query(
    "q62_node_children",
    f"""WITH {_NODES} SELECT path, title, c_custkey AS ord FROM cust WHERE parent_path = (SELECT nation_path FROM places WHERE n_nationkey = 4)
        AND c_mktsegment = 'BUILDING'""",
)
def node_children(spark, sf):
    nodes = customer_nodes(spark, sf)
    parent = places(spark, sf).where("n_nationkey = 4").select("nation_path").first()
    kids = tree.children(nodes, parent.nation_path, F.array_contains("categories", "BUILDING"))
    return kids.select("path", "title", F.col("c_custkey").alias("ord")).orderBy("ord")


@query(
    "q63_item_links",
    f"""WITH {_NODES}, i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_suppkey,
            CASE l_linenumber % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'nodeLink' WHEN 2 THEN 'externalLink' ELSE 'text' END AS kind FROM lineitem)
        SELECT l_orderkey, l_linenumber, kind, CASE kind WHEN 'page' THEN '/o/' || l_orderkey
            WHEN 'nodeLink' THEN coalesce('/p/' || p_partkey, '#') WHEN 'externalLink' THEN 'https://s.example/' || l_suppkey ELSE '#' END AS href,
          coalesce(p_name, 'line ' || l_linenumber) AS title
        FROM i LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey""",
)
def item_links(spark, sf):
    key = lambda c: F.col(c).cast("string")
    kind = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'nodeLink' WHEN 2 THEN 'externalLink' ELSE 'text' END")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"))
    targets = table(spark, sf, "part").where("p_size > 10").withColumn("_url", F.concat(F.lit("/p/"), key("p_partkey")))
    found = tree.resolve_refs(items, "l_partkey", targets, "p_partkey", {"_url": "target_url", "p_name": "target_title"}, skew=True)
    return found.select(
        "l_orderkey", "l_linenumber", "kind",
        tree.item_link(
            F.col("kind"), F.concat(F.lit("/o/"), key("l_orderkey")), F.col("target_url"), F.concat(F.lit("https://s.example/"), key("l_suppkey"))
        ).alias("href"),
        F.coalesce("target_title", F.concat(F.lit("line "), key("l_linenumber"))).alias("title"),
    )


@query(
    "q64_language_alternates",
    """SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, unnest(['de', 'en', 'es', 'fr']) AS alternate,
          regexp_extract(html, '<html lang="([a-z]+)"', 1) = unnest(['de', 'en', 'es', 'fr']) AS current FROM pages""",
)
def language_alternates(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))
    return tree.language_alternates(rows, ["de", "en", "es", "fr"])


@query(
    "q79_facet_columns",
    """WITH cats AS (SELECT p_partkey, p_name AS name, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'T ' || p_name END AS title,
              CASE p_partkey % 3 WHEN 0 THEN 'theme' WHEN 1 THEN 'kind' END AS branch FROM part),
        each AS (SELECT o_orderkey, unnest([0, 1, 2]) AS pos, (o_orderkey * 7 + unnest([0, 1, 2]) * (o_custkey + 1)) % ((SELECT count(*) FROM part) + 50) AS cat FROM orders),
        f AS (SELECT o_orderkey, pos, name, coalesce(nullif(title, ''), name) AS title, branch FROM each JOIN cats ON p_partkey = cat WHERE branch IS NOT NULL)
        SELECT o.o_orderkey, arg_max(name, pos) FILTER (branch = 'theme') AS theme_name, arg_max(title, pos) FILTER (branch = 'theme') AS theme_title,
          arg_max(name, pos) FILTER (branch = 'kind') AS kind_name, arg_max(title, pos) FILTER (branch = 'kind') AS kind_title
        FROM orders o LEFT JOIN f ON f.o_orderkey = o.o_orderkey GROUP BY o.o_orderkey""",
)
def facet_columns(spark, sf):
    part = table(spark, sf, "part")
    n = part.agg((F.count(F.lit(1)) + 50).alias("_n"))  # one row
    cats = part.select(
        F.col("p_partkey").alias("category_uuid"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("T "), "p_name")).alias("title"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN '/tax/themes/x' WHEN 1 THEN '/tax/kinds/x' ELSE '/tax/other/x' END").alias("path"),
    )
    picks = F.array(*[(F.col("o_orderkey") * 7 + F.lit(i) * (F.col("o_custkey") + 1)) % F.col("_n") for i in range(3)])
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").crossJoin(F.broadcast(n)).select("o_orderkey", picks.alias("categories"))
    out = ls.facet_columns(orders, cats, {"theme": "/themes/", "kind": "/kinds/"}, "o_orderkey")
    return out.drop("categories")


@query(
    "q80_folder_tree",
    f"""WITH {_NODES}, p AS (SELECT string_split(path[2:], '/') AS s FROM cust), e AS (SELECT s, unnest(generate_series(1, len(s))) AS d FROM p)
        SELECT DISTINCT '/' || array_to_string(s[:d], '/') AS folder, d::INT AS depth FROM e""",
)
def folder_tree(spark, sf):
    return tree.folder_tree(customer_nodes(spark, sf))


@query("q89_newest", f"WITH {_NODES} SELECT path FROM ord ORDER BY o_orderdate DESC, path LIMIT 3")
def newest(spark, sf):
    return ls.newest(order_nodes(spark, sf), "o_orderdate").select("path")


_MONTHS = "['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre']"


@query(
    "q45_dates",
    f"""WITH t AS (SELECT o_orderkey, o_orderdate, o_orderkey % 31 + 1 AS d, o_orderkey % 12 + 1 AS m, 2000 + o_orderkey % 25 AS y FROM orders)
        SELECT o_orderkey, y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') || 'T00:00:00.000' AS iso,
          strftime(try_strptime(d || '/' || m || '/' || y, '%d/%m/%Y'), '%Y-%m-%d') AS typed,
          strftime(o_orderdate, '%d ') || {_MONTHS}[month(o_orderdate)] || strftime(o_orderdate, ' %Y') AS long_fr,
          CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS short_fr,
          strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000' AS instant FROM t""",
)
def dates_query(spark, sf):
    from ..functions import dates

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey")
    shown = F.format_string("Le %d/%d/%d, hall 4", k % 31 + 1, k % 12 + 1, k % 25 + 2000)
    rows = table(spark, sf, "orders").select("o_orderkey", shown.alias("t"), day.alias("day"))
    return rows.select(
        "o_orderkey", dates.dmy_to_iso(F.col("t")).alias("iso"),
        F.date_format(dates.dmy_to_timestamp(F.col("t")), "yyyy-MM-dd").alias("typed"),
        dates.localized(F.col("day"), "fr").alias("long_fr"),
        dates.localized(F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.col("day")), "fr", "short").alias("short_fr"),
        dates.day_to_instant(F.col("day")).alias("instant"),
    )


@query(
    "q48_unpivot_figures",
    """WITH w AS (SELECT l_orderkey, l_linenumber, unnest([1, 2, 3, 4]) AS pos, unnest([l_quantity, l_extendedprice, nullif(l_discount, 0), nullif(l_tax, 0)]) AS v,
          unnest(['quantity', 'price', 'discount', 'tax']) AS label FROM lineitem)
        SELECT l_orderkey, l_linenumber, pos, label, round(v, 2) AS figure FROM w WHERE v IS NOT NULL""",
)
def unpivot_figures(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("f1"), F.lit("quantity").alias("l1"),
        F.col("l_extendedprice").alias("f2"), F.lit("price").alias("l2"),
        F.nullif("l_discount", F.lit(0.0)).alias("f3"), F.lit("discount").alias("l3"),
        F.nullif("l_tax", F.lit(0.0)).alias("f4"), F.lit("tax").alias("l4"),
    )
    flat = tree.wide_to_rows(rows, ["l_orderkey", "l_linenumber"], {i: (f"f{i}", f"l{i}") for i in range(1, 5)}, ("figure", "label"))
    return flat.select("l_orderkey", "l_linenumber", "pos", "label", F.round(F.col("figure").cast("double"), 2).alias("figure"))


@query(
    "q88_pricing_matrix",
    """WITH r AS (SELECT p_partkey, p_name, unnest([0, 1, 2]) AS i, unnest([p_brand, p_type, p_size::VARCHAR]) AS cell FROM part)
        SELECT p_partkey, p_name AS label, i AS pos, ['Brand', 'Type'][i + 1] AS header, cell FROM r""",
)
def pricing_matrix(spark, sf):
    headers = F.array(F.lit("Brand"), F.lit("Type"))
    cells = F.array("p_brand", "p_type", F.col("p_size").cast("string"))
    return tree.labelled_cells(table(spark, sf, "part").withColumnRenamed("p_name", "label"), ["p_partkey", "label"], cells, headers)


@query(
    "q88_pricing_table",
    """WITH c AS (SELECT p_type AS tbl, p_name || ' ' || p_partkey AS label, unnest(['Brand', 'Size', NULL]) AS header, unnest([0, 1, 2]) AS pos,
          unnest([p_brand, p_size::VARCHAR, CASE WHEN p_size % 2 = 0 THEN (p_size * 3)::VARCHAR END]) AS cell FROM part),
        k AS (SELECT tbl, label, coalesce(header, (pos + 1)::VARCHAR) AS name, pos, cell FROM c WHERE cell IS NOT NULL)
        SELECT tbl, label, string_agg(name || '=' || cell, ';' ORDER BY name) AS cells, string_agg(name, ',' ORDER BY pos) AS headers FROM k GROUP BY tbl, label""",
)
def pricing_table(spark, sf):
    """Tables whose rows have two or three cells; the third column has no header."""
    part = table(spark, sf, "part").select(
        F.col("p_type").alias("tbl"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("label"),
        F.array("p_brand", F.col("p_size").cast("string"), (F.col("p_size") * 3).cast("string")).alias("c"), (F.col("p_size") % 2 == 0).alias("priced"),
    )
    cells = F.when(F.col("priced"), F.col("c")).otherwise(F.slice("c", 1, 2))
    rows = tree.pricing_table(tree.labelled_cells(part, ["tbl", "label"], cells, F.array(F.lit("Brand"), F.lit("Size"))), ["tbl"])
    pairs = F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("tbl", "label", F.array_join(pairs, ";").alias("cells"), F.array_join("headers", ",").alias("headers"))


@query(
    "q90_category_names",
    """SELECT o_orderkey, CASE WHEN p_size > 25 THEN p_name ELSE (o_orderkey % 2500)::VARCHAR END AS category_name
        FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 2500""",
)
def category_names(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 2500).alias("category"))
    names = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("category_uuid"), F.col("p_name").alias("name"))
    return with_category_name(rows, names).select("o_orderkey", "category_name")
