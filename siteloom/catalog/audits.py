"""Audits, gates and coverage over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import audit, components, coverage, joins
from ..operators.coverage import listing_ratio
from ..operators.media import union_all
from ..operators.tree import type_closure
from ..plans import audit as plans
from ..session import cut_lineage
from ..sources import lists, manifests
from . import query
from .listings import _NODES
from .markup import _clean, _hnorm
from .tables import customer_nodes, places, table, texts


def _s(c):
    return F.col(c).cast("string")


_RT = "n_chars * (doc_id % 9 + 1) // 5"
_AUDIT = f"""l AS (SELECT CASE WHEN doc_id % 53 = 0 THEN 'new/' || doc_id ELSE source || '/' || doc_id END AS page, n_chars AS lt, doc_id % 20 AS li, doc_id,
            CASE WHEN doc_id % 17 = 0 THEN 0 ELSE {_RT} END AS rt0, doc_id * 7 % 30 AS ri0, doc_id % 41 = 0 AS err FROM documents),
        j AS (SELECT *, CASE WHEN err THEN NULL ELSE rt0 END AS rt, CASE WHEN err THEN NULL ELSE ri0 END AS ri, doc_id % 37 = 0 AS gone,
            CASE WHEN rt0 = 0 THEN 99 ELSE lt / rt0 END AS ratio FROM l),
        a AS (SELECT page, lt AS local_text, li AS local_imgs, CASE WHEN NOT gone THEN rt END AS ref_text, CASE WHEN NOT gone THEN ri END AS ref_imgs,
            CASE WHEN starts_with(page, 'new/') THEN 'N/A-NEW' WHEN gone THEN 'N/A' WHEN err THEN 'N/A-REF' WHEN rt < 120 AND lt > 400 THEN 'FABRICATED'
              WHEN rt >= 400 AND ratio < 0.35 THEN 'STUB' WHEN rt >= 400 AND ratio < 0.6 THEN 'THIN' WHEN ri - li >= 8 THEN 'MISSING-IMG'
              WHEN ratio BETWEEN 0.6 AND 1.8 AND abs(ri - li) <= 6 THEN 'OK' ELSE 'REVIEW' END AS class, round(ratio, 4) AS ratio FROM j)"""


def _fingerprints(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    page = F.when(k % 53 == 0, F.concat(F.lit("new/"), _s("doc_id"))).otherwise(F.concat_ws("/", "source", _s("doc_id")))
    local = d.select(page.alias("page"), F.col("n_chars").alias("text_len"), (k % 20).alias("imgs"))
    ref = d.where("doc_id % 37 <> 0").select(
        page.alias("page"),
        F.when(k % 41 != 0, F.when(k % 17 == 0, F.lit(0).cast("bigint")).otherwise(F.expr("n_chars * (doc_id % 9 + 1) div 5"))).alias("t"),
        F.when(k % 41 != 0, k * 7 % 30).alias("i"),
        F.when(k % 41 == 0, "HTTP 500").alias("error"),
    )
    return local, ref


@query(
    "q27_fidelity_audit",
    f"""WITH {_AUDIT} SELECT page, class, local_text, local_imgs, ref_text, ref_imgs,
          CASE WHEN class IN ('STUB', 'FABRICATED') THEN 3 WHEN class IN ('THIN', 'MISSING-IMG') THEN 2 WHEN class = 'REVIEW' THEN 1 ELSE 0 END AS severity FROM a""",
)
def fidelity_audit(spark, sf):
    local, ref = _fingerprints(spark, sf)
    out = audit.punch_list(audit.audit_pages(local, ref, "new/"))
    return out.select("page", "class", "local_text", "local_imgs", "ref_text", "ref_imgs", "severity")


@query("q27_class_counts", f"WITH {_AUDIT} SELECT class, count(*) AS n FROM a GROUP BY class")
def class_counts(spark, sf):
    local, ref = _fingerprints(spark, sf)
    return audit.class_counts(audit.audit_pages(local, ref, "new/"))


@query(
    "q87_site_audit",
    f"""WITH d AS (SELECT page_id, length(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)) AS raw,
            length({_clean("replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '&quot;', 'q'), '&copy;', 'c'), '&amp;', 'a')")}) AS lt FROM pages)
        SELECT page_id::VARCHAR AS page, lt AS local_text, 0 AS local_imgs, raw // (page_id % 4 + 1) AS ref_text,
          CASE WHEN raw // (page_id % 4 + 1) < 120 AND lt > 400 THEN 'FABRICATED' WHEN raw // (page_id % 4 + 1) >= 400 AND lt / (raw // (page_id % 4 + 1)) < 0.35 THEN 'STUB'
            WHEN raw // (page_id % 4 + 1) >= 400 AND lt / (raw // (page_id % 4 + 1)) < 0.6 THEN 'THIN' WHEN page_id % 10 >= 8 THEN 'MISSING-IMG'
            WHEN lt / (raw // (page_id % 4 + 1)) BETWEEN 0.6 AND 1.8 AND page_id % 10 <= 6 THEN 'OK' ELSE 'REVIEW' END AS class FROM d""",
)
def site_audit(spark, sf):
    pages = table(spark, sf, "pages").withColumn("page", _s("page_id"))
    raw = F.length(text.region(F.col("html"), "article"))
    ref = pages.select("page", F.expr("1").alias("x"), raw.alias("_raw"), "page_id").select(
        "page", F.expr("_raw div (page_id % 4 + 1)").alias("t"), (F.col("page_id") % 10).alias("i"), F.lit(None).cast("string").alias("error")
    )
    out = plans.site_audit(pages, ref, region="article")
    return out.select("page", "local_text", "local_imgs", "ref_text", "class")


_LINES = "string_split(text, chr(10))"


@query(
    "q28_heading_match",
    f"""WITH h AS (SELECT DISTINCT doc_id, {_hnorm('line')} AS heading FROM (SELECT doc_id, unnest({_LINES}) AS line FROM documents)),
        r AS (SELECT doc_id, heading FROM h WHERE length(heading) >= 3),
        l AS (SELECT doc_id, {_hnorm('left(text, (n_chars // 2)::INT)')} AS body FROM documents),
        c AS (SELECT r.doc_id, count(*) AS headings, count(*) FILTER (contains(body, heading)) AS matched FROM r JOIN l USING (doc_id) GROUP BY r.doc_id),
        p AS (SELECT *, round_even(100 * matched / headings, 0)::INT AS pct FROM c)
        SELECT doc_id, headings, matched, pct, CASE WHEN headings < 3 THEN 'unscorable' WHEN pct < 85 THEN 'fail' ELSE 'pass' END AS status FROM p""",
)
def heading_match(spark, sf):
    return _heading_scores(spark, sf)


def _heading_scores(spark, sf):
    d = texts(spark, sf)
    kept = F.filter(text.heading_lines(F.col("text")), lambda h: F.length(h) >= 3)
    ref = d.select("doc_id", F.explode(F.array_distinct(kept)).alias("heading"))
    half = F.expr("left(text, CAST(n_chars div 2 AS INT))")
    local = d.select("doc_id", text.heading_norm(half).alias("text"))
    return audit.heading_match(ref, local, "doc_id")


@query(
    "q83_score_card",
    f"""WITH h AS (SELECT DISTINCT doc_id, {_hnorm('line')} AS heading FROM (SELECT doc_id, unnest({_LINES}) AS line FROM documents)),
        r AS (SELECT doc_id, heading FROM h WHERE length(heading) >= 3),
        l AS (SELECT doc_id, {_hnorm('left(text, (n_chars // 2)::INT)')} AS body FROM documents),
        c AS (SELECT r.doc_id, count(*) AS headings, count(*) FILTER (contains(body, heading)) AS matched FROM r JOIN l USING (doc_id) GROUP BY r.doc_id),
        s AS (SELECT CASE WHEN headings < 3 THEN 'unscorable' WHEN round_even(100 * matched / headings, 0) < 85 THEN 'fail' ELSE 'pass' END AS status FROM c)
        SELECT count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'unscorable') AS unscorable,
          count(*) FILTER (status <> 'unscorable') > 0 AND count(*) FILTER (status = 'fail') = 0 AS ok FROM s""",
)
def score_card(spark, sf):
    return audit.score_card(_heading_scores(spark, sf))


@query(
    "q29_section_gate",
    f"""WITH b AS (SELECT doc_id, list_filter({_LINES}, lambda x: x <> '') AS rh,
            list_filter(string_split(lower(left(text, (n_chars * 9 // 10)::INT)), chr(10)), lambda x: x <> '') AS lh FROM documents),
        n AS (SELECT doc_id, rh, list_transform(rh, lambda x: lower({_clean('x')})) AS rn, list_transform(lh, lambda x: lower({_clean('x')})) AS ln FROM b),
        m AS (SELECT *, len(list_filter(rh, lambda x: length(x) > 3 AND NOT list_contains(ln, lower({_clean('x')})))) AS missing,
            list_filter(rn, lambda x: list_contains(ln, x)) AS common FROM n)
        SELECT doc_id, (len(rh) > 0 AND missing > len(rh) * 0.15)::INT + (doc_id % 10 >= 3 AND doc_id % 5 < doc_id % 10 * 0.5)::INT AS fails, CASE WHEN len(rh) > 0 AND missing > len(rh) * 0.15 THEN missing END AS missing,
          (doc_id % 7 = 0)::INT + (doc_id % 8 >= 4 AND doc_id % 3 < doc_id % 8 * 0.6)::INT AS warns FROM m""",
)
def section_gate(spark, sf):
    d = texts(spark, sf)
    k = F.col("doc_id")

    def lines(c):
        return F.filter(F.split(c, "\n"), lambda x: x != "")

    part = F.expr("left(text, CAST(n_chars * 9 div 10 AS INT))")
    ref = d.select(
        "doc_id", lines(F.col("text")).alias("headings"), (k % 10).alias("max_cards"), F.array(F.lit("Theme A"), F.lit("B"), F.lit("Type C")).alias("facet_options"), (k % 8).alias("imgs")
    )
    local = d.select(
        "doc_id", lines(F.lower(part)).alias("headings"), (k % 5).alias("max_cards"),
        F.when(k % 7 == 0, F.array(F.lit("type c"))).otherwise(F.array(F.lit(" theme  a"), F.lit("TYPE C"))).alias("facet_options"), (k % 3).alias("imgs"),
    )
    gate = audit.section_gate(ref, local, "doc_id")
    order = F.exists("warns", lambda w: w.startswith("section order"))
    said = F.regexp_extract(F.array_join("fails", ";"), r"missing (\d+)/", 1).try_cast("int")
    return gate.select(
        "doc_id", F.size("fails").alias("fails"), said.alias("missing"), (F.size("warns") - order.cast("int")).alias("warns")
    )


@query(
    "q29_heading_order",
    f"""WITH b AS (SELECT doc_id, list_filter({_LINES}, lambda x: x <> '') AS r,
            list_reverse(list_filter({_LINES}, lambda x: x <> '')) AS l FROM documents),
        c AS (SELECT doc_id, r, l, list_filter(l, lambda x: list_contains(r, x)) AS mine FROM b),
        d AS (SELECT doc_id, r, (SELECT list(v ORDER BY p) FROM (SELECT v, min(p) AS p FROM (SELECT unnest(mine) AS v, generate_subscripts(mine, 1) AS p) GROUP BY v)) AS m FROM c)
        SELECT doc_id, len(r) <= 2 OR r = m AS same_order FROM d WHERE len(r) > 0""",
)
def heading_order(spark, sf):
    d = table(spark, sf, "documents")
    heads = F.filter(F.split("text", "\n"), lambda x: x != "")
    rows = d.select("doc_id", heads.alias("r"), F.reverse(heads).alias("l")).where(F.size("r") > 0)
    return rows.select("doc_id", audit.same_order(F.col("r"), F.col("l")).alias("same_order"))


_COMBO = "p_brand || ' ' || p_name"


@query(
    "q30_coverage_gap",
    f"""WITH r AS (SELECT DISTINCT {_COMBO} AS key FROM part WHERE p_size <= 30),
        pr AS (SELECT DISTINCT CASE WHEN p_brand = 'Brand#1' THEN 'Brand#2 ' || p_name ELSE {_COMBO} END AS key FROM part WHERE p_size > 30),
        ig AS (SELECT DISTINCT {_COMBO} AS key FROM part WHERE p_retailprice < 910),
        d AS (SELECT DISTINCT {_COMBO} AS key FROM part WHERE p_type <> 'PROMO'), b AS (SELECT DISTINCT {_COMBO} AS key FROM part WHERE p_type <> 'SMALL')
        SELECT key, 'missing' AS change FROM r WHERE key NOT IN (SELECT key FROM pr) AND key NOT IN (SELECT key FROM ig)
        UNION ALL SELECT key, 'new' FROM d WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'dropped' FROM b WHERE key NOT IN (SELECT key FROM d)""",
)
def coverage_gap(spark, sf):
    part = table(spark, sf, "part").withColumn("key", F.concat_ws(" ", "p_brand", "p_name"))
    aliases = part.where("p_brand = 'Brand#1'").select(F.col("key").alias("alias"), F.concat(F.lit("Brand#2 "), "p_name").alias("canonical")).distinct()
    provided = part.where("p_size > 30").select("key")
    gaps = coverage.coverage(part.where("p_size <= 30"), provided, "key", aliases=aliases)
    gaps = gaps.join(part.where("p_retailprice < 910").select("key"), "key", "left_anti").withColumn("change", F.lit("missing"))
    return gaps.unionByName(coverage.drift(part.where("p_type <> 'PROMO'"), part.where("p_type <> 'SMALL'"), "key"))


_KEYS = "list_filter(['height', 'width', 'weight', 'colour', 'label'], lambda x, i: (p_partkey >> (i - 1)) % 2 = 1)"


@query(
    "q31_shape_duplicates",
    f"""WITH s AS (SELECT p_partkey AS type, list_sort({_KEYS}) AS keys FROM part), f AS (SELECT type, array_to_string(keys, ',') AS shape FROM s WHERE len(keys) >= 2)
        SELECT shape, type, count(*) OVER (PARTITION BY shape) AS type_count FROM f QUALIFY count(*) OVER (PARTITION BY shape) > 1""",
)
def shape_duplicates(spark, sf):
    names = F.expr("filter(array('height', 'width', 'weight', 'colour', 'label'), (x, i) -> (shiftright(p_partkey, i) % 2) = 1)")
    return components.shape_duplicates(table(spark, sf, "part").withColumnRenamed("p_partkey", "type").withColumn("p_partkey", F.col("type")), names)


@query(
    "q36_import_rate",
    """WITH i AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'home' ELSE o_orderpriority END AS page,
            CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderkey % 2 = 0 THEN '/dam/' || o_orderkey END AS t FROM orders)
        SELECT page, count(*) AS wanted, count(t) AS imported, round(count(t) / count(*), 4) AS rate, grouping(page)::INT AS is_total,
          CASE WHEN grouping(page) = 1 AND count(t) / count(*) < 0.6 THEN 'import largely failed' WHEN page = 'home' AND count(t) = 0 THEN 'nothing imported for home' END AS failure
        FROM i GROUP BY ROLLUP (page)""",
)
def import_rate(spark, sf):
    page = F.when(F.col("o_orderpriority") == "1-URGENT", "home").otherwise(F.col("o_orderpriority"))
    target = F.when((F.col("o_orderpriority") != "1-URGENT") & (F.col("o_orderkey") % 2 == 0), F.concat(F.lit("/dam/"), _s("o_orderkey")))
    rows = table(spark, sf, "orders").select(page.alias("page"), target.alias("target_path"))
    return coverage.import_rate(rows).withColumn("rate", F.round("rate", 4))


@query(
    "q37_folder_population",
    f"""WITH {_NODES}, k AS (SELECT n_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS children, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 9000) AS published FROM cust GROUP BY n_nationkey)
        SELECT nation_path AS path, CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE coalesce(children, 0) END AS children, CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE coalesce(published, 0) END AS published,
          CASE WHEN n_nationkey % 10 = 1 THEN 'folder missing' WHEN n_nationkey % 10 = 2 THEN 'not a content folder' WHEN n_nationkey % 6 = 0 OR coalesce(children, 0) = 0 THEN 'no children'
            WHEN coalesce(published, 0) = 0 THEN 'none published' END AS failure FROM places LEFT JOIN k USING (n_nationkey)""",
)
def folder_population(spark, sf):
    k = F.col("n_nationkey")
    folders = places(spark, sf).select(
        F.col("nation_path").alias("path"), F.when(k % 10 == 1, F.lit(None).cast("string")).when(k % 10 == 2, "page").otherwise("contentFolder").alias("folder_type"),
        F.when(k % 6 == 0, "TOYS").otherwise("BUILDING").alias("child_type"),
    )
    kids = customer_nodes(spark, sf).select(
        "parent_path", F.col("c_mktsegment").alias("primary_type"), F.when(F.col("c_acctbal") > 9000, "PUBLISHED").otherwise("NOT_PUBLISHED").alias("status")
    )
    return coverage.folder_population(folders, kids).select("path", "children", "published", "failure")


@query(
    "q38_debris",
    """WITH c AS (SELECT '/home/' || source || '/' || CASE doc_id % 17 WHEN 0 THEN 'Test-' || doc_id WHEN 1 THEN 'untitled' WHEN 2 THEN 'page-old-' || (doc_id % 50) WHEN 3 THEN 'copy-of-x' WHEN 4 THEN 'latest' ELSE 'p' || doc_id END AS path FROM documents
          UNION ALL SELECT '/home/src1/' || CASE WHEN page_id % 9 = 0 THEN 'untitled' ELSE 'temp' || page_id END FROM pages)
        SELECT DISTINCT path FROM c WHERE regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '^(test|untitled|copy-of|temp)|-old')""",
)
def debris(spark, sf):
    k = F.col("doc_id")
    name = (
        F.when(k % 17 == 0, F.concat(F.lit("Test-"), _s("doc_id"))).when(k % 17 == 1, "untitled")
        .when(k % 17 == 2, F.concat(F.lit("page-old-"), (k % 50).cast("string"))).when(k % 17 == 3, "copy-of-x").when(k % 17 == 4, "latest")
        .otherwise(F.concat(F.lit("p"), _s("doc_id")))
    )
    content = table(spark, sf, "documents").select(F.concat(F.lit("/home/"), "source", F.lit("/"), name).alias("path"))
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("/home/src1/"), F.when(F.col("page_id") % 9 == 0, "untitled").otherwise(F.concat(F.lit("temp"), _s("page_id")))).alias("path")
    )
    return union_all([content, pages]).distinct().where(urls.is_debris(urls.basename(F.col("path"))))


_REASON = """CASE WHEN n >= (SELECT count(*) FROM supplier) OR n % 7 = 0 THEN 'missing' WHEN n % 7 = 1 THEN 'empty (2b)' WHEN n % 7 = 2 THEN 'unreadable JSON'
      WHEN n % 7 = 3 THEN 'empty object' WHEN n % 7 = 4 THEN 'empty array' WHEN n % 7 = 5 THEN 'no pages' END"""


@query(
    "q39_contract_check",
    f"""WITH e AS (SELECT 's' || s_nationkey AS step, 'produces' AS direction, s_suppkey AS n FROM supplier UNION ALL SELECT 'c' || c_custkey, 'consumes', c_custkey % ((SELECT count(*) FROM supplier) + 5) FROM customer),
        p AS (SELECT s_suppkey AS n, 's' || s_nationkey AS producer FROM supplier), x AS (SELECT *, {_REASON} AS reason FROM e)
        SELECT step, direction, 'a' || x.n || '.json' AS artifact, CASE WHEN direction = 'consumes' THEN producer END AS producer, reason FROM x LEFT JOIN p USING (n) WHERE reason IS NOT NULL""",
)
def contract_check(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    n = s.agg((F.count(F.lit(1)) + 5).alias("_n"))  # one row
    art = lambda x: F.concat(F.lit("a"), x.cast("string"), F.lit(".json"))
    expected = s.select(F.concat(F.lit("s"), _s("s_nationkey")).alias("step"), F.lit("produces").alias("direction"), art(F.col("s_suppkey")).alias("artifact")).unionByName(
        c.crossJoin(F.broadcast(n)).select(F.concat(F.lit("c"), _s("c_custkey")).alias("step"), F.lit("consumes").alias("direction"), art(F.col("c_custkey") % F.col("_n")).alias("artifact"))
    )
    body = F.expr(
        "CASE s_suppkey % 7 WHEN 1 THEN '{}' WHEN 2 THEN '{\"a\": 1,' WHEN 3 THEN '{  }' WHEN 4 THEN '[   ]' WHEN 5 THEN '{\"pages\":{}}' ELSE '{\"pages\":{\"p\":[1]}}' END"
    )
    seen = s.select(art(F.col("s_suppkey")).alias("artifact"), (F.col("s_suppkey") % 7 != 0).alias("exists"), F.length(body).alias("size"), body.alias("json"))
    return coverage.contract_check(expected, seen)


@query(
    "q70_orphan_artifacts",
    """SELECT s_suppkey, 'a' || s_suppkey AS artifact FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey * 3 % (SELECT count(*) FROM supplier) FROM customer WHERE c_custkey % 5 = 0)""",
)
def orphan_artifacts(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    n = s.agg(F.count(F.lit(1)).alias("_n"))  # one row
    produced = s.select("s_suppkey", F.concat(F.lit("a"), _s("s_suppkey")).alias("artifact"))
    used = c.where("c_custkey % 5 = 0").crossJoin(F.broadcast(n)).select(F.concat(F.lit("a"), (F.col("c_custkey") * 3 % F.col("_n")).cast("string")).alias("artifact"))
    return coverage.orphan_artifacts(produced, used).select("s_suppkey", "artifact")


@query(
    "q49_label_gaps",
    """WITH u AS (SELECT DISTINCT 'ui.' || lower(p_type) || '.' || replace(p_name, ' ', '_') AS key FROM part),
        l AS (SELECT DISTINCT 'ui.' || lower(p_type) || '.' || replace(p_name, ' ', '_') AS key, unnest(['en', 'fr', 'de']) AS lang, unnest([p_size % 2, p_size % 7, p_size % 11]) AS ok FROM part),
        h AS (SELECT key, bool_or(lang = 'en' AND ok = 0) AS en, bool_or(lang = 'fr' AND ok = 0) AS fr, bool_or(lang = 'de' AND ok = 0) AS de FROM l GROUP BY key)
        SELECT key, concat_ws(',', CASE WHEN NOT de THEN 'de' END, CASE WHEN NOT en THEN 'en' END, CASE WHEN NOT fr THEN 'fr' END) AS missing FROM u JOIN h USING (key) WHERE NOT (en AND fr AND de)""",
)
def label_gaps(spark, sf):
    part = table(spark, sf, "part")
    leaf = F.replace("p_name", F.lit(" "), F.lit("_"))
    used = part.select(F.concat(F.lit("ui."), F.lower("p_type"), F.lit("."), leaf).alias("key"))
    # one nested dictionary per part and language, flattened to dotted keys
    doc = F.concat(F.lit('{"ui":{"'), F.lower("p_type"), F.lit('":{"'), leaf, F.lit('":"x"}}}'))
    langs = F.array(
        F.struct(F.lit("en").alias("lang"), (F.col("p_size") % 2 == 0).alias("ok")),
        F.struct(F.lit("fr").alias("lang"), (F.col("p_size") % 7 == 0).alias("ok")),
        F.struct(F.lit("de").alias("lang"), (F.col("p_size") % 11 == 0).alias("ok")),
    )
    docs = part.select(doc.alias("json"), F.inline(langs)).where("ok").select("lang", "json").distinct()
    return coverage.label_gaps(used, lists.flatten_labels(docs), ["en", "fr", "de"])


@query(
    "q49_property_labels",
    """SELECT 'en' AS lang, replace(p_brand, '#', '_') || '.' || p_partkey || ':title' AS key, 'Title = ' || p_name AS value FROM part WHERE p_partkey % 10 <> 0""",
)
def property_labels(spark, sf):
    line = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("# a=b "), "p_name")).otherwise(
        F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("."), _s("p_partkey"), F.lit("\\:title = Title = "), "p_name")
    )
    return lists.property_labels(table(spark, sf, "part").select(line.alias("value")), "en")


@query(
    "q21_translation_coverage",
    """WITH t AS (SELECT source, count(*) FILTER (doc_id % 3 <> 0) AS have_fr, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 = 0) AS gap, count(*) AS total FROM documents GROUP BY source)
        SELECT source, total, gap, CASE WHEN gap > 0.14 * total THEN 'fail' ELSE 'ok' END AS status, round(gap / total, 4) AS share,
          CASE WHEN gap = 0 THEN 'empty' WHEN gap < total * 0.5 THEN 'below half of the source' ELSE 'ok' END AS ratio FROM t""",
)
def translation_coverage(spark, sf):
    k = F.col("doc_id")
    titles = F.map_filter(
        F.create_map(F.lit("fr"), F.when(k % 3 != 0, F.lit("t")), F.lit("en"), F.when(k % 5 != 0, F.lit("t"))), lambda _, v: v.isNotNull()
    )
    rows = table(spark, sf, "documents").select("source", titles.alias("titles"))
    gap = F.col("titles")["fr"].isNotNull() & F.col("titles")["en"].isNull()
    counted = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(gap).alias("gap"))
    return counted.select(
        "source", "total", "gap", F.when(F.col("gap") > 0.14 * F.col("total"), "fail").otherwise("ok").alias("status"),
        F.round(F.col("gap") / F.col("total"), 4).alias("share"), listing_ratio(F.col("gap"), F.col("total")).alias("ratio"),
    )


@query(
    "q68_reference_pairing",
    """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/home/' || source || '/' || (doc_id % 300) || '.html' WHEN 1 THEN source || '/' || (doc_id % 300) WHEN 2 THEN '/home/' ELSE 'x/y' || doc_id END AS page,
            CASE WHEN doc_id % 4 < 2 THEN source || '/' || (doc_id % 300) WHEN doc_id % 4 = 2 THEN 'home' ELSE 'x/y' || doc_id END AS bare FROM documents),
        s AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'src' || (page_id % 20) || '-' || page_id ELSE page_id::VARCHAR END AS slug FROM pages UNION SELECT 'home')
        SELECT doc_id, CASE WHEN a.slug IS NOT NULL THEN a.slug WHEN b.slug IS NOT NULL THEN b.slug ELSE 'home' END AS reference,
          CASE WHEN a.slug IS NOT NULL THEN 'path' WHEN b.slug IS NOT NULL THEN 'leaf' ELSE 'fallback_home' END AS match_kind
        FROM p LEFT JOIN s a ON a.slug = replace(bare, '/', '-') LEFT JOIN s b ON b.slug = regexp_extract(bare, '([^/]*)$', 1)""",
)
def reference_pairing(spark, sf):
    k = F.col("doc_id")
    n = (k % 300).cast("string")
    page = (
        F.when(k % 4 == 0, F.concat(F.lit("/home/"), "source", F.lit("/"), n, F.lit(".html")))
        .when(k % 4 == 1, F.concat("source", F.lit("/"), n)).when(k % 4 == 2, "/home/").otherwise(F.concat(F.lit("x/y"), _s("doc_id")))
    )
    pages = table(spark, sf, "documents").select("doc_id", page.alias("page"))
    p = F.col("page_id")
    slug = F.when(p % 2 == 0, F.concat(F.lit("src"), (p % 20).cast("string"), F.lit("-"), _s("page_id"))).otherwise(_s("page_id"))
    captured = table(spark, sf, "pages").select(F.explode(F.array(slug, F.lit("home"))).alias("slug"))
    return joins.pair_reference(pages, captured).select("doc_id", "reference", "match_kind")


@query(
    "q69_css_hooks",
    """WITH v AS (SELECT DISTINCT 'v' || (p_partkey % 50) AS view, CASE WHEN p_partkey % 4 = 0 THEN 'field-' ELSE '' END || replace(p_name, ' ', '-') AS token FROM part),
        c AS (SELECT DISTINCT CASE WHEN p_size > 2 THEN 'field-' ELSE '' END || replace(p_name, ' ', '-') AS token FROM part WHERE p_size % 11 = 0 OR p_size = 1),
        o AS (SELECT token[7:] AS token FROM c WHERE token LIKE 'field-%' AND token[7:] NOT IN (SELECT token FROM c))
        SELECT view, token FROM v WHERE token IN (SELECT token FROM o) AND NOT EXISTS (SELECT 1 FROM v w WHERE w.view = v.view AND w.token = 'field-' || v.token)""",
)
def css_hooks(spark, sf):
    part = table(spark, sf, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    views = part.select(
        F.concat(F.lit("v"), (F.col("p_partkey") % 50).cast("string")).alias("view"),
        F.concat(F.when(F.col("p_partkey") % 4 == 0, "field-").otherwise(""), name).alias("token"),
    )
    css = part.where("p_size % 11 = 0 OR p_size = 1").select(F.concat(F.when(F.col("p_size") > 2, "field-").otherwise(""), name).alias("token"))
    return components.hook_orphans(views, css)


def _gate_nodes(spark, sf):
    c = customer_nodes(spark, sf)
    k = F.col("c_custkey")
    leafs = c.select(
        F.regexp_replace("path", "^/home", "/sites/s/home").alias("path"),
        F.when(k % 3 == 0, "news").when(k % 3 == 1, "page").otherwise("card").alias("primary_type"),
        F.map_filter(F.create_map(F.lit("fr"), F.when(k % 2 == 0, F.col("title")), F.lit("en"), F.when(k % 8 != 0, F.col("title"))), lambda _, v: v.isNotNull()).alias("titles"),
        F.when(k % 10 == 0, F.create_map(F.lit("image"), F.lit("u"))).otherwise(F.create_map(F.lit("startNode"), F.lit("n"))).alias("refs"),
    )
    region = table(spark, sf, "region").where("r_regionkey < 2")
    empty = F.create_map().cast("map<string,string>")
    shell = region.select(
        F.when(F.col("r_regionkey") == 0, "/sites/s/home/nav").otherwise("/sites/s/home/footer").alias("path"),
        F.when(F.col("r_regionkey") == 0, "mainNav").otherwise("footer").alias("primary_type"), empty.alias("titles"), empty.alias("refs"),
    )
    both = leafs.unionByName(shell)
    return both.select(F.md5("path").alias("uuid"), "path", F.regexp_replace("path", "/[^/]*$", "").alias("parent_path"), "primary_type", "titles", "refs")


def _gate_types(spark):
    pairs = [("news", "content"), ("news", "mainResource"), ("card", "content"), ("page", "node"), ("mainNav", "hiddenType"), ("footer", "content")]
    return type_closure(spark.createDataFrame(pairs, "name string, supertype string"))


@query(
    "q71_content_gate",
    f"""WITH {_NODES}, n AS (SELECT count(*) FILTER (c_custkey % 3 <> 1) + 1 AS content, count(*) FILTER (c_custkey % 3 <> 1 AND c_custkey % 10 = 0) AS img, count(*) FILTER (c_custkey % 3 = 0) AS mr,
            count(*) FILTER (c_custkey % 2 = 0 OR c_custkey % 8 <> 0) AS titled, count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 8 = 0) AS gap FROM cust)
        SELECT 'shell:nav' AS "check", 'note' AS status, '0 children' AS detail UNION ALL SELECT 'shell:footer', 'fail', '0 children'
        UNION ALL SELECT 'images', CASE WHEN img = 0 THEN 'fail' ELSE 'ok' END, img || ' of ' || content || ' nodes' FROM n
        UNION ALL SELECT 'listings', CASE WHEN mr < 150 THEN 'fail' ELSE 'ok' END, mr || ' of about 300' FROM n
        UNION ALL SELECT 'translations', CASE WHEN gap > titled * 0.2 THEN 'fail' WHEN gap > 0 THEN 'note' ELSE 'ok' END, gap || ' of ' || titled || ' without a title' FROM n
        UNION ALL SELECT 'cleanup', 'ok', '0 leftover nodes'""",
)
def content_gate(spark, sf):
    nodes = cut_lineage(_gate_nodes(spark, sf), "gate-nodes")
    closure = cut_lineage(_gate_types(spark), "gate-types")
    return plans.content_gate(nodes, closure, "/sites/s", 300)


@query(
    "q72_region_population",
    f"""WITH {_NODES}, k AS (SELECT parent_path AS path, count(*) AS n FROM cust WHERE c_acctbal > 8500 AND c_mktsegment = 'BUILDING' GROUP BY parent_path)
        SELECT nation_path AS path, coalesce(n, 0) AS children, CASE WHEN n > 0 THEN 'ok' WHEN n_nationkey % 2 = 0 THEN 'exempt' ELSE 'empty' END AS status FROM places LEFT JOIN k ON k.path = nation_path""",
)
def region_population(spark, sf):
    kids = customer_nodes(spark, sf).where("c_acctbal > 8500 AND c_mktsegment = 'BUILDING'")
    regions = places(spark, sf).select(F.col("nation_path").alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "nav").otherwise("area").alias("primary_type"))
    hidden = spark.createDataFrame([("nav",)], "primary_type string")
    return plans.region_population(kids, regions, hidden)


@query(
    "q73_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS first_source, max(l_partkey) AS last_source FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf):
    return components.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query(
    "q74_component_manifest",
    """SELECT p_partkey AS ord, 'ns:' || replace(p_name, ' ', '') || p_partkey AS node_type, unnest([p_brand, p_type]) AS source, p_size > 25 AS shell FROM part""",
)
def component_manifest(spark, sf):
    entry = F.struct(
        F.concat(F.lit("ns:"), F.replace("p_name", F.lit(" "), F.lit("")), _s("p_partkey")).alias("nodeType"),
        (F.col("p_size") > 25).alias("needsMainResource"), F.array("p_brand", "p_type").alias("sources"),
    )
    doc = table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.array(entry).alias("components"))).alias("j"))
    parsed = doc.select("p_partkey", F.from_json("j", manifests.COMPONENTS).alias("m")).select("p_partkey", "m.*")
    rows = parsed.select("p_partkey", F.explode("components").alias("_c")).select(F.col("p_partkey").alias("ord"), "_c.*")
    return rows.select("ord", F.col("nodeType").alias("node_type"), F.explode("sources").alias("source"), F.col("needsMainResource").alias("shell"))


@query(
    "q91_shell_units",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')""",
)
def shell_units(spark, sf):
    manifest = table(spark, sf, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    units = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return coverage.shell_units(units, manifest, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")
