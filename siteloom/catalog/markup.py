"""Queries over page markup."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import blocks, components, dom, fingerprint, media
from ..operators.coverage import extraction_gate
from ..plans.article import article_core
from ..session import cut_lineage
from ..sources.lists import crawl_errors, throttled
from . import query
from .tables import PART_CARDS, PART_IMAGES, pages, part_pages, table, texts

HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)"
ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)"
PATH = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), "
    r"'^[a-z]+://[^/]*', ''), '^/+|/+$', '', 'g'), '\.html$', '')"
)
UNESC = (
    "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)


def _unesc(x: str) -> str:
    return UNESC.format(x=x)


def _clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _hnorm(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(replace(replace(lower(strip_accents({x})), 'œ', 'oe'), 'æ', 'ae'),"
        " '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
    )


@query(
    "q01_page_slug_host",
    f"""SELECT page_id, lower({HOST}) AS host, {ORIGIN} AS origin, {PATH} AS path,
        CASE WHEN {PATH} = '' OR regexp_matches({PATH}, '^[a-z]{{2}}(-[A-Z]{{2}})?$') THEN 'home'
             ELSE regexp_extract({PATH}, '([^/]*)$', 1) END AS slug,
        regexp_extract({PATH}, '^[a-z]{{2}}/(.*)$', 1) AS unlocalized
        FROM pages""",
)
def page_slug_host(spark, sf):
    url = F.col("url")
    path = urls.page_path(url)
    return table(spark, sf, "pages").select(
        "page_id", urls.host(url).alias("host"), urls.origin(url).alias("origin"), path.alias("path"),
        urls.page_slug(url).alias("slug"), urls.strip_locale(path).alias("unlocalized"),
    )


@query(
    "q02_link_inventory",
    f"""WITH p AS (SELECT page_id, lower({HOST}) AS host, {ORIGIN} AS origin, html FROM pages),
        a AS (SELECT page_id, host, origin, split_part(unnest(string_split(html, '<a href="')[2:]), '"', 1) AS href FROM p
              UNION ALL SELECT page_id, host, origin, unnest(['/one', '/two-' || page_id % 3, '/three?a=1&b=2', 'https://elsewhere.example/' || page_id % 4]) FROM p),
        l AS (SELECT page_id, host, CASE WHEN href[1] = '/' THEN origin || href ELSE href END AS target, href[1] <> '/' AS ext FROM a)
        SELECT host, target, count(*) AS links, count(DISTINCT page_id) AS pages, bool_or(ext) AS is_external
        FROM l GROUP BY host, target""",
)
def link_inventory(spark, sf):
    # every page also gets links in other notations, and one that is commented out
    more = F.format_string(
        "<a href='/one'>1</a><A class=x HREF=/two-%d>2</A><a href=\"/three?a=1&amp;b=2\">3</a><!-- <a href=\"/no\">x</a> -->"
        "<a\nhref = \"https://elsewhere.example/%d\"><img src=x></a>", F.col("page_id") % 3, F.col("page_id") % 4,
    )
    linked = pages(spark, sf).withColumn("html", F.concat("html", more))
    links = blocks.links(dom.dom_nodes(linked, keep=("page_id", "url")))
    target = urls.resolve(F.col("url"), F.col("href"))
    rows = links.select("page_id", urls.host(F.col("url")).alias("host"), target.alias("target"), urls.is_external(F.col("href")).alias("_x"))
    return rows.groupBy("host", "target").agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"), F.bool_or("_x").alias("is_external")
    )


@query(
    "q03_headings_norm",
    f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-4]\\b[^>]*>(.*?)</h[1-4]>', 1)) AS raw FROM pages),
        n AS (SELECT page_id, {_hnorm(_unesc("regexp_replace(raw, '<[^>]+>', ' ', 'g')"))} AS heading FROM h)
        SELECT page_id, heading, length(heading) AS chars FROM n
        WHERE length(heading) >= 3 GROUP BY page_id, heading""",
)
def headings_norm(spark, sf):
    found = blocks.headings(dom.dom_nodes(pages(spark, sf)), min_chars=3)
    return found.select("page_id", "heading", F.length("heading").alias("chars"))


@query(
    "q04_fingerprint",
    f"""WITH d AS (SELECT page_id, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS doc FROM pages)
        SELECT page_id, length({_clean(_unesc("regexp_replace(doc, '<[^>]+>', ' ', 'g')"))}) AS text_len,
               len(regexp_extract_all(doc, '(?i)<img\\b[^>]*>')) AS imgs,
               len(regexp_extract_all(doc, '(?i)class="[^"]*(block|section|card|hero|grid)')) AS blocks
        FROM d""",
)
def fingerprint_pages(spark, sf):
    fp = fingerprint.fingerprint(pages(spark, sf), region="article")
    return fp.select("page_id", "text_len", "imgs", "blocks")


_SITES = """all_pages AS (
      SELECT page_id, {host} AS host, html FROM pages
      UNION ALL SELECT p_partkey, 'shop.example.com', '/-/media/ class="component x" field-' FROM part)"""


@query(
    "q05_platform_detect",
    f"""WITH all_pages AS (
          SELECT page_id, lower({HOST}) AS host,
            [['/-/media/', 'class="[^"]*\\bcomponent\\b', 'field-', 'data-sc-', '\\bsxa\\b'],
             ['drupal-settings-json', '/sites/default/files', 'data-drupal', '\\bDrupal\\b'],
             ['/wp-content/', '/wp-json/', '/wp-includes/', 'class="[^"]*\\bwp-'],
             ['/etc\\.clientlibs/', '/content/dam/', '\\bcq:', 'data-sly-', '\\bgranite\\b']] AS sigs, html FROM pages),
        s AS (SELECT * FROM all_pages),
        x AS (SELECT host, list_sum(list_transform(sigs[1], lambda p: regexp_matches(html, p)::INT))::BIGINT AS a,
                     list_sum(list_transform(sigs[2], lambda p: regexp_matches(html, p)::INT))::BIGINT AS b,
                     list_sum(list_transform(sigs[3], lambda p: regexp_matches(html, p)::INT))::BIGINT AS c,
                     list_sum(list_transform(sigs[4], lambda p: regexp_matches(html, p)::INT))::BIGINT AS d FROM s
              UNION ALL SELECT 'shop.example.com', 3, 0, 0, 0 FROM part),
        g AS (SELECT host, count(*) AS pages, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d FROM x GROUP BY host),
        m AS (SELECT *, greatest(a, b, c, d) AS score FROM g)
        SELECT host, pages, score, CASE WHEN score < 2 THEN 'generic' WHEN score = a THEN 'sitecore-sxa'
               WHEN score = b THEN 'drupal' WHEN score = c THEN 'wordpress' ELSE 'aem' END AS platform FROM m""",
)
def platform_detect(spark, sf):
    both = table(spark, sf, "pages").unionByName(part_pages(spark, sf).select("page_id", "url", "html"))
    sites = both.withColumn("host", urls.host(F.col("url")))
    return fingerprint.detect_platform(sites, ["host"])


@query(
    "q06_seo_baseline",
    f"""WITH d AS (SELECT page_id, {_clean("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} <> '' AS titled,
             len(regexp_extract_all(html, '(?i)<h1\\b')) AS h1 FROM pages)
        SELECT page_id, titled::INT::BIGINT AS titles, 0::BIGINT AS descriptions, h1::BIGINT AS h1, 0::BIGINT AS images,
          0::BIGINT AS images_without_alt,
          concat_ws(',', CASE WHEN NOT titled THEN 'title' END, 'description', CASE WHEN h1 <> 1 THEN 'single_h1' END) AS missing
        FROM d""",
)
def seo_baseline(spark, sf):
    return fingerprint.seo_baseline(dom.dom_nodes(pages(spark, sf))).withColumn("missing", F.array_join("missing", ","))


@query(
    "q07_generic_blocks",
    f"""WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS doc FROM pages),
        h AS (SELECT page_id, 0 AS pos, 'heading' AS type, regexp_extract(doc, '(?is)<h1>(.*?)</h1>', 1) AS raw FROM a),
        p AS (SELECT page_id, unnest(generate_series(2, len(string_split(doc, '<p>')))) AS pos, doc FROM a),
        t AS (SELECT page_id, pos, 'text' AS type, split_part(string_split(doc, '<p>')[pos], '</p>', 1) AS raw FROM p),
        u AS (SELECT * FROM h UNION ALL SELECT * FROM t),
        c AS (SELECT page_id, pos, type, {_clean(_unesc("regexp_replace(raw, '<[^>]+>', '', 'g')"))} AS text FROM u)
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth, type, text FROM c WHERE length(text) >= 2""",
)
def generic_blocks(spark, sf):
    found = blocks.content_blocks(dom.dom_nodes(pages(spark, sf)))
    nth = F.row_number().over(W.partitionBy("page_id").orderBy("seq"))  # one page per group
    return found.select("page_id", nth.alias("nth"), "type", "text")


_KEY = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '\?.*$', ''),"
    r" '[^A-Za-z0-9._/-]', '_', 'g'), '/+$', '/index.html')"
)


@query(
    "q08_cache_key",
    f"""WITH k AS (SELECT page_id, {_KEY} AS legacy_key, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
        f AS (SELECT *, CASE WHEN q = '' THEN legacy_key ELSE legacy_key || '@' || left(md5(q), 12) END AS cache_key FROM k)
        SELECT cache_key, min(legacy_key) AS legacy_key, count(*) AS pages, min(page_id) AS first_page FROM f GROUP BY cache_key""",
)
def cache_key(spark, sf):
    url = F.col("url")
    rows = table(spark, sf, "pages").select("page_id", urls.cache_key(url).alias("cache_key"), urls.cache_key(url, True).alias("legacy_key"))
    return rows.groupBy("cache_key").agg(
        F.min("legacy_key").alias("legacy_key"), F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page")
    )


_STATUS = "CASE event_id % 10 WHEN 3 THEN 403 WHEN 4 THEN 404 WHEN 5 THEN 429 WHEN 6 THEN 500 WHEN 7 THEN 503 WHEN 8 THEN 504 WHEN 9 THEN 301 ELSE 200 END"
_BODY = "CASE event_id % 13 WHEN 0 THEN 'Just a Moment...' WHEN 1 THEN 'Access denied' ELSE props END"


def _fetches(spark, sf):
    url = F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example/"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", url.alias("url"), F.expr(_STATUS).alias("status"), F.expr(_BODY).alias("body"))


@query(
    "q09_block_pages",
    f"""WITH f AS (SELECT 'https://h' || user_id || '.example/' || event_type AS url, {_STATUS} AS status, {_BODY} AS body FROM events)
        SELECT url, count(*) AS fetches, count(*) FILTER (status IN (403,429,500,502,503,520,521,522,523,524)) AS blocked,
          count(*) FILTER (regexp_matches(body, '(?i)just a moment|attention required|access denied')) AS challenges,
          count(*) FILTER (status >= 400) AS errors FROM f GROUP BY url""",
)
def block_pages(spark, sf):
    rows = _fetches(spark, sf)
    return rows.groupBy("url").agg(
        F.count(F.lit(1)).alias("fetches"),
        F.count_if(urls.is_block_status(F.col("status"))).alias("blocked"),
        F.count_if(urls.is_challenge(F.col("body"))).alias("challenges"),
        F.count_if(F.col("status") >= 400).alias("errors"),
    )


@query(
    "q09_crawl_errors",
    f"""WITH f AS (SELECT 'https://h' || user_id || '.example/' || event_type AS url, {_STATUS} AS status FROM events)
        SELECT DISTINCT url, (SELECT count(*) FROM f WHERE status IN (403,429,503,520,522)) AS throttled FROM f WHERE status >= 400""",
)
def crawl_error_report(spark, sf):
    lines = _fetches(spark, sf).select(
        F.format_string("  HTTP/1.1 %d answer from %s later", "status", "url").alias("value")
    )
    return crawl_errors(lines).crossJoin(F.broadcast(throttled(lines)))  # one row


# ---------------------------------------------------------------- structured pages
_CARDS = f"generate_series(1, {PART_CARDS})"
_INST = f"""inst AS (
      SELECT p_partkey AS page_id, 0 AS grp, 0 AS k, 'title' AS type, p_name || ' | ' || p_brand AS f1, 'titre' AS n1 FROM part
      UNION ALL SELECT p_partkey, 1, 0, 'picture-grid', NULL, NULL FROM part
      UNION ALL SELECT p_partkey, 2, unnest({_CARDS}), 'card', NULL, NULL FROM part
      UNION ALL SELECT p_partkey, 3, 0, 'rich-text', 'Body of ' || p_name, 'content' FROM part WHERE p_size % 5 = 0
      UNION ALL SELECT p_partkey, 4, 0, 'video', NULL, NULL FROM part WHERE p_partkey % 7 IN (0, 1)
      UNION ALL SELECT p_partkey, 5, 0, 'spacer', NULL, NULL FROM part)"""


def part_dom(spark, sf, keep=("page_id", "url")):
    return dom.dom_nodes(part_pages(spark, sf), keep=keep)


@query(
    "q32_component_inventory",
    f"""WITH {_INST}
        SELECT type, count(*) AS instances, count(DISTINCT page_id) AS pages,
          (CASE type WHEN 'title' THEN 2 WHEN 'picture-grid' THEN 2 * (SELECT max({PART_CARDS}) > 0 FROM part)::INT WHEN 'rich-text' THEN 1 ELSE 0 END)::BIGINT AS fields,
          0::BIGINT AS child_types,
          CASE type WHEN 'picture-grid' THEN (SELECT max({PART_CARDS}) FROM part) ELSE 0 END::BIGINT AS link_series,
          CASE type WHEN 'picture-grid' THEN 'link series' END AS hint
        FROM inst WHERE type <> 'card' GROUP BY type""",
)
def component_inventory(spark, sf):
    found = components.source_components(part_dom(spark, sf))
    return components.component_inventory(found).select("type", "instances", "pages", "fields", "child_types", "link_series", "hint")


@query(
    "q32_component_values",
    f"""WITH {_INST}, v AS (
          SELECT type, 'page' AS kind, page_id::VARCHAR AS value FROM inst WHERE type <> 'card'
          UNION ALL SELECT type, 'alias', type FROM inst WHERE type <> 'card'
          UNION ALL SELECT type, 'field', unnest(['date', 'titre']) FROM inst WHERE type = 'title'
          UNION ALL SELECT type, 'field', 'content' FROM inst WHERE type = 'rich-text'
          UNION ALL SELECT 'picture-grid', 'field', unnest(['text', 'title']) FROM part WHERE {PART_CARDS} > 0)
        SELECT type, kind, value, count(*) AS n FROM v GROUP BY type, kind, value""",
)
def component_values(spark, sf):
    return components.component_values(components.source_components(part_dom(spark, sf))).select("type", "kind", "value", "n")


@query(
    "q51_component_instances",
    f"""WITH {_INST}
        SELECT i.page_id, row_number() OVER (PARTITION BY i.page_id ORDER BY grp, k) AS nth, type, type = 'card' AS is_item,
          CASE type WHEN 'title' THEN 'date=Du ' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || '/' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0')
                      || '/2021;titre=' || p_name || ' | ' || p_brand
            WHEN 'card' THEN 'text=' || p_type || ' ' || k || ';title=Card ' || k
            WHEN 'rich-text' THEN 'content=Body of ' || p_name ELSE '' END AS fields,
          CASE WHEN type = 'card' THEN 'More>/en/item/' || p_partkey || '/' || k ELSE '' END AS links,
          type IN ('video', 'spacer') OR (type = 'picture-grid' AND {PART_IMAGES} = 0) AS empty
        FROM inst i JOIN part ON p_partkey = i.page_id""",
)
def component_instances(spark, sf):
    inst = components.component_instances(part_dom(spark, sf, ("page_id",)))
    nth = F.row_number().over(W.partitionBy("page_id").orderBy("idx"))  # one page per group
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return inst.select(
        "page_id", nth.alias("nth"), "type", "is_item", F.array_join(pairs, ";").alias("fields"),
        F.array_join(F.transform("links", lambda x: F.concat(x["text"], F.lit(">"), x["href"])), ";").alias("links"), "empty",
    )


@query(
    "q34_image_distribution",
    f"""WITH g AS (SELECT p_partkey AS page_id, {PART_CARDS} AS cards, {PART_IMAGES} AS imgs, p_name FROM part),
        n AS (SELECT *, unnest(generate_series(1, imgs)) AS i FROM g)
        SELECT page_id, CASE WHEN i <= cards THEN 'card' ELSE 'picture-grid' END AS type, page_id || '-' || i || '.png' AS file, '' AS alt FROM n
        UNION ALL SELECT page_id, 'title', page_id || '.jpg', p_name FROM g""",
)
def image_distribution(spark, sf):
    inst = components.component_instances(part_dom(spark, sf, ("page_id",)))
    return inst.select("page_id", "type", F.explode("images").alias("i")).select("page_id", "type", "i.file", "i.alt")


_MEDIA = f"""m AS (
      SELECT p_partkey AS page_id, 0 AS pos, 'og-' || p_partkey || '.png' AS file, 'content' AS role, 0 AS width, 'social' AS kind, '/-/media/og-' || p_partkey || '.png' AS ref FROM part
      UNION ALL SELECT p_partkey, 2, 'bg-' || p_partkey || '.jpg', 'content', 0, 'sheet', '/-/media/bg-' || p_partkey || '.jpg' FROM part
      UNION ALL SELECT p_partkey, 3, p_partkey || '.jpg', 'hero', 1600, 'srcset', '/-/media/hero/' || p_partkey || '.jpg?w=1600' FROM part
      UNION ALL SELECT p_partkey, 3 + i, p_partkey || '-' || i || '.png', 'content', 0, 'img', '/-/media/pics/' || p_partkey || '-' || i || '.png'
        FROM (SELECT p_partkey, unnest(generate_series(1, {PART_IMAGES})) AS i FROM part))"""


@query(
    "q52_media_refs",
    f"""WITH {_MEDIA} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS seq,
        'https://shop.example.com' || ref AS src, file, role, kind, width FROM m""",
)
def media_refs(spark, sf):
    return media.media_refs(part_dom(spark, sf)).select("page_id", "seq", "src", "file", "role", "kind", "width")


@query(
    "q53_role_histogram",
    f"""WITH {_MEDIA} SELECT page_id, 0::BIGINT AS banner, 0::BIGINT AS card, count(*) FILTER (role = 'content') AS content,
        count(*) FILTER (role = 'hero') AS hero, 0::BIGINT AS icon, 0::BIGINT AS logo, 0::BIGINT AS partner FROM m GROUP BY page_id""",
)
def role_histogram(spark, sf):
    return media.role_histogram(media.media_refs(part_dom(spark, sf)))


@query(
    "q54_article_core",
    """SELECT p_partkey AS page_id, p_name || ' ' || p_brand AS title,
        '2021-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00.000' AS publish_date,
        CASE WHEN p_size % 5 = 0 THEN '<p>Body of ' || p_name || '</p>' ELSE '<p>' || p_name || ' ' || p_brand || '</p>' END AS body,
        p_partkey || '.jpg' AS hero_file, p_name AS hero_alt FROM part""",
)
def article_cores(spark, sf):
    inst = components.component_instances(part_dom(spark, sf, ("page_id",)))
    core = article_core(inst, {"title": "titre", "publishDate": "date"}, body_types=("rich-text",))
    return core.select("page_id", "title", "publish_date", "body", "hero_file", "hero_alt")


@query(
    "q35_body_assembly",
    f"""WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS doc FROM pages),
        p AS (SELECT page_id, doc, unnest(generate_series(1, len(string_split(doc, '<p>')))) AS pos FROM a),
        t AS (SELECT page_id, pos, {_clean(_unesc("regexp_replace(CASE WHEN pos = 1 THEN doc[:strpos(doc, '</h1>')] ELSE split_part(string_split(doc, '<p>')[pos], '</p>', 1) END, '<[^>]*>?', '', 'g')"))} AS text FROM p),
        f AS (SELECT page_id, pos, CASE WHEN pos = 1 THEN '<h2>' || text || '</h2>' ELSE '<p>' || text || '</p>' END AS frag FROM t WHERE length(text) >= 2)
        SELECT page_id, string_agg(frag, chr(10) ORDER BY pos) AS body FROM f GROUP BY page_id""",
)
def body_assembly(spark, sf):
    found = blocks.content_blocks(dom.dom_nodes(pages(spark, sf))).where(F.col("type").isin("heading", "text"))
    tag = F.when(F.col("type") == "heading", "h2").otherwise("p")
    frag = F.concat(F.lit("<"), tag, F.lit(">"), F.col("text"), F.lit("</"), tag, F.lit(">"))
    # a group is one page's own blocks
    packed = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", frag.alias("f")))).alias("_l"))
    return packed.select("page_id", F.array_join(F.transform("_l", lambda x: x["f"]), "\n").alias("body"))


@query(
    "q56_video_players",
    "SELECT p_partkey AS page_id, p_partkey % 7 = 0 AS playable FROM part WHERE p_partkey % 7 IN (0, 1)",
)
def video_players(spark, sf):
    return fingerprint.video_players(part_dom(spark, sf, ("page_id",))).select("page_id", "playable")


@query(
    "q57_repeated_structures",
    f"""SELECT p_partkey AS page_id, 1 + {PART_CARDS} AS cards,
        greatest(CASE WHEN {PART_CARDS} >= 2 THEN {PART_CARDS} ELSE 0 END, 2 + (p_size % 5 = 0)::INT)::BIGINT AS max_cards,
        1 + {PART_IMAGES} AS images FROM part""",
)
def repeated_structures(spark, sf):
    return fingerprint.structure_signals(part_dom(spark, sf, ("page_id",)))


@query(
    "q58_structured_blocks",
    f"""WITH b AS (
          SELECT p_partkey AS page_id, 'heading' AS type, p_name || ' | ' || p_brand AS text, NULL AS href, NULL AS file FROM part
          UNION ALL SELECT p_partkey, 'text', 'Du ' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || '/' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '/2021', NULL, NULL FROM part
          UNION ALL SELECT p_partkey, 'image', NULL, NULL, p_partkey || '.jpg' FROM part
          UNION ALL SELECT p_partkey, 'image', NULL, NULL, p_partkey || '-' || unnest(generate_series(1, {PART_IMAGES})) || '.png' FROM part
          UNION ALL SELECT p_partkey, 'heading', 'Card ' || unnest({_CARDS}), NULL, NULL FROM part
          UNION ALL SELECT p_partkey, 'text', p_type || ' ' || unnest({_CARDS}), NULL, NULL FROM part
          UNION ALL SELECT p_partkey, 'link', 'More', '/en/item/' || p_partkey || '/' || unnest({_CARDS}), NULL FROM part)
        SELECT page_id, type, text, href, file FROM b""",
)
def structured_blocks(spark, sf):
    return blocks.content_blocks(part_dom(spark, sf, ("page_id",))).select("page_id", "type", "text", "href", "file")


@query(
    "q59_extraction_summary",
    f"""WITH t AS (SELECT length(p_name || ' | ' || p_brand) + 13 + {PART_CARDS} * (length('Card 1') + length(p_type || ' 1'))
             + CASE WHEN p_size % 5 = 0 THEN length('Body of ' || p_name) ELSE 0 END AS chars,
             3 + {PART_CARDS} + (p_size % 5 = 0)::INT + (p_partkey % 7 IN (0, 1))::INT AS units,
             1 + {PART_IMAGES} AS imgs FROM part)
        SELECT 'component' AS adapter, count(*) AS pages, sum(units)::BIGINT AS instances, sum(chars)::BIGINT AS field_chars,
          sum(imgs)::BIGINT AS images, (SELECT count(*) FROM part WHERE p_partkey = 0) AS home_units, '' AS failures FROM t""",
)
def extraction_summary(spark, sf):
    site = part_pages(spark, sf)
    inst = cut_lineage(components.component_instances(dom.dom_nodes(site, keep=("page_id",))), "instances")
    totals = components.extraction_totals(inst)
    page = F.when(F.col("page_id") == 0, "home").otherwise("other")
    chars = F.aggregate(F.map_values("fields"), F.lit(0), lambda a, v: a + F.length(v))
    gate = extraction_gate(
        inst.select(page.alias("page"), F.explode("images")).select("page"),
        inst.where(F.col("type") == "title").select(page.alias("page"), chars.alias("chars")),
    )
    adapter = dom.adapter_majority(site)
    # every side is one row
    return adapter.select("adapter").crossJoin(totals).crossJoin(
        gate.select("home_units", F.array_join("failures", ",").alias("failures"))
    )


@query(
    "q60_error_markers",
    "SELECT p_partkey AS page_id, 1 AS hits, 'javax.jcr.PathNotFoundException: /x/' || p_partkey || ' --' || '>' AS marker FROM part WHERE p_partkey % 50 = 0",
)
def error_markers(spark, sf):
    return blocks.error_markers(part_pages(spark, sf)).select("page_id", "hits", F.array_join("markers", "|").alias("marker"))


@query(
    "q81_file_names",
    """WITH u AS (SELECT p_partkey, p_name, p_size % 6 AS e, '/img/' || replace(p_name, ' ', '%20') || '+' || p_partkey ||
            CASE p_size % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.svg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '' WHEN 4 THEN '.webp' ELSE '.gif' END AS path FROM part)
        SELECT p_partkey, replace(replace(regexp_extract(path, '([^/]*)$', 1), '%20', '-'), '+', '-') || CASE WHEN e = 3 THEN '.img' ELSE '' END AS file,
          CASE e WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/svg+xml' WHEN 4 THEN 'image/webp' WHEN 5 THEN 'image/gif' ELSE 'image/jpeg' END AS mime,
          lower(replace(replace(regexp_extract(path, '([^/]*)$', 1), '%', '-'), '+', '-')) || CASE WHEN e = 3 THEN '.jpg' ELSE '' END AS upload,
          'https://cdn.example:8443/' AS referer, regexp_replace(lower(p_name || ' ' || p_partkey || '!'), '[^a-z0-9-]', '-', 'g') AS node_name,
          e <> 3 AS is_image, 300 + p_partkey % 7 AS width FROM u""",
)
def file_names(spark, sf):
    ext = F.expr("CASE p_size % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.svg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '' WHEN 4 THEN '.webp' ELSE '.gif' END")
    key = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("/img/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+"), key, ext)
    url = F.concat(F.lit("https://cdn.example:8443"), path, F.lit("?w="), (300 + F.col("p_partkey") % 7).cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", "p_name", path.alias("path"), url.alias("url"))
    file = urls.filename_for(F.col("url"))
    return rows.select(
        "p_partkey", file.alias("file"), urls.mime_for(file).alias("mime"), urls.upload_name(F.col("path")).alias("upload"),
        urls.referer(F.col("url")).alias("referer"),
        urls.node_name(F.concat("p_name", F.lit(" "), key, F.lit("!"))).alias("node_name"),
        urls.is_image(F.col("url")).alias("is_image"), urls.width_param(F.col("url")).cast("bigint").alias("width"),
    )


@query(
    "q82_text_functions",
    f"""SELECT doc_id, length({_clean('text')}) AS clean_len, md5(lower({_clean('text')})) AS norm_md5,
          left(text, 255) AS title_255, md5({_hnorm('text')}) AS heading_md5 FROM documents""",
)
def text_functions(spark, sf):
    body = F.col("text")
    return texts(spark, sf).select(
        "doc_id", F.length(text.clean(body)).alias("clean_len"), F.md5(text.norm(body)).alias("norm_md5"),
        text.truncate(body, 255).alias("title_255"), F.md5(text.heading_norm(body)).alias("heading_md5"),
    )


@query(
    "q85_corpus_origin",
    f"SELECT {ORIGIN} AS base FROM pages WHERE {ORIGIN} <> '' ORDER BY page_id LIMIT 1",
)
def corpus_origin(spark, sf):
    return media.corpus_origin(table(spark, sf, "pages"))
