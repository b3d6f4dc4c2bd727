from pyspark.sql import functions as F

from conftest import rows
from siteloom.operators import blocks, components, dom, fingerprint, media

PAGE = """<!doctype html><html><head><title>T &amp; U</title>
<link rel="Shortcut ICON" href="/fav.ico"><link rel="apple-touch-icon" href="/touch.png"><meta property="og:image" content="/og.png">
<style>.a{background:url("/bg.jpg?w=5")} .b{background:url(/font.woff)}</style><script>var t="</p><p>no";</script></head>
<body><!-- <p>hidden</p> --><nav><p>chrome</p><a href="/n">N</a></nav>
<div style="background-image: url('/inline.png')">x</div>
<h1>Head</h1><p>one <a href="/l">link</a> tail<p>two <b>bold<li>item
<img src="/pic.jpg?w=100" data-src="/lazy.png" srcset="/pic.jpg?w=400 400w, /pic.jpg?w=800 800w" alt=" An  alt ">
<img src="data:image/png;base64,xx"><img src=plain.gif alt=it's><source srcset="/s1.webp 1x, /s2.webp 1x">
<br/><footer><p>end</p></footer></body></html>"""


def page(spark, html, page_id=1, url="https://h.example/en/x"):
    return spark.createDataFrame([(page_id, url, html)], "page_id int, url string, html string")


def test_nesting_and_traps(spark):
    nodes = {r.seq: r for r in dom.dom_nodes(page(spark, PAGE)).collect()}
    tags = [nodes[i].tag for i in range(len(nodes))]
    assert tags.count("p") == 4 and "hidden" not in [n.text for n in nodes.values()]
    title = next(n for n in nodes.values() if n.tag == "title")
    assert title.text == "T & U"
    for n in nodes.values():
        if n.parent is not None:
            assert nodes[n.parent].seq < n.seq <= n.end_seq <= nodes[n.parent].end_seq
            assert n.depth == nodes[n.parent].depth + 1
    first, second = [n for n in nodes.values() if n.tag == "p" and not n.chrome]
    assert first.end_seq < second.seq and first.text == "one link tail"
    assert next(n for n in nodes.values() if n.attrs.get("src") == "plain.gif").attrs["alt"] == "it's"


def test_empty_and_broken_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no tags"), (4, '<p title="never closed')], "page_id int, html string")
    assert dom.dom_nodes(df).count() == 0


def test_parse_runs_once(spark):
    plan = dom.dom_nodes(page(spark, PAGE)).where("tag = 'p'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_blocks(spark):
    got = rows(blocks.content_blocks(dom.dom_nodes(page(spark, PAGE))).select("type", "text", "href", "file", "alt", "seq"), "seq")
    assert [g[0] for g in got] == ["heading", "text", "link", "text", "text", "image", "image"]
    assert got[1][1] == "one link tail" and got[2][1:3] == ("link", "/l")
    assert got[5][3:5] == ("pic.jpg", "An alt") and got[6][3] == "plain.gif"


def test_media_forms(spark):
    got = {r.file: r for r in media.media_refs(dom.dom_nodes(page(spark, PAGE), keep=("page_id", "url"))).collect()}
    assert set(got) == {"touch.png", "og.png", "bg.jpg", "inline.png", "pic.jpg", "lazy.png", "plain.gif", "s2.webp"}
    assert got["pic.jpg"].width == 800 and got["pic.jpg"].src == "https://h.example/pic.jpg?w=800"
    assert got["touch.png"].role == "icon" and got["plain.gif"].src == "https://h.example/en/plain.gif"
    assert sorted(r.seq for r in got.values()) == list(range(1, 9))


def test_width_tie_keeps_the_first(spark):
    df = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 9, 2), (1, "a", 9, 3), (1, "b", 0, 4)], "p int, f string, w int, seq int")
    assert rows(media.best_variant(df, ["p", "f"], "w", ["seq"]).select("f", "seq", "first_pos.seq"), "f") == [("a", 2, 1), ("b", 4, 4)]


GRID = """<div class="component col-12 hero field-own"><div class="component-content"><h2 class="field-title">Big</h2></div></div>
<div class="component picture-grid"><img src="/1.png"><img src="/2.png"><img src="/3.png">
<div class="card"><p class="field-text">A</p><p class="field-text">B</p></div><div class="vignette"><div class="component inner"><a href="/x">X</a></div></div></div>
<div class="card"><img src="/lost.png"></div><div class="component full"><div class="card"><img src="/own.png"></div><img src="/left.png"></div><div class="component bare"></div>"""


def test_instances(spark):
    inst = components.component_instances(dom.dom_nodes(page(spark, GRID))).orderBy("idx").collect()
    by = {(r.type, i): r for i, r in enumerate(inst)}
    types = [r.type for r in inst]
    assert types == ["hero", "picture-grid", "card", "vignette", "inner", "full", "card", "bare"]
    assert by[("hero", 0)].fields == {"own": "Big", "title": "Big"}
    assert [f.file for f in inst[1].images] == ["3.png"]
    assert [[f.file for f in inst[i].images] for i in (2, 3)] == [["1.png"], ["2.png"]]
    assert inst[2].fields == {"text": "A B"} and inst[4].parent == inst[3].idx and inst[3].parent == inst[1].idx
    assert [f.file for f in inst[5].images] == ["left.png"] and [f.file for f in inst[6].images] == ["own.png"]
    assert [r.empty for r in inst] == [False] * 7 + [True]


def test_inventory(spark):
    html = '<div class="component nav row"><a>1</a><a>2</a><a>3</a><i class="fa fa-youtube"></i><div class="component leaf x"><ul><li>1<li>2<li>3</ul></div></div>'
    df = page(spark, html).unionByName(page(spark, html, 2))
    inv = {r.type: r for r in components.component_inventory(components.source_components(dom.dom_nodes(df))).collect()}
    assert inv["nav"].hint == "social link series" and inv["nav"].child_types == 1 and inv["nav"].pages == 2
    assert inv["leaf"].hint == "repeating list items" and inv["leaf"].aliases == 2 and inv["leaf"].pages == 2
    values = {(r.type, r.kind, r.value): r.n for r in components.component_values(components.source_components(dom.dom_nodes(df))).collect()}
    assert values[("nav", "child", "leaf")] == 2 and values[("leaf", "page", "2")] == 1 and values[("leaf", "alias", "x")] == 2


def test_fingerprint(spark):
    html = '<img src="/no"><main id=m><h2>A <i>b</i></h2><img src="/files/a.png"><img src="/static/b.png"><img alt=x><div class="my card">t &amp; u</div></main>'
    r = fingerprint.fingerprint(page(spark, html)).first()
    assert (r.imgs, r.img_real, r.img_fallback, r.img_empty, r.h2, r.blocks, r.text_len) == (3, 1, 1, 1, ["A b"], 1, len("A b t & u"))
    none = fingerprint.fingerprint(page(spark, "<body>x</body>")).first()
    assert (none.text_len, none.imgs) == (0, 0)


def test_platform(spark):
    data = [(1, "a", "/wp-content/ /wp-json/"), (2, "a", "Drupal /sites/default/files"), (3, "b", "/wp-json/"), (4, "c", "x"), (5, "d", "cq: /wp-json/"), (6, "d", "cq: /wp-json/")]
    df = spark.createDataFrame(data, "page_id int, host string, html string")
    got = rows(fingerprint.detect_platform(df, ["host"]).select("host", "platform", "score"), "host")
    assert got == [("a", "drupal", 2), ("b", "generic", 1), ("c", "generic", 0), ("d", "wordpress", 2)]
    assert fingerprint.detect_platform(df, ["host"], sample=1).where("host = 'a'").first().platform == "wordpress"


def test_seo_and_video(spark):
    html = '<title>t</title><meta name=description content=" "><h1>a</h1><h1>b</h1><img src=x>'
    assert fingerprint.seo_baseline(dom.dom_nodes(page(spark, html))).first().missing == ["description", "single_h1", "alt"]
    html = '<div class="component video"><video><source type="video/youtube" src="u"></video></div><div class="component video"><video src="v"></video></div><div class="component video"></div><iframe></iframe>'
    got = rows(fingerprint.video_players(dom.dom_nodes(page(spark, html))).select("section", "playable"), "section")
    assert [g[1] for g in got] == [False, True, False]


def test_signals(spark):
    html = '<ul class="x"><li class="a">1<li class="a">2</ul><div class="grid-1">g</div><div class="b">'
    r = fingerprint.structure_signals(dom.dom_nodes(page(spark, html))).first()
    assert (r.cards, r.max_cards, r.images) == (3, 2, 0)


def test_error_markers(spark):
    html = "<!-- InvalidQueryException: a<b --> javax.jcr.FooException x < PathNotFoundException < repositoryexception"
    r = blocks.error_markers(page(spark, html)).first()
    assert r.hits == 4 and len(r.markers) == 4 and r.markers[0] == "InvalidQueryException: a"
    assert blocks.error_markers(page(spark, "x VendorException: y<"), extra=("VendorException",)).first().markers == ["VendorException: y"]
    assert blocks.error_markers(page(spark, "fine")).count() == 0


def test_adapter(spark):
    df = spark.createDataFrame([(1, '<i class="component x"> field-a'), (2, "x"), (3, 'class="component" field-')], "page_id int, html string")
    assert dom.adapter_majority(df).first().adapter == "component"
    assert dom.adapter_majority(df.where("page_id < 3")).first().adapter == "generic"
    assert df.where(dom.uses_components(F.col("html"))).count() == 2


def test_adjacent_text_is_not_glued(spark):
    html = """<html><body><main><h2>Foo<br>bar</h2><div class="component a"><div class="field-content"><p>One</p><p>Two</p></div></div></main>
<footer><h2>Imprint here</h2></footer></body></html>"""
    nodes = dom.dom_nodes(page(spark, html))
    assert [r.heading for r in blocks.headings(nodes).collect()] == ["foo bar"]
    assert components.component_instances(nodes).first().fields == {"content": "One Two"}
    bare = dom.dom_nodes(page(spark, "<body><h2>Inner part</h2></body><h2>Outer part</h2>"))
    assert [r.heading for r in blocks.headings(bare).where("heading like 'inner%'").collect()] == ["inner part"]


def test_links_in_every_notation(spark):
    html = """<a href='/one'>1</a><a href=/two>2</a><a href="/three?a=1&amp;b=2">3</a><!-- <a href="/no">x</a> --><a name=x>n</a>"""
    assert [r.href for r in blocks.links(dom.dom_nodes(page(spark, html), keep=("page_id", "url"))).orderBy("pos").collect()] == ["/one", "/two", "/three?a=1&b=2"]


def test_media_of_a_page_without_url(spark):
    html = '<img src="/a.png"><img src="b/c.jpg"><img src="https://x.example/d.gif">'
    nodes = dom.dom_nodes(page(spark, html, url=None), keep=("page_id", "url"))
    assert {r.src for r in media.media_refs(nodes).collect()} == {"/a.png", "b/c.jpg", "https://x.example/d.gif"}
    got = {r.src for r in media.media_refs(nodes, origin="https://h.example").collect()}
    assert got == {"https://h.example/a.png", "https://h.example/b/c.jpg", "https://x.example/d.gif"}


def test_large_style_sheet_keeps_its_images(spark):
    html = "<style>" + "x{color:red}" * 25000 + ".a{background:url(/late.png)}</style>"
    assert [r.file for r in media.media_refs(dom.dom_nodes(page(spark, html), keep=("page_id", "url"))).collect()] == ["late.png"]


def test_text_length_with_numeric_entities(spark):
    html = "<main>&#8217; &euro; &#x27; abcd</main>"
    assert fingerprint.fingerprint(page(spark, html)).first().text_len == 10


def test_unclosed_tags_cost_linear_time():
    import time

    for broken in ("<a ", "<!", "<a b='"):
        began = time.perf_counter()
        dom.outline(broken * 100000, "component", "component-content", frozenset())
        assert time.perf_counter() - began < 5


def test_elements_leave_in_portions():
    """A large Arrow batch of pages is read in portions; together they are what each page gives."""
    import pyarrow as pa

    page = "<body>" + "<p class='a'>x <b>y</b></p>" * 100 + "</body>"
    docs = [page, None, "", "<h1>t</h1>" + page * 120, *[page] * 300]
    markers = frozenset(["card"])
    got = list(dom._elements([pa.array(docs)], "component", "component-content", markers))
    assert len(got) > 3 and max(len(part) for part in got) < 120
    whole = dom._to_arrow([dom.outline(doc or "", "component", "component-content", markers) for doc in docs])
    assert pa.concat_arrays(got).equals(whole)
    assert [len(part) for part in dom._elements([pa.array([], pa.string())], "component", "component-content", markers)] == [0]
