from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conftest import rows
from siteloom.operators import joins, listing, ranking, tree, upsert
from siteloom.operators.redirects import redirect_map, unmatched
from siteloom.plans import load
from siteloom.session import checkpoint_root, cut_lineage


def hot_table(spark, n=3000):
    """A third of all rows share one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"), (F.col("id") * 7919 % 1009).alias("v"), "id"
    )


def test_row_numbers_match_a_window(spark):
    df = hot_table(spark)
    for by in ([], ["k"]):
        got = ranking.number_rows(df, [F.col("v").desc(), "id"], by)
        window = W.partitionBy(*by).orderBy(F.col("v").desc(), "id")
        assert got.withColumn("w", F.row_number().over(window)).where("w <> rn").count() == 0
        assert got.count() == 3000


def test_row_numbers_with_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, v int")
    assert sorted(rows(ranking.number_rows(df, ["v"], ["g"])), key=str) == [("a", 5, 1), (None, 1, 1), (None, 2, 2)]


def test_stage_tables_belong_to_the_application(spark):
    root = checkpoint_root(spark)
    stored = cut_lineage(spark.range(5), "probe")
    assert stored.count() == 5
    file = stored.inputFiles()[0]
    assert spark.sparkContext.applicationId in file and root.split(":")[-1] in file


def test_pick_and_top(spark):
    df = hot_table(spark)
    want = rows(df.groupBy("k").agg(F.min("v").alias("v")), "k")
    assert rows(ranking.pick(df, ["k"], ["v", "id"]).select("k", "v"), "k") == want
    assert ranking.top_n(df, ["k"], ["v", "id"], 2).groupBy("k").count().where("count > 2").count() == 0


def test_salted_join_equals_plain_join(spark):
    left = hot_table(spark)
    right = spark.range(0, 97, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    hot = joins.hot_keys(left, ["k"], share=0.1)
    assert hot.count() == 1
    for how in ("left", "inner"):
        salted = joins.skew_join(left, right, ["k"], how, hot=hot).select("k", "v", "id", "x")
        assert rows(salted, "id") == rows(left.join(right, "k", how).select("k", "v", "id", "x"), "id")


def test_tiered_lookup(spark):
    left = spark.createDataFrame([(1, "p", "f"), (2, "q", "f"), (3, "p", "g"), (4, "p", None)], "i int, page string, file string")
    right = spark.createDataFrame([("o", 1, "f", "o/f"), ("p", 2, "f", "p/f2"), ("p", 1, "f", "p/f1"), ("z", 0, "h", "z")], "page string, seq int, file string, t string")
    got = rows(joins.tiered_lookup(left, right, ["file"], [["page"], []], ["page", "seq"], ["t"]).select("i", "t", "match_tier"), "i")
    assert got == [(1, "p/f1", 1), (2, "o/f", 2), (3, None, None), (4, None, None)]


def test_prefix_classify_against_brute_force(spark):
    paths = ["News/a", "news", "news/2020/b", "blog/x", "newsroom/y", "/news/2020/", "other"]
    prefixes = [("news/2020", "old", 2), ("NEWS", "news", 1), ("blog/", "blog", 0)]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    pre = spark.createDataFrame(prefixes, "prefix string, folder string, ord int")
    got = dict(rows(joins.prefix_classify(df, "path", pre, "prefix", "folder", "ord").select("path", "folder")))

    def brute(p):
        for pref, folder, _ in sorted(prefixes, key=lambda x: x[2]):
            if p.strip("/").lower().startswith(pref.strip("/").lower() + "/"):
                return folder

    assert got == {p: brute(p) for p in paths}


def test_slug_lookup_prefers(spark):
    site = spark.createDataFrame([(1, "a/x"), (2, "b/X"), (3, "c")], "seq int, path string")
    slugs = spark.createDataFrame([("x",), ("home",), ("nope",), ("A/X",)], "slug string")
    last = dict(rows(joins.slug_lookup(slugs, "slug", site).select("slug", "target_path")))
    assert last == {"x": "/home/b/X", "home": "/home", "nope": "/home/nope", "A/X": "/home/a/x"}
    first = dict(rows(joins.slug_lookup(slugs, "slug", site, prefer="first").select("slug", "target_path")))
    assert first["x"] == "/home/a/x"


def test_positional_zip(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, a int")
    right = spark.createDataFrame([(1, 7), (2, 8), (2, 9)], "k int, b int")
    for bounded in (True, False):
        assert rows(joins.positional_zip(left, right, ["k"], ["a"], ["b"], "left", bounded).select("k", "pos", "a", "b"), "k", "pos") == [(1, 1, 10, 7), (1, 2, 20, None), (2, 1, 5, 8)]


def test_pairing_flags_the_home_fallback(spark):
    pages = spark.createDataFrame([("/home/a/b.html",), ("x/c",), ("zzz",), ("/",)], "page string")
    caps = spark.createDataFrame([("a-b",), ("c",), ("home",)], "slug string")
    got = dict((r[0], r[1:]) for r in rows(joins.pair_reference(pages, caps)))
    assert got == {"/home/a/b.html": ("a-b", "path"), "x/c": ("c", "leaf"), "zzz": ("home", "fallback_home"), "/": ("home", "path")}


NODES = [("u1", "/s/a", ["x"], "news", 5, "A"), ("u2", "/s/b", ["y", "x"], "blog", 9, ""), ("u3", "/s", ["x"], "news", 1, "R"), ("u4", "/sx/c", ["x"], "news", 7, "C"), ("u5", "/s/d", [], "news", 9, "D")]


def node_frame(spark):
    return spark.createDataFrame(NODES, "uuid string, path string, categories array<string>, primary_type string, created int, title string")


def test_listing(spark):
    n = node_frame(spark)
    paths = lambda **k: [r.path for r in listing.listing(n, **k).collect()]
    assert paths(root="/s") == ["/s/b", "/s/d", "/s/a"]
    assert paths(root="/s", limit=0) == ["/s/b", "/s/d", "/s/a"] and paths(root="/s/", limit=2, direction="asc") == ["/s/a", "/s/b"]
    assert paths(exclude=["u1", "u2", None], root="/s") == ["/s/d"]
    assert paths(categories=["y", None]) == ["/s/b"] and len(paths(categories=[None])) == 5
    closure = tree.type_closure(spark.createDataFrame([("news", "content"), ("blog", "content"), ("content", "node")], "name string, supertype string"))
    assert len(paths(closure=closure, type="node")) == 5 and len(paths(closure=closure, type="blog")) == 1


def test_listing_prefix_reaches_the_scan(spark, tmp_path):
    node_frame(spark).write.parquet(str(tmp_path / "n"))
    plan = listing.listing(spark.read.parquet(str(tmp_path / "n")), root="/s", limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,/s/)" in plan and "TakeOrderedAndProject" in plan


def test_paginate_slots_facets(spark):
    df = spark.range(1, 15).select("id", (F.col("id") % 3).alias("c"), F.array(F.lit("a")).alias("categories"))
    got = rows(listing.paginate(df, ["id"], 6, F.col("c") != 0).select("id", "rn", "page_no", "remaining"), "id")
    assert got[0] == (1, 1, 0, 4) and got[6] == (10, 7, 1, 0) and len(got) == 10
    assert rows(listing.slots(df.select("id"), ["id"], ["big", "small", "small"])) == [(1, 1, "big"), (2, 2, "small"), (3, 3, "small")]
    f = spark.createDataFrame([(1, "a", "Ah"), (2, "a", "Other"), (3, "", "x"), (4, None, "y"), (5, "b", " ")], "i int, v string, l string")
    assert rows(listing.facets(f, {"t": ("v", "l")}, "i"), "value") == [("t", "a", "Ah", 2), ("t", "b", "b", 1)]
    counted = listing.facets(df.withColumn("l", F.lit("x")), {"c": ("c", "l")}, "id").agg(F.sum("n")).first()[0]
    assert counted == df.where("c IS NOT NULL").count()
    assert listing.apply_facets(df, {"categories": "a", "c": 1}).count() == 5 and listing.apply_facets(df, {"c": None}).count() == 14
    assert listing.parse_facet("newsTheme|Topic") == ("newsTheme", "Topic", "theme") and listing.parse_facet("Le Pays") == ("Le Pays", "Le Pays", "le-pays")


def test_facet_attributes_of_many_types(spark, tmp_path):
    from siteloom import catalog

    catalog.load_all()
    names = [f"Kind {i}" for i in range(1200)] + ["newsTheme", "My TYPE", "É-x", None]
    spark.createDataFrame([(n,) for n in names], "p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_type: (r.attr, r.n) for r in catalog.QUERIES["q98_facet_attributes"](spark, str(tmp_path)).collect()}
    assert got == {n: (listing.parse_facet(n)[2] if n else None, 1) for n in names}


def test_category_members_are_all_there(spark):
    df = spark.createDataFrame([("a", 3), (None, 1), ("a", 2), ("", 5), (None, 4)], "c string, id int")
    got = rows(listing.category_members(df, "c", [-F.col("id")], ["id"]), "c", "position")
    assert got == [("", 1, 5), ("", 2, 4), ("", 3, 1), ("a", 1, 3), ("a", 2, 2)]


def test_facet_columns_last_wins(spark):
    cats = spark.createDataFrame([("1", "/t/themes/a", "a", "A"), ("2", "/t/themes/b", "b", None), ("3", "/t/types/c", "c", "C")], "category_uuid string, path string, name string, title string")
    n = spark.createDataFrame([("n1", ["1", "2", "zz"]), ("n2", ["3"]), ("n3", [])], "uuid string, categories array<string>")
    got = {r.uuid: r for r in listing.facet_columns(n, cats, {"theme": "themes", "type": "types"}).collect()}
    assert (got["n1"].theme_name, got["n1"].theme_title, got["n1"].type_name) == ("b", "b", None)
    assert got["n2"].type_title == "C" and got["n3"].theme_name is None


def test_closure_survives_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "b")], "name string, supertype string")
    got = {(r.type, r.ancestor): r.depth for r in tree.type_closure(edges).collect()}
    assert got[("a", "d")] == 2 and got[("d", "b")] == 1 and ("b", "a") not in got and len(got) == 11


def test_breadcrumbs(spark):
    n = spark.createDataFrame([("/home", "H", "home", "page"), ("/home/a", "", "a", "page"), ("/home/a/b", "B", "b", "list"), ("/home/a/b/c", "C", "c", "page")], "path string, title string, name string, t string")
    got = rows(tree.breadcrumbs(n, "/home", F.col("t") == "page"), "path", "depth")
    assert got == [("/home/a", 1, "/home/a", "a"), ("/home/a/b/c", 1, "/home/a", "a"), ("/home/a/b/c", 3, "/home/a/b/c", "C")]


def test_navigation_helpers(spark):
    df = spark.createDataFrame([("/a", "/a/b"), ("/a", "/ab"), ("/a", "/a")], "p string, cur string")
    assert [r[0] for r in df.select(tree.is_active(F.col("p"), F.col("cur"))).collect()] == [True, False, True]
    wide = spark.createDataFrame([(1, "10", "x", None, "y", "", "z")], "i int, f1 string, l1 string, f2 string, l2 string, f3 string, l3 string")
    assert rows(tree.wide_to_rows(wide, ["i"], {1: ("f1", "l1"), 2: ("f2", "l2"), 3: ("f3", "l3")}, ("figure", "label"))) == [(1, 1, "10", "x")]


def test_upsert_is_idempotent(spark):
    want = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    have = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, v string")
    plan = upsert.upsert_plan(want, have, ["k"], ["v"])
    assert rows(plan.select("k", "action"), "k") == [(1, "create"), (2, "update"), (3, "unchanged"), (4, "orphan")]
    again = upsert.upsert_plan(want, upsert.apply_plan(plan, delete_orphans=True), ["k"], ["v"])
    assert again.where("action <> 'unchanged'").count() == 0


def test_publish_refs_translations(spark):
    e = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "k int, last_modified int")
    v = spark.createDataFrame([(2, 4), (3, 5), (4, 1)], "k int, last_modified int")
    assert rows(upsert.publish_plan(e, v, ["k"]), "k") == [(1, "publish_new"), (2, "publish_changed"), (3, "in_sync"), (4, "unpublish")]
    refs = spark.createDataFrame([("p", "x"), ("q", "y"), ("r", "x")], "path string, target_uuid string")
    assert rows(upsert.dangling_refs(refs, spark.createDataFrame([("y",)], "uuid string")), "path") == [("p", "x"), ("r", "x")]
    edit = spark.createDataFrame([("n", "en", "t"), ("n", "fr", "t"), ("m", "en", "t"), ("m", "fr", "")], "uuid string, lang string, value string")
    live = spark.createDataFrame([("n", "en", "t"), ("n", "fr", "")], "uuid string, lang string, value string")
    assert rows(upsert.translation_gaps(edit, live), "uuid", "lang") == [("m", "en", "missing_node"), ("n", "fr", "missing_translation")]


def test_redirects(spark):
    old = spark.createDataFrame([("/fr-FR",), ("/en/show",), ("/fr-FR/news/",), ("/en/gone",), ("https://h.example/fr/news.html?x=1",)], "old_url string")
    nodes = spark.createDataFrame([("/home",), ("/home/news",), ("/home/expo",)], "path string")
    aliases = spark.createDataFrame([("en", "show", "expo"), ("fr", "show", "nowhere")], "lang string, alias string, path string")
    got = redirect_map(old, nodes, aliases, "/home")
    assert {r.old_url: (r.lang, r.target, r.match_type) for r in got.collect()} == {
        "/fr-FR": ("fr", "/home", "home"), "/en/show": ("en", "/home/expo", "alias"), "/fr-FR/news/": ("fr", "/home/news", "direct"),
        "/en/gone": ("en", None, None), "https://h.example/fr/news.html?x=1": ("fr", "/home/news", "direct"),
    }
    assert unmatched(got).count() == 1


def test_start_nodes(spark):
    folders = spark.createDataFrame([(0, "news", "/c/n1"), (1, "news", "/c/n2"), (2, "blog", "/c/b")], "ord int, type string, path string")
    pages = spark.createDataFrame([(0, "latest", "/c/n2")], "ord int, page string, path string")
    q = spark.createDataFrame([("/home/x/latest/main/q", "news"), ("/home/the-latest/main/q", "news"), ("/home/y/main/q", "news"), ("/home/y/main/b", "blog"), ("/z", "other")], "path string, type string")
    got = {r.path: (r.target, r.rule) for r in load.start_node_plan(q, folders, pages).collect()}
    assert got == {
        "/home/x/latest/main/q": ("/c/n2", "listing page"), "/home/the-latest/main/q": ("/c/n2", "listing page"),
        "/home/y/main/q": ("/c/n1", "first folder"), "/home/y/main/b": ("/c/b", "only folder"),
    }


def test_type_map_last_declaration_wins(spark):
    m = spark.createDataFrame([(0, "n:a", None, None, ["X", "Y"]), (1, "n:b", "page", True, ["x"])], "ord int, nodeType string, areaType string, isContainer boolean, sources array<string>")
    assert {r.source: (r.node_type, r.is_container) for r in load.type_map(m).collect()} == {"x": ("n:b", True), "y": ("n:a", False)}


def test_areas(spark):
    df = spark.createDataFrame([("n:mainNav", "absolute"), ("n:topic", "absolute"), ("n:x", "page"), ("n:x", None)], "t string, a string")
    got = [r[0] for r in df.select(load.area_path(F.col("t"), F.col("a"), F.lit("/home/p/main"), "/home")).collect()]
    assert got == ["/home/nav", "/home/topic", "/home/p/main", "/home/p/main"]


def test_load_plan_nests_and_skips(spark):
    im = "array<struct<file:string,alt:string>>"
    inst = spark.createDataFrame(
        [
            ("home", 0, "Grid", None, False, {}, [], []),
            ("home", 1, "card", 0, True, {"a": " T ", "b": ""}, [("x.png", "")], [("go", "http://e")]),
            ("home", 2, "unknown", 0, False, {"a": "z"}, [], []),
            ("home", 3, "card", 2, True, {"a": "deep"}, [], []),
            ("home", 4, "card", None, True, {}, [], []),
            ("sub", 0, "foot", None, False, {"a": "z"}, [], []),
        ],
        f"page string, idx int, type string, parent int, is_item boolean, fields map<string,string>, images {im}, links array<struct<text:string,href:string>>",
    )
    manifest = spark.createDataFrame([(0, "n:grid", "page", True, ["grid"]), (1, "n:card", "page", False, ["CARD"]), (2, "n:foot", "absolute", False, ["foot"])], "ord int, nodeType string, areaType string, isContainer boolean, sources array<string>")
    props = spark.createDataFrame([("n:grid", [], [], ["c"]), ("n:card", ["heading"], ["startNode", "image"], ["heading", "image", "imageAltText", "ctaLabel", "linkType"])], "node_type string, text array<string>, weakref array<string>, names array<string>")
    media = spark.createDataFrame([("other", 0, "x.png", "/dam/x")], "page string, seq int, file string, target_path string")
    site = spark.createDataFrame([(1, "sub")], "seq int, path string")
    got = {r.idx: r for r in load.load_plan(inst, manifest, props, media, site).collect()}
    assert set(got) == {0, 1, 3}
    assert got[1].parent_path == "/home/main/grid-home-0" and got[3].parent_path == "/home/main"
    assert got[1].props == {"heading": "T", "image": "/dam/x", "imageAltText": "image", "ctaLabel": "go", "linkType": "external"}
    assert got[1].node_path == "/home/main/grid-home-0/card-home-1"


def test_layered_inheritance_counts_pairs_not_paths(spark):
    layers = [[f"t{i}_{j}" for j in range(5)] for i in range(10)]
    edges = [(a, b) for low, high in zip(layers, layers[1:]) for a in low for b in high] + [("x", "y"), ("y", "x")]
    closure = tree.type_closure(spark.createDataFrame(edges, "name string, supertype string"))
    assert closure.where("type like 't%'").count() == 50 + sum(5 * 5 * (9 - i) for i in range(9))
    assert sorted((r.type, r.ancestor, r.depth) for r in closure.where("type in ('x', 'y')").collect()) == [
        ("x", "x", 0), ("x", "y", 1), ("y", "x", 1), ("y", "y", 0)
    ]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("siteloom")]
