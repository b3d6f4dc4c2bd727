"""Pointer doubling, automaton matching, one-pass labels, mergeable samples, observed writes, capture source, open pivot."""

import json
import os
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siteloom.functions import rules
from siteloom.operators import audit, fingerprint, joins, ranking, tree
from siteloom.plans import load
from siteloom.sources import captures, lists, sinks


def test_nesting_of_any_depth(spark):
    deep = [("deep", i, i - 1 if i else None, f"n{i}", "/m") for i in range(300)]
    flat = [("flat", i, None, f"f{i}", "/m") for i in range(5)] + [("flat", 9, 3, "g9", "/m"), ("flat", 10, 9, "g10", "/m")]
    df = spark.createDataFrame(deep + flat, "page string, idx int, _up int, name string, main_area string").repartition(4)
    got = {(r.page, r.idx): r.parent_path for r in load.nested_paths(df, "page").collect()}
    for i in (0, 1, 2, 17, 299):
        assert got["deep", i] == "/".join(["/m", *(f"n{j}" for j in range(i))])
    assert got["flat", 4] == "/m" and got["flat", 9] == "/m/f3" and got["flat", 10] == "/m/f3/g9"
    loop = spark.createDataFrame([("p", 1, 2, "a", "/m"), ("p", 2, 1, "b", "/m")], df.schema)
    with pytest.raises(ValueError):
        load.nested_paths(loop, "page", rounds=3)


def test_many_rows_of_one_page_stay_apart(spark):
    """No row carries its page: the plan has neither maps nor lists of a page's rows."""
    df = spark.range(8000).select(
        F.lit("p").alias("page"), F.col("id").cast("int").alias("idx"), F.when(F.col("id") % 8 != 0, F.col("id") - 1).cast("int").alias("_up"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("/m").alias("main_area"),
    )
    out = load.nested_paths(df, "page")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "map_from_entries" not in plan
    got = {r.idx: r.parent_path for r in out.collect()}
    assert len(got) == 8000 and got[15] == "/m/" + "/".join(f"n{i}" for i in range(8, 15))


def test_contained_headings_count_as_plain_search():
    hay = "one two three twofold abcabc"
    needles = ["two", "three two", "abca", "", "two", "zzz", "e"]
    assert audit.contained(needles, hay) == sum(n in hay for n in needles)
    assert audit.contained(needles[:2], hay) == 2 and audit.contained([], hay) == 0 and audit.contained([""] * 5, hay) == 5


def test_heading_match_of_missing_pages(spark):
    ref = spark.createDataFrame([("a", h) for h in ("x", "y", "z", "w")] + [("b", "x"), ("c", "q")], "page string, heading string")
    local = spark.createDataFrame([("a", "x y z"), ("c", None)], "page string, text string")
    got = {r.page: (r.headings, r.matched, r.pct, r.status) for r in audit.heading_match(ref, local).collect()}
    assert got == {"a": (4, 3, 75, "fail"), "b": (1, 0, 0, "unscorable"), "c": (1, 0, 0, "unscorable")}


def test_labels_two_hundred_levels_and_many(spark):
    deep = '{"k' + '":{"k'.join(str(i) for i in range(200)) + '":"v"' + "}" * 200
    wide = json.dumps({f"g{i}": {f"l{j}": f"v{i}-{j}" for j in range(100)} for i in range(1000)})
    odd = '{"a":{"n":1.50,"t":true,"z":null,"l":[1,"x",{"b":2}],"e":{},"u":"é\\"","big":12345678901234567890},"":{"k":"v"}}'
    df = spark.createDataFrame([("d", deep), ("w", wide), ("o", odd), ("x", '{"a":1,"a":2}'), ("y", "[1]"), ("n", None), ("b", "{")], "lang string, json string")
    got = lists.flatten_labels(df)
    assert got.where("lang = 'w'").count() == 100_000 and got.where("lang in ('x', 'y', 'n', 'b')").count() == 0
    assert [(r.key, r.value) for r in got.where("lang = 'd'").collect()] == [(".".join(f"k{i}" for i in range(200)), "v")]
    assert {(r.key, r.value) for r in got.where("lang = 'o'").collect()} == {
        ("a.n", "1.5"), ("a.t", "true"), ("a.z", "null"), ("a.l", '[1,"x",{"b":2}]'), ("a.u", 'é"'), ("a.big", "12345678901234567890"), ("k", "v"),
    }


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    for keys, n in ((["g"], 15), ([], 5)):
        found = [sorted(r.id for r in ranking.bottom_k(df.repartition(p), keys, "id", 5).collect()) for p in (1, 4, 13)]
        assert found[0] == found[1] == found[2] and len(found[0]) == n
    halves = ranking.bottom_k(df.where("id < 500"), [], "id", 5).union(ranking.bottom_k(df.where("id >= 500"), [], "id", 5))
    assert sorted(r.id for r in ranking.bottom_k(halves, [], "id", 5).collect()) == found[0]


def test_tallies_are_taken_on_the_write(spark, tmp_path):
    df = spark.createDataFrame([("ok",), ("ok",), ("failed",), ("skipped",), (None,)], "status string")
    got = sinks.write_observed(df, str(tmp_path / "o"), **sinks.run_metrics())
    assert got == {"total": 5, "ok": 2, "failed": 1, "skipped": 1} and spark.read.parquet(str(tmp_path / "o")).count() == 5


def test_patterns_need_their_text(spark):
    assert fingerprint.required_text(r"/etc\.clientlibs/") == ("/etc.clientlibs/", True)
    assert fingerprint.required_text(r'class="[^"]*\bwp-') == ('class="', False)
    assert fingerprint.required_text(r"\bsxa\b") == ("sxa", False) and fingerprint.required_text("a|b") == fingerprint.required_text("a.c") == ("", False)
    pages = ["x sxa y", "xsxay", "/etcxclientlibs/", "/etc.clientlibs/", '<p class="a wp-x">', 'class="" wp-', "cq:", "acq:", "drupal-settings-json Drupal", None, ""]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    got = df.select("html", fingerprint.signature_hits(F.col("html")).alias("s")).collect()
    for r in got:
        for s, (_, patterns) in zip(r.s, rules.SIGNATURES):
            assert s.hits == (None if r.html is None else sum(bool(re.search(p, r.html)) for p in patterns))


def test_capture_source(spark, tmp_path):
    one, two = tmp_path / "curated", tmp_path / "crawl"
    one.mkdir()
    (two / "h.example" / "en").mkdir(parents=True)
    (one / "a%20b.html").write_bytes(b"curated \xff\xc3\xa9")
    (two / "h.example" / "en" / "news.html").write_text("news")
    (two / "h.example" / "en" / "skip.txt").write_text("x")
    (two / "h.example" / "empty.html").write_text("")
    got = {r.slug: (r.url, r.html) for r in captures.captures(spark, str(one), str(two)).collect()}
    assert got == {"a b": (None, "curated é"), "news": ("https://h.example/en/news", "news"), "empty": ("https://h.example/empty", "")}
    assert captures.capture_tree(spark, str(tmp_path / "none")).count() == 0
    files = captures.listed(str(two))
    assert [len(p.paths) for p in captures.portions(files, 1)] == [1, 1] and [len(p.paths) for p in captures.portions(files, 1 << 20)] == [2]
    assert captures.capture_tree(spark, str(two), portion="1").rdd.getNumPartitions() == 2


def test_capture_stream_takes_each_file_once(spark, tmp_path):
    src, out, state = (tmp_path / n for n in ("in", "out", "state"))
    src.mkdir()

    def run(**options):
        df = captures.capture_stream(spark, str(src), **options)
        df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(str(out)), "file")

    for i in range(5):
        (src / f"{i}.html").write_text(f"t{i}")
        os.utime(src / f"{i}.html", ns=(10**9 * (i + 1), 10**9 * (i + 1)))
    assert run() == [(f"{i}.html", f"t{i}") for i in range(5)]
    (src / "9.html").write_text("later")
    assert run(files="2") == [*[(f"{i}.html", f"t{i}") for i in range(5)], ("9.html", "later")] and run() == run()


def test_written_captures_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a/b/c.html", "x é"), ("d.html", None)], "file string, html string")
    captures.write_captures(df, str(tmp_path / "t"))
    captures.write_captures(df, str(tmp_path / "t"))
    assert rows(captures.capture_tree(spark, str(tmp_path / "t")), "file") == [("a/b/c.html", "x é"), ("d.html", "")]


def test_pricing_table_is_open(spark):
    df = spark.createDataFrame([("t", "A", ["H1", "H2"], ["1", "2", "3"]), ("t", "B", ["H1"], ["9"]), ("u", "A", ["Z", "Z"], ["first", "second"])], "tbl string, label string, h array<string>, c array<string>")
    cells = tree.labelled_cells(df, ["tbl", "label"], F.col("c"), F.col("h"))
    got = {(r.tbl, r.label): (r.cells, r.headers) for r in tree.pricing_table(cells, ["tbl"]).collect()}
    assert got == {("t", "A"): ({"H1": "1", "H2": "2", "3": "3"}, ["H1", "H2", "3"]), ("t", "B"): ({"H1": "9"}, ["H1"]), ("u", "A"): ({"Z": "first"}, ["Z"])}


def test_fallback_chains_over_references(spark):
    cards = spark.createDataFrame([(1, "x", "own"), (2, "x", ""), (3, "y", None), (4, None, None)], "id int, ref string, title string")
    targets = spark.createDataFrame([("x", "target", "img"), ("z", "t", "i")], "uuid string, name string, image string")
    got = tree.filled_or_referenced(cards, "ref", targets, "uuid", {"shown": ["title", "ref.name", F.lit("-")], "pic": ["ref.image"]})
    assert rows(got.select("id", "shown", "pic"), "id") == [(1, "own", "img"), (2, "target", "img"), (3, "-", None), (4, "-", None)]


def test_headings_are_counted_page_by_page():
    """Of an Arrow batch one page at a time is held as Python objects."""
    import tracemalloc

    import pyarrow as pa

    n = 3000
    heads = [[f"heading {i} {j}" for j in range(40)] for i in range(n)] + [["a", None], ["a", "b", "c", "d"]]
    texts = [" ".join(own[:20]) for own in heads[:n]] + ["a", None]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n + 2)), pa.array([len(h) for h in heads]), pa.array(heads), pa.array(texts)], names=["_key", "headings", "_headings", "text"]
    )
    want = [sum(h in t for h in own) for own, t in zip(heads[:n], texts)] + [1, 0]
    del heads, texts
    tracemalloc.start()
    (out,) = list(audit._count_contained([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("matched").to_pylist() == want
    assert peak < 3_000_000


def test_growing_lookups_are_not_broadcast(spark):
    """Small files may hold very many keys: lookups whose both sides grow are merge joins whatever the files' size."""
    from siteloom.sources.pages import spread

    left = spark.createDataFrame([(1, "p", "f"), (2, "q", "g")], "id int, page string, file string")
    media = spark.createDataFrame([("p", 0, "f", "/a"), ("z", 0, "g", "/b")], "page string, seq int, file string, target_path string")
    site = spark.createDataFrame([(1, "shop/p")], "seq int, path string")
    for found in (
        joins.tiered_lookup(left, media, ["file"], [["page"], []], ["page", "seq"], ["target_path"], skew=False),
        joins.slug_lookup(left, "page", site),
    ):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    salted = joins.tiered_lookup(left, media, ["file"], [["page"], []], ["page", "seq"], ["target_path"])
    assert salted._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2
    assert rows(salted.select("id", "target_path", "match_tier"), "id") == [(1, "/a", 1), (2, "/b", 2)]
    assert spread(spark.range(100), "id", rows=10).rdd.getNumPartitions() == 10
