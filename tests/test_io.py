import json
from pathlib import Path

from pyspark.sql import functions as F

from conftest import rows
from siteloom.sources import lists, manifests, pages, sinks
from siteloom.streaming import ingest


def test_captured_pages(spark, tmp_path):
    cur, crawl = tmp_path / "captured", tmp_path / "_crawl"
    cur.mkdir()
    (crawl / "h.example" / "en").mkdir(parents=True)
    (cur / "news.html").write_bytes(b"curated \xff\xc3\xa9")
    (crawl / "h.example" / "fr-FR.html").write_text("root")
    (crawl / "h.example" / "en" / "news.html").write_text("crawled")
    (crawl / "h.example" / "en" / "about.html").write_text("about")
    (crawl / "h.example" / "en" / "skip.txt").write_text("x")
    got = {r.slug: (r.url, r.html) for r in pages.captured_pages(spark, str(cur), str(crawl)).collect()}
    assert got == {"news": (None, "curated é"), "home": ("https://h.example/fr-FR", "root"), "about": ("https://h.example/en/about", "about")}


def test_sitemap_comment_rules(spark, tmp_path):
    (tmp_path / "s.txt").write_text("home\r\n# note\n\nnews/a  # inline\nnews/b\n")
    lines = lists.read_lines(spark, str(tmp_path / "s.txt"))
    assert [r.path for r in lists.sitemap(lines).orderBy("seq").collect()] == ["home", "news/a", "news/b"]
    assert [r.path for r in lists.sitemap(lines, inline_comments=False).orderBy("seq").collect()] == ["home", "news/a  # inline", "news/b"]
    assert [(r.section, r.pages) for r in lists.section_rollup(lists.sitemap(lines)).collect()] == [("home", 1), ("news", 2)]


def test_labels(spark, tmp_path):
    doc = json.dumps({"a": {"b": {"c": "x"}, "d": 1}, "e": "y", "f": {}})
    df = spark.createDataFrame([("en", doc)], "lang string, json string")
    assert sorted(rows(lists.flatten_labels(df))) == [("en", "a.b.c", "x"), ("en", "a.d", "1"), ("en", "e", "y")]
    (tmp_path / "l.properties").write_text("# c=1\nns_type=Type\nns_type.p\\:q = A = B\n")
    got = rows(lists.property_labels(lists.read_lines(spark, str(tmp_path / "l.properties")), "en"))
    assert got == [("en", "ns_type", "Type"), ("en", "ns_type.p:q", "A = B")]


def test_manifests(spark, tmp_path):
    def put(name, doc):
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
        return str(tmp_path / name)

    media = put("m.json", {"base": "b", "pages": {"p": [{"src": "/1", "file": "1.png", "role": "hero"}, {"src": "/2", "file": "2.png"}]}})
    items = manifests.media_items(manifests.read_json(spark, media, manifests.MEDIA))
    assert rows(items.select("page", "seq", "file", "alt"), "seq") == [("p", 0, "1.png", None), ("p", 1, "2.png", None)]
    imported = put("i.json", {"p": [{"src": "/1", "targetPath": "/dam/1.png"}, {"file": "z", "targetPath": None}]})
    got = manifests.imported_items(manifests.read_json_map(spark, imported, manifests.IMPORTED, "pages"))
    assert rows(got.select("file", "target_path"), "seq") == [("1.png", "/dam/1.png"), ("z", None)]
    fp = put("f.json", {"a": {"t": 5, "i": 1, "h2": ["x"]}, "b": {"error": "500"}})
    assert rows(manifests.fingerprints(manifests.read_json_map(spark, fp, manifests.FINGERPRINTS, "pages")).select("page", "t", "error"), "page") == [("a", 5, None), ("b", None, "500")]
    folders = put("c.json", {"folders": {"z": {"type": "n", "urlPrefixes": ["n"]}, "a": {"type": "e"}}})
    got = rows(manifests.folder_rows(manifests.read_json(spark, folders, manifests.FOLDERS)).select("ord", "folder", "type"), "ord")
    assert got == [(0, "z", "n"), (1, "a", "e")]
    comps = put("k.json", {"components": [{"nodeType": "n:a", "sources": ["x"]}, {"nodeType": "n:b", "needsMainResource": True}]})
    assert rows(manifests.component_manifest(manifests.read_json(spark, comps, manifests.COMPONENTS)).select("ord", "nodeType", "needsMainResource"), "ord") == [(0, "n:a", None), (1, "n:b", True)]
    plan = put("p.json", {"epics": [{"id": "e", "stories": [{"id": "s", "steps": [{"id": "1"}, {"id": "2", "depends_on": ["1"]}]}]}]})
    assert rows(manifests.plan_steps(manifests.read_json(spark, plan, manifests.PLAN)).select("epic", "story", "step", "depends_on"), "step") == [("e", "s", "1", None), ("e", "s", "2", ["1"])]
    page = put("g.json", {"page": "p", "hero": {"heading": "H"}, "blocks": [{"body": ["a", "b"], "dark": True}, {"heading": "x"}]})
    units = manifests.page_units(manifests.read_json(spark, page, manifests.PAGE)).select("name", "heading", "body", "dark")
    assert rows(units, "name") == [("block-0", "", "ab", True), ("block-1", "x", "", False), ("hero", "H", None, None)]


def test_crawl_log_and_cache(spark):
    log = ["  HTTP/1.1 200 OK https://h/a", "HTTP/2 404 x https://h/b y", "HTTP/1.1 429 https://h/a", "HTTP/1.1 503 https://h/b", "noise"]
    df = spark.createDataFrame([(x,) for x in log], "value string")
    assert rows(lists.crawl_errors(df)) == [("https://h/a",), ("https://h/b",)]
    assert lists.throttled(df).first().throttled == 2
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    cache = spark.createDataFrame([("a", "x"), ("b", "")], "cache_key string, body string")
    assert rows(pages.cached_bodies(req, cache).select("cache_key", "hit"), "cache_key") == [("a", True), ("b", False), ("c", False)]


def test_sinks(spark, tmp_path):
    media = spark.createDataFrame([("p", 2, "s2", "f2", "hero", ""), ("p", 1, "s1", "f1", "card", "")], "page string, seq int, src string, file string, role string, alt string")
    sinks.write_media_manifest(media, str(tmp_path / "m"))
    back = spark.read.json(str(tmp_path / "m")).first()
    assert [x.file for x in back.media] == ["f1", "f2"]
    sinks.write_content(media.withColumn("host", F.lit("h")), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2 and (tmp_path / "c" / "host=h").is_dir()
    lines = spark.createDataFrame([(i, f"row {i:03d}") for i in range(200, 0, -1)], "o int, value string")
    sinks.write_report(lines, str(tmp_path / "r"), header=["# Title", ""], order=("o",))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split("\n")[:4] == ["# Title", "", "row 001", "row 002"] and text.rstrip().endswith("row 200")
    sinks.write_type_baseline(spark.createDataFrame([("b",), ("a",), ("b",)], "type string"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).orderBy("value").collect()] == ["a", "b"]


def put_pages(spark, folder, name, data):
    df = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    df.toPandas().to_parquet(folder / name)
    return df.schema


def test_incremental_pages_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = put_pages(spark, src, "1.parquet", [(1, "https://h/a", "1"), (2, "https://h/a", "2"), (3, "https://h/b", "3")])
    put_pages(spark, src, "2.parquet", [(4, "https://h/b", "4"), (5, "https://h/c?x=1", "5"), (6, "https://h/c?x=2", "6")])
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    stream = ingest.page_stream(spark, str(src), schema, per_trigger=1)
    ingest.incremental_pages(stream, store, state).awaitTermination()
    assert rows(spark.read.parquet(store).select("page_id"), "page_id") == [(1,), (3,), (5,), (6,)]
    put_pages(spark, src, "3.parquet", [(7, "https://h/a", "7"), (8, "https://h/d", "8")])
    ingest.incremental_pages(ingest.page_stream(spark, str(src), schema, per_trigger=1), store, state).awaitTermination()
    assert rows(spark.read.parquet(store).select("page_id"), "page_id") == [(1,), (3,), (5,), (6,), (8,)]


def test_ingest_without_url_or_order(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    data = [(None, "https://h/a", "1"), (2, None, "2"), (3, None, "3"), (None, "https://h/b", "4"), (5, "https://h/b", "5")]
    later = [(6, None, "6"), (7, "https://h/a", "7")]
    for batch, want in ((data, [("1",), ("2",), ("3",), ("5",)]), (later, [("1",), ("2",), ("3",), ("5",), ("6",)])):
        df = spark.createDataFrame(batch, "page_id long, url string, html string")
        df.coalesce(1).write.mode("append").parquet(str(src))
        stream = ingest.page_stream(spark, str(src), df.schema)
        ingest.incremental_pages(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
        assert rows(spark.read.parquet(str(tmp_path / "s")).select("html"), "html") == want


def test_ingest_rejects_bad_captures(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = put_pages(spark, src, "1.parquet", [(1, "https://h/a", ""), (2, "https://h/b", "<title>Just a moment...</title>")])
    put_pages(spark, src, "2.parquet", [(3, "https://h/a", "good"), (4, "https://h/b", "good")])
    stream = ingest.page_stream(spark, str(src), schema, per_trigger=1)
    ingest.incremental_pages(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "s")).select("page_id"), "page_id") == [(3,), (4,)]


def test_labels_of_any_depth(spark):
    deep = '{"k' + '":{"k'.join(str(i) for i in range(20)) + '":"v"' + "}" * 20
    got = rows(lists.flatten_labels(spark.createDataFrame([("en", deep), ("fr", '{"a{":"}{"}')], "lang string, json string")), "lang")
    assert got == [("en", ".".join(f"k{i}" for i in range(20)), "v"), ("fr", "a{", "}{")]


def test_forced_ingest_keeps_everything_new(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = put_pages(spark, src, "1.parquet", [(1, "https://h/a", "1")])
    put_pages(spark, src, "2.parquet", [(2, "https://h/a", "2")])
    stream = ingest.page_stream(spark, str(src), schema, per_trigger=1)
    ingest.incremental_pages(stream, str(tmp_path / "s"), str(tmp_path / "c"), force=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_incremental_upserts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = put_pages(spark, src, "1.parquet", [(1, "a", "1"), (2, "b", "1")])
    put_pages(spark, src, "2.parquet", [(2, "b", "2"), (1, "a", "1"), (3, "c", "1")])
    store = str(tmp_path / "store")
    stream = ingest.page_stream(spark, str(src), schema, per_trigger=1)
    ingest.incremental_upserts(stream, lambda b: b, store, str(tmp_path / "c"), ["url"], ["html"]).awaitTermination()
    assert rows(ingest.read_latest(spark, store, ["url"], ["html"]), "url") == [("a", "1"), ("b", "2"), ("c", "1")]
    assert spark.read.parquet(store).where("batch = 1").count() == 2  # the unchanged row is not written again


def test_ingest_cost_follows_the_batch(spark, tmp_path, monkeypatch):
    """Twenty batches of new pages and one old one each: files read per batch do not grow, results equal a batch run."""
    from siteloom.streaming import runs

    read = []
    looked = runs.KeyRuns.lookup

    def recorded(self, keys, before):
        out = looked(self, keys, before)
        read.append(sum(Path(f.removeprefix("file:")).stat().st_size for f in self.opened))
        return out

    monkeypatch.setattr(runs.KeyRuns, "lookup", recorded)
    src, per = tmp_path / "in", 40
    src.mkdir()
    for b in range(20):
        data = [(b * 1000 + i, f"https://h/{b}/{i}", f"{b} {i}") for i in range(per)] + [(b * 1000 + 500, f"https://h/{b // 2}/1", "again"), (b * 1000 + 600, None, "no url")]
        schema = put_pages(spark, src, f"{b:02}.parquet", data)
        stream = ingest.page_stream(spark, str(src), schema, per_trigger=1)
        ingest.incremental_pages(stream, str(tmp_path / "s"), str(tmp_path / "c"), capacity=16).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "s")).select("page_id"), "page_id")
    assert got == sorted((b * 1000 + i,) for b in range(20) for i in [*range(per), 600])
    assert len(read) == 20 and max(read[16:]) < 4 * max(read[1:5])
    index = runs.KeyRuns(spark, str(tmp_path / "s-index"), ["cache_key"])
    assert index.runs(20) == [(2, 15), (1, 19)] and index.batches() == 20


def test_ingest_repeats_a_batch(spark, tmp_path):
    """The same batch again, after a crash, gives the same store; equal rows and ties do not matter."""
    from siteloom.streaming import runs

    data = [(1, "https://h/a", "x"), (1, "https://h/a", "x"), (1, "https://h/a", "y"), (2, "https://h/b", "z"), (None, None, "t"), (None, None, "t")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    kept = []
    for order in (df, df.orderBy(F.desc("html")).repartition(3)):
        src = tmp_path / f"in{len(kept)}"
        order.write.parquet(str(src))
        root = tmp_path / f"out{len(kept)}"
        for _ in range(2):
            stream = ingest.page_stream(spark, str(src), df.schema)
            ingest.incremental_pages(stream, str(root / "s"), str(root / "c")).awaitTermination()
            for f in (root / "c" / "commits").glob("*"):
                f.unlink()
        kept.append(rows(spark.read.parquet(str(root / "s")).select("page_id", "html"), "html"))
    assert kept[0] == kept[1] and len(kept[0]) == 3
    assert runs.KeyRuns(spark, str(tmp_path / "x"), ["k"], fan=4).runs(27) == [(2, 15), (1, 19), (1, 23), (0, 24), (0, 25), (0, 26)]


def test_upserts_over_many_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    want = {}
    for b in range(9):
        data = [(i, f"k{i}", f"{b}" if i % (b + 1) == 0 else "0") for i in range(0, 60, 1 + b % 3)]
        want |= {u: h for _, u, h in data}
        schema = put_pages(spark, src, f"{b}.parquet", data)
        stream = ingest.page_stream(spark, str(src), schema, per_trigger=1)
        ingest.incremental_upserts(stream, lambda x: x, str(tmp_path / "s"), str(tmp_path / "c"), ["url"], ["html"], capacity=8).awaitTermination()
    assert dict(rows(ingest.read_latest(spark, str(tmp_path / "s"), ["url"], ["html"]))) == want


def test_keyed_stream(spark, tmp_path):
    src = tmp_path / "in"
    data = [(i, None if i % 10 == 0 else f"https://h/{i % 7}", "x") for i in range(60)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("at", F.timestamp_seconds(F.col("page_id") + 1_000_000_000))
    df.orderBy(F.desc("page_id")).repartition(5).write.parquet(str(src))
    for force, want in ((False, 6 + 7), (True, 60)):
        stream = ingest.page_stream(spark, str(src), df.schema, per_trigger=2)
        out = ingest.keyed_pages(stream, "at", "1 hour", force=force)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / f"o{force}")).option("checkpointLocation", str(tmp_path / f"c{force}"))
        q.trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"o{force}")).count() == want


def part_files(folder):
    return sum(1 for p in Path(folder).glob("part-*"))


def table_of_files(spark, folder, name, rows, schema, files=4):
    """A table as a folder of several files."""
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def test_upserts_from_a_folder_of_files(spark, tmp_path):
    """The table may be one file or a folder of them."""
    from siteloom import catalog

    catalog.load_all()
    data = [(i, f"text {i}", "en", "web", i * 2) for i in range(1, 41)]
    sf = table_of_files(spark, tmp_path, "documents", data, "doc_id long, text string, lang string, source string, n_chars long")
    got = rows(catalog.QUERIES["q46_incremental_upserts"](spark, sf).select("path", "title", "n_chars"))
    assert sorted(got) == sorted((f"/news/web-{i}", f"text {i}", i * 2) for i in range(1, 41) if i % 6)


def test_batches_are_written_by_all_tasks(spark, tmp_path):
    """No task writes, and none therefore reads, a whole batch of captures."""
    from siteloom import catalog
    from siteloom.session import stage_folder

    catalog.load_all()
    data = [(i, f"https://h/{i // 2}", f"<p>{i}</p>") for i in range(1, 241)]
    sf = table_of_files(spark, tmp_path, "pages", data, "page_id long, url string, html string")
    stages = Path(stage_folder(spark).removeprefix("file:"))
    before = set(stages.glob("batches-*"))
    got = dict(rows(catalog.QUERIES["q46_many_batches"](spark, sf).select("cache_key", "page_id")))
    want = {}
    for i in sorted(range(1, 241), key=lambda i: (i % 12, i)):
        want.setdefault(f"h/{i // 2}.html" if i % 9 else f"row:{i}", i)
    again = {f"row:{i + 1000000}": i + 1000000 for i in range(1, 241) if i % 5 == 0 and i % 9 == 0}
    assert got == want | again
    (root,) = set(stages.glob("batches-*")) - before
    assert part_files(root / "in" / "00") > 1
