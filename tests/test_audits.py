import pytest
from pyspark.sql import functions as F

from conftest import rows
from siteloom.functions import rules
from siteloom.operators import audit, components, coverage, tokens
from siteloom.plans import article
from siteloom.plans import audit as plans
from siteloom.plans import load


def ladder(spark, cases):
    local = spark.createDataFrame([(n, lt, li) for n, (lt, li, *_), _ in cases], "page string, text_len int, imgs int")
    ref = spark.createDataFrame([(n, r[0], r[1], r[2]) for n, (_, _, r), _ in cases if r], "page string, t int, i int, error string")
    return {r["page"]: r for r in audit.audit_pages(local, ref, "expo").collect()}


def test_ladder(spark):
    cases = [
        ("expo/x", (10, 0, (9000, 0, None)), "N/A-NEW"),
        ("none", (10, 0, None), "N/A"),
        ("err", (10, 0, (None, None, "500")), "N/A-REF"),
        ("invented", (401, 0, (119, 0, None)), "FABRICATED"),
        ("invented0", (500, 0, (0, 0, None)), "FABRICATED"),
        ("stub", (139, 0, (400, 0, None)), "STUB"),
        ("edge", (1764, 0, (5024, 0, None)), "THIN"),
        ("thin", (239, 9, (400, 9, None)), "THIN"),
        ("images", (400, 1, (400, 9, None)), "MISSING-IMG"),
        ("ok", (720, 6, (400, 0, None)), "OK"),
        ("ok6", (240, 0, (400, 6, None)), "OK"),
        ("seven", (400, 0, (400, 7, None)), "REVIEW"),
        ("long", (721, 0, (400, 0, None)), "REVIEW"),
        ("small", (100, 0, (300, 0, None)), "REVIEW"),
        ("empty", (0, 0, (0, 0, None)), "REVIEW"),
    ]
    got = ladder(spark, cases)
    assert {n: got[n]["class"] for n, _, _ in cases} == {n: c for n, _, c in cases}
    assert [got[n]["severity"] for n in ("invented", "thin", "seven", "ok")] == [3, 2, 1, 0]
    assert "x0.35" in got["edge"]["note"] and "x99.00" in got["empty"]["note"]


# fixed values: text and image counts of a recorded site audit with the class each page was given
RECORDED = [
    ("STUB", 1885, 12454, 115, 117), ("MISSING-IMG", 4247, 5048, 88, 103), ("THIN", 1270, 2688, 4, 5),
    ("MISSING-IMG", 1393, 941, 1, 81), ("THIN", 1383, 2496, 2, 5), ("THIN", 2399, 4423, 3, 5),
    ("THIN", 1764, 5024, 3, 5), ("THIN", 1476, 2956, 1, 2), ("THIN", 1842, 3941, 1, 13),
    ("THIN", 1752, 3676, 3, 6), ("THIN", 4013, 9241, 4, 19), ("REVIEW", 1702, 801, 1, 2),
    ("REVIEW", 10308, 508, 23, 20), ("REVIEW", 2817, 3899, 4, 11), ("OK", 1628, 1239, 1, 3),
    ("OK", 1237, 1239, 1, 3), ("OK", 3964, 3737, 3, 2), ("OK", 8438, 13418, 8, 10),
    ("OK", 3244, 3719, 5, 3), ("N/A-REF", 1451, None, 1, None), ("OK", 903, 706, 1, 5),
    ("OK", 78, 53, 1, 1), ("OK", 6639, 10001, 7, 11), ("OK", 1059, 1278, 3, 8),
    ("N/A-NEW", 953, None, 1, None), ("N/A-NEW", 1320, None, 3, None), ("N/A-NEW", 883, None, 1, None),
    ("N/A-NEW", 953, None, 1, None), ("N/A-NEW", 1006, None, 1, None), ("N/A-NEW", 1960, None, 2, None),
    ("N/A-NEW", 1120, None, 1, None),
]


def test_recorded_audit(spark):
    cases = []
    for i, (cls, lt, rt, li, ri) in enumerate(RECORDED):
        name = f"expo/{i}" if cls == "N/A-NEW" else f"p{i}"
        ref = None if cls == "N/A-NEW" else (rt, ri, "500" if cls == "N/A-REF" else None)
        cases.append((name, (lt, li, ref), cls))
    got = ladder(spark, cases)
    assert [got[n]["class"] for n, _, _ in cases] == [c for _, _, c in cases]


def test_report(spark):
    got = audit.audit_pages(
        spark.createDataFrame([("b", 1, 0), ("a", 100, 0), ("c", 1, 0)], "page string, text_len int, imgs int"),
        spark.createDataFrame([("a", 100, 0, None), ("c", 900, 0, None)], "page string, t int, i int, error string"),
    )
    lines = [r.value for r in audit.report_lines(got).collect()]
    assert [x.split("`")[1] for x in lines] == ["c", "a", "b"] and lines[2].count("|") == 9
    assert rows(audit.class_counts(got))[0][1] == 1


def test_headings(spark):
    ref = spark.createDataFrame([("p", h) for h in ["un", "deux", "trois", "quatre"]] + [("q", "x"), ("r", "a"), ("r", "b"), ("r", "c")], "page string, heading string")
    local = spark.createDataFrame([("p", "un deux trois"), ("r", "a b c")], "page string, text string")
    got = {r.page: (r.matched, r.pct, r.status) for r in audit.heading_match(ref, local).collect()}
    assert got == {"p": (3, 75, "fail"), "q": (0, 0, "unscorable"), "r": (3, 100, "pass")}
    card = audit.score_card(audit.heading_match(ref, local)).first()
    assert (card.passed, card.failed, card.unscorable, card.ok) == (1, 1, 1, False)
    none = audit.score_card(audit.heading_match(ref, local).where("status = 'unscorable'")).first()
    assert none.ok is False


def test_half_even_percentage(spark):
    ref = spark.createDataFrame([("p", f"h{i}") for i in range(8)], "page string, heading string")
    local = spark.createDataFrame([("p", "h0")], "page string, text string")
    assert audit.heading_match(ref, local).first().pct == 12  # 12.5


def test_section_gate(spark):
    schema = "page string, headings array<string>, max_cards int, facet_options array<string>, imgs int"
    ref = spark.createDataFrame([("p", ["Alpha", "Beta", "Gamma", "abc"], 10, ["One", "Two"], 10), ("q", ["A b"], 2, [], 3)], schema)
    loc = spark.createDataFrame([("p", ["gamma", "beta", " ALPHA "], 4, ["one"], 5), ("q", ["a  B"], 0, [], 0)], schema)
    got = {r.page: r for r in audit.section_gate(ref, loc).collect()}
    assert got["p"].fails == ["listing shortfall 4 vs 10"]
    assert got["p"].warns == ["missing 1 facet values", "image shortfall 5 vs 10", "section order differs"]
    assert got["q"].fails == [] and got["q"].warns == []


def test_coverage_drift_labels(spark):
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "key string")
    alias = spark.createDataFrame([("top-bar", "bar")], "alias string, canonical string")
    assert rows(coverage.coverage(k("bar", "nav", "x", "x"), k("top-bar"), "key", alias, ignored=k("x"))) == [("nav",)]
    assert sorted(rows(coverage.drift(k("a", "b"), k("b", "c"), "key"))) == [("a", "new"), ("c", "dropped")]
    labels = spark.createDataFrame([("en", "a"), ("fr", "a"), ("en", "b"), ("de", "b")], "lang string, key string")
    assert sorted(rows(coverage.label_gaps(k("a", "b", "c"), labels, ["fr", "en"]))) == [("b", "fr"), ("c", "en,fr")]


def test_contract(spark):
    exp = spark.createDataFrame([("s1", "produces", "a"), ("s2", "consumes", "a"), ("s2", "consumes", "b"), ("s1", "produces", "c"), ("s3", "consumes", "zz")], "step string, direction string, artifact string")
    obs = spark.createDataFrame([("a", True, 20, '{"pages": {}}'), ("b", True, 9, '{"x": 1}'), ("c", True, 2, "{}")], "artifact string, exists boolean, size int, json string")
    got = {(r.step, r.artifact): (r.producer, r.reason) for r in coverage.contract_check(exp, obs).collect()}
    assert got == {("s1", "a"): (None, "no pages"), ("s2", "a"): ("s1", "no pages"), ("s1", "c"): (None, "empty (2b)"), ("s3", "zz"): (None, "missing")}
    orphans = coverage.orphan_artifacts(exp.where("direction = 'produces'"), exp.where("direction = 'consumes'"))
    assert rows(orphans.select("artifact")) == [("c",)]


@pytest.mark.parametrize(
    "body, want",
    [("[ ]", "empty array"), ("{  }", "empty object"), ("[1]", None), ('{"pages": {"a": 1}}', None), ("{oops", "unreadable JSON"), (None, None)],
)
def test_stub_reason(spark, body, want):
    df = spark.createDataFrame([(True, 10, body)], "e boolean, s int, j string")
    assert df.select(coverage.stub_reason(F.col("e"), F.col("s"), F.col("j"))).first()[0] == want


def test_population_rate_gate(spark):
    folders = spark.createDataFrame([("/a", "contentFolder", "n"), ("/b", "page", "n"), ("/c", None, "n"), ("/d", "contentFolder", "n"), ("/e", "contentFolder", "n")], "path string, folder_type string, child_type string")
    kids = spark.createDataFrame([("/a", "n", "PUBLISHED"), ("/a", "m", "PUBLISHED"), ("/d", "n", "NEW")], "parent_path string, primary_type string, status string")
    got = {r.path: (r.children, r.published, r.failure) for r in coverage.folder_population(folders, kids).collect()}
    assert got["/a"] == (1, 1, None) and got["/d"] == (1, 0, "none published") and got["/e"][2] == "no children"
    assert got["/b"][2] == "not a content folder" and got["/c"][2] == "folder missing"
    imp = spark.createDataFrame([("home", None), ("x", "t"), ("x", None)], "page string, target_path string")
    rate = {r.page: (r.wanted, r.imported, r.failure) for r in coverage.import_rate(imp).collect()}
    assert rate == {"home": (1, 0, "nothing imported for home"), "x": (2, 1, None), None: (3, 1, "import largely failed")}
    media = spark.createDataFrame([("x",)] * 4, "page string")
    units = spark.createDataFrame([("home", 499)], "page string, chars int")
    assert len(coverage.extraction_gate(media, units).first().failures) == 3


def test_shapes_hooks_duplicates(spark):
    rec = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "x", "x"]), ("c", ["z"]), ("d", ["z"]), ("e", ["x", "q"])], "type string, names array<string>")
    got = sorted(rows(components.shape_duplicates(rec, F.col("names"))))
    assert got == [("x,y", "a", 2), ("x,y", "b", 2)]
    views = spark.createDataFrame([("v", "title"), ("v", "text"), ("w", "title"), ("w", "field-title"), ("v", "both")], "view string, token string")
    css = spark.createDataFrame([("field-title",), ("field-both",), ("both",), ("text",)], "token string")
    assert rows(components.hook_orphans(views, css)) == [("v", "title")]
    dup = spark.createDataFrame([("t", "v", "f1"), ("t", "v", "f2"), ("t", "w", "f3")], "t string, v string, s string")
    assert rows(components.duplicate_keys(dup, ["t", "v"], "s")) == [("t", "v", 2, "f1", "f2")]


def test_article_core(spark):
    im = "array<struct<file:string,alt:string>>"
    inst = spark.createDataFrame(
        [
            ("p", 0, "title", {}, []),
            ("p", 1, "title", {"titre": "A | B", "quand": "le 3/4/2021", "lead": " x "}, [("h.jpg", "alt")]),
            ("p", 2, "rich", {"title": "a b", "description": "plain"}, []),
            ("p", 3, "rich", {"title": "Sub", "content": "<p>html</p>"}, []),
            ("p", 4, "other", {"title": "no"}, []),
            ("q", 0, "rich", {}, []),
        ],
        f"page string, idx int, type string, fields map<string,string>, images {im}",
    )
    got = {r.page: r for r in article.article_core(inst, {"title": "titre", "date": "quand", "summary": "lead"}, body_types=("rich",), key="page").collect()}
    p = got["p"]
    assert (p.title, p.date, p.publish_date, p.summary, p.hero_file, p.hero_alt) == ("A B", "2021-04-03T00:00:00.000", None, "x", "h.jpg", "alt")
    assert p.body == "<p>plain</p>\n<h2>Sub</h2>\n<p>html</p>"
    assert got["q"].title == "q" and got["q"].body == "<p>q</p>"


def test_repair(spark):
    data = [("/n/1", "/files/live/sites/s/files/a/x.jpg"), ("/n/2", "/sites/s/files/a/y.jpg"), ("/n/3", "https://c/Z Q"), ("/n/4", "rel.png"), ("/n/5", "/sites/s/files/a/none.jpg")]
    df = spark.createDataFrame(data, "path string, url string")
    edit = spark.createDataFrame([("/sites/s/files/a/x.jpg", "u1"), ("/sites/s/files/a/y.jpg", "u2")], "path string, uuid string")
    live = spark.createDataFrame([("/sites/s/files/a/x.jpg", "u1"), ("/sites/s/files/a/y.jpg", "other")], "path string, uuid string")
    src = spark.createDataFrame([("y.jpg", "https://src/y")], "file string, src string")
    got = {r.path: (r.action, r.uuid, r.source, r.file) for r in load.image_repair_plan(df, edit, live, src, "s").collect()}
    assert got == {
        "/n/1": ("reference", "u1", None, None), "/n/2": ("reimport", None, "https://src/y", "y-dam.jpg"),
        "/n/3": ("import", None, "https://c/Z Q", "z-q.jpg"), "/n/4": ("fail", None, None, None), "/n/5": ("fail", None, None, None),
    }


SHEET = "#abc p{color:#FFF;background:#FFFFFF}\n.a { color : #111; font-family: Arial,  sans-serif; border-color: rgba(0,0,0,0) }\n.b{color:red;background:#c00;fill:#c00;font-family:Georgia}\n.c{color:#00c;stop-color:#0c0;flood-color:#cc0;font-family:Arial, sans-serif;outline:#777}"


def sheets(spark, css=SHEET):
    return spark.createDataFrame([("f", css)], "file string, css string")


def test_tokens(spark):
    got = {r.token: (r.value, r.uses) for r in tokens.color_tokens(sheets(spark)).collect()}
    assert got == {
        "--color-bg": ("#ffffff", 2), "--color-text": ("#111111", 1), "--color-primary": ("#cc0000", 2), "--color-secondary": ("#0000cc", 1),
        "--color-accent": ("#00cc00", 1), "--color-01": ("#cccc00", 1), "--color-02": ("#777777", 1),
    }
    legacy = tokens.color_tokens(sheets(spark), pattern=rules.COLOR_LEGACY).where("token = '--color-bg'").first()
    assert legacy.uses == 1  # six-digit literals are not seen by the narrow pattern
    fonts = {r.token: r.stack for r in tokens.font_tokens(sheets(spark)).collect()}
    assert fonts == {"--font-body": "Arial, sans-serif", "--font-heading": "Georgia"}


def test_rewrite_is_idempotent(spark):
    s = sheets(spark)
    colors, fonts = tokens.color_tokens(s), tokens.font_tokens(s)
    once = tokens.rewrite_tokens(s, colors, fonts)
    css = once.first().css
    assert css.startswith("#abc p{color:var(--color-bg);background:var(--color-bg)}\n.a { color : var(--color-text); font-family: var(--font-body);")
    assert "rgba(0,0,0,0)" in css and "color:red" in css and "font-family:var(--font-heading)}" in css
    assert tokens.rewrite_tokens(once, colors, fonts).first().css == css
    lines = [r.value for r in tokens.stylesheet_lines(colors, fonts).collect()]
    assert lines[0] == "  --color-primary: #cc0000;" and lines[-1] == "  --font-heading: Georgia;"
    assert tokens.report_lines(colors).first().value == "| `--color-primary` | `#cc0000` | primary |"


def test_content_gate_sample(spark):
    from siteloom.operators.tree import type_closure

    none = {}
    data = [
        ("1", "/sites/s/home/nav", "/sites/s/home", "area", none, none), ("2", "/sites/s/home/nav/x", "/sites/s/home/nav", "text", {"fr": "a"}, {"image": "u"}),
        ("3", "/sites/s/home/test-2", "/sites/s/home", "page", {"fr": "b", "en": "b"}, none),
    ]
    n = spark.createDataFrame(data, "uuid string, path string, parent_path string, primary_type string, titles map<string,string>, refs map<string,string>")
    closure = type_closure(spark.createDataFrame([("text", "content"), ("area", "node"), ("page", "node")], "name string, supertype string"))
    got = {r.check: r.status for r in plans.content_gate(n, closure, "/sites/s", 4).collect()}
    assert got == {"shell:nav": "ok", "shell:footer": "note", "images": "ok", "listings": "fail", "translations": "fail", "cleanup": "fail"}
    sampled = {r.check: r.detail for r in plans.content_gate(n, closure, "/sites/s", 4, sample=1).collect()}
    assert sampled["translations"] == "1 of 1 without a title"
