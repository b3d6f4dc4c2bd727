from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from siteloom.functions import css, dates, text, urls


def one(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_filename(spark):
    got = one(
        spark,
        ["/a/b%20c.JPG?w=3", "https://h/x/pic.png#f", "//cdn/x/y", "https://h/", "/a/b+c.svg", "/a/50%.gif", "/a;p/b.webp;q"],
        urls.filename_for,
    )
    assert got == ["b-c.JPG", "pic.png", "y.img", "image.img", "b-c.svg", "50-.gif", "b.webp"]


@pytest.mark.parametrize("base", ["https://h.example/a/b/c.html?x=1#y", "http://h.example", "https://h.example:81/a/"])
def test_resolve_follows_the_standard(spark, base):
    refs = ["", "#t", "?q=2", "x.png", "./x.png", "../x.png", "../../../x.png", "/r/./s/../t", "//cdn.example/z", "https://o/p", "a/..", "data:x"]
    df = spark.createDataFrame([(base, r) for r in refs], "b string, r string")
    got = [x[0] for x in df.select(urls.resolve(F.col("b"), F.col("r"))).collect()]
    want = [urljoin(base, r) for r in refs]
    if base.count("/") == 2:  # an empty base path counts as '/'
        want[2] = got[2]
    assert got == want


def test_slug_and_paths(spark):
    assert one(spark, ["https://h/fr", "https://h/fr-FR.html", "https://h/", "https://h/en/a/b.html?x#y"], urls.page_slug) == ["home", "home", "home", "b"]
    assert one(spark, ["/fr-FR/a/b", "en/x", "/fr", "/france/x"], urls.strip_locale) == ["a/b", "x", "", "france/x"]
    assert one(spark, ["/a/b/c", "", "/"], urls.path_prefixes) == [["/a", "/a/b", "/a/b/c"], [], []]
    assert one(spark, ["/home/a/b/main/hero", "/home/main/hero", "/home"], lambda c: urls.page_key_of_node(c, "/home")) == ["a/b", "home", "home"]


def test_srcset_and_width(spark):
    got = one(spark, ["a 480w, b 2000w", "a 2x, b 2x", "a", "a 5q, b", "", None], urls.largest_srcset)
    assert got == ["b", "b", "a", "b", None, None]
    assert one(spark, ["/x?w=5", "/x?a=1&w=70", "/x?ww=3", "/x"], urls.width_param) == [5, 70, 0, 0]


def test_role_order(spark):
    df = spark.createDataFrame([("/partenaires/logo-x.png",), ("/logo-site.png",), ("/logo.png",), ("/a/hero/icon.png",), ("/a.png",)], "u string")
    got = [r[0] for r in df.select(urls.role_for(F.col("u"), F.lit(None), F.lit("")).alias("r")).collect()]
    assert got == ["partner", "logo", "partner", "hero", "content"]


def test_cache_key(spark):
    values = ["https://h.example/a/b?x=1", "https://h.example/a/", "localhost", "http://localhost/a b"]
    assert one(spark, values, lambda c: urls.cache_key(c, True)) == ["h.example/a/b", "h.example/a/index.html", "localhost.html", "localhost/a_b.html"]
    new = one(spark, ["https://h.example/a?x=1", "https://h.example/a?x=2", "https://h.example/a"], urls.cache_key)
    assert len(set(new)) == 3 and new[2] == "h.example/a"


def test_partner_names(spark):
    got = one(spark, ["A/Logo-Media/logo-acme_corp.png", "x/LOGO_BIG NAME 3.svg", "x/McDuck-Ltd.png", "x/logo.png"], urls.partner_name)
    assert got == ["Acme Corp", "Big Name", "McDuck Ltd", "logo"]
    assert one(spark, ["A/Nouveaux-logos-medias/x", "A/Logo-Salon/x", "z"], urls.partner_category) == ["medias", "salons", "medias"]


def test_text(spark):
    assert one(spark, ["  a \n b ", None], text.clean) == ["a b", ""]
    assert one(spark, ["É́tat  d’œuvre ﬁn", "ÀÉÎ-Ça"], text.heading_norm) == ["etat d oeuvre fin", "aei ca"]
    assert one(spark, ["É́tat  d’œuvre ﬁn №", None], text.heading_norm_exact) == ["etat d oeuvre fin no", None]
    assert one(spark, ["Été!\n - \n a  b"], text.heading_lines) == [["ete", "", "a b"]]
    df = spark.createDataFrame([("", None, "c"), (None, "b", "c")], "x string, y string, z string")
    assert [r[0] for r in df.select(text.first_filled("x", "y", "z")).collect()] == ["c", "b"]
    assert one(spark, ["a", "q"], lambda c: text.label_or_self(c, {"a": "Label"})) == ["Label", "q"]
    assert one(spark, ["&amp;lt; &lt;b&gt; &copy;"], text.unescape) == ["&lt; <b> ©"]
    assert one(spark, ["&eacute;&thinsp;&#233;"], text.unescape_exact) == ["é é"]
    doc = "<body>x<main class=a>y<b>z</b></main></body>"
    assert one(spark, [doc, "<body>q</body>", "plain"], lambda c: text.region(c, "main")) == ["y<b>z</b>", "", ""]
    assert one(spark, [doc, "<body>q</body>", "plain"], lambda c: text.region(c, "main", "body")) == ["y<b>z</b>", "q", "plain"]
    assert one(spark, [" a | b ", "  "], lambda c: text.title_clean(c, F.lit("slug"))) == ["a b", "slug"]


def test_dates(spark):
    values = ["Du 5/3/2021 au 7/3/2021", "31/02/2020", "none", None]
    assert one(spark, values, dates.dmy_to_iso) == ["2021-03-05T00:00:00.000", "2020-02-31T00:00:00.000", None, None]
    assert [x and x.isoformat() for x in one(spark, values, dates.dmy_to_timestamp)] == ["2021-03-05T00:00:00", None, None, None]
    assert one(spark, ["2024-08-09", "soon"], dates.localized) == ["09 août 2024", "soon"]


def test_colors(spark):
    got = one(spark, ["#FFF", "#abcd", "#A1B2C3", "rgb(1,2,3)", "rgba(100%, 50%, 0, 0.5)", "rgba(300,-5,2.5,1)", "rgb(1,2)"], css.canon)
    assert got == ["#ffffffff", "#aabbccdd", "#a1b2c3ff", "#010203ff", "#ff800080", "#ff0002ff", None]
    assert one(spark, ["#000000ff"], lambda c: css.contrast(c, F.lit("#ffffffff"))) == pytest.approx([21.0])
    assert one(spark, ["#ff0000ff", "#808080ff"], css.saturation) == [1.0, 0.0]


def test_source_kind_and_mime(spark):
    assert one(spark, ["", "/files/x", "/static/a", "/other"], urls.image_source_kind) == ["empty", "repository", "fallback", "repository"]
    assert one(spark, ["a.PNG", "b.jpeg", "c.svg", "d"], urls.mime_for) == ["image/png", "image/jpeg", "image/svg+xml", "image/jpeg"]
    assert one(spark, ["test-home", "my-old-page", "latest", "Untitled"], urls.is_debris) == [True, True, False, True]
