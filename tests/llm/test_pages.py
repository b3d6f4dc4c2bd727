"""Main text of pages: markup rules, templates counted per host, and a plain recount of the same rule."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siteloom.llm import site_templates
from siteloom.llm.site_templates import main_text, parse, site_text, subtrees

from .conftest import DATA, passage

SCHEMA = "page_id long, url string, html string"


def plain(html, template=None):
    found, events = parse(html)
    return main_text(found, events, [template is not None and e.hash in template for e in found])


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_markup():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar no-js">
      <header><h1>Site</h1></header><nav>Menu</nav><div id="cookieNotice">Cookies</div><div class="AdBanner">Buy</div>
      <article><header><h1>Title &amp; more</h1></header><script>var t="</p>";</script><p>One <b>two<br>three&nbsp;four
      <p>Five &lt;b&gt; &#233; 2 < 3 <!-- no <p>no</p> --><ul><li>a<li>b</ul><aside>Side</aside><form><p>Name <input></form>
      <div class="share-buttons">Share</div><table><tr><td>x<td>y</table>
      <section class="comments"><article class="comment"><p>I think so</article></section><footer>By me</footer></article>
      <div hidden>Hidden</div><section id="respond">Reply</section><footer>&copy; x</footer></body></html>"""
    assert plain(page).split("\n\n") == ["Title & more", "One two three four", "Five <b> é 2 < 3", "a", "b", "x", "y"]


@pytest.mark.parametrize("html", ["", "<", "<p", "</p>", "<!--", "<a href='x", "<script>x", "<b><i></b>", "&amp", "\0", "<p>" * 3000, "<div>" * 3000 + "x"])
def test_broken_markup_does_not_fail(html):
    assert isinstance(plain(html), str)
    subtrees(*parse(html))


def test_without_article_links_only_blocks_go():
    assert plain("<body><div>Real text here with <a href=x>link</a></div><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></body>") == (
        "Real text here with link"
    )
    assert plain("<main><p>Main text</p></main><p>Else</p>") == "Main text"
    assert plain("plain text only\n here") == "plain text only here"
    assert plain("<article><p>short</p></article><article><p>the longer one</p></article>") == "the longer one"


def site():
    """No telling names: what recurs over a host's pages must be found by counting."""
    rows = []
    for i in range(30):
        body = f"<div class=x1><p>{passage(i + 50, 30)}</p>" + ("<p>A passage that a few pages quote</p>" if i < 6 else "") + "</div>"
        rows.append((i, f"https://user@A.example:80/{i}", f"<body><div class=x0>Our shop <span>since 1900</span></div>{body}<div class=x2>All rights</div></body>"))
    notice = "<div>Put into each article</div>"
    for i in range(30, 60):
        quoted = "<p>Quoted by a third</p>" if i % 3 == 0 else ""
        rows.append((i, f"http://b.example/{i}", f"<article>{notice}<p>{passage(i + 50, 30)}</p>{quoted}</article>"))
    for i in range(60, 100):  # copies of one article count as one page
        rows.append((i, "http://b.example/copy", f"<article><p>{passage(7, 30)}</p><p>Second</p></article>"))
    rows += [(100, None, "<body><div class=x0>Our shop <span>since 1900</span></div></body>"), (101, "http://b.example/n", None), (102, "http://b.example/e", "")]
    rows += [(103, "http://c.example/", f"<article><p>{passage(9, 100000)}</p></article>"), (None, "http://c.example/", "<article>x</article>")]
    return rows


@pytest.mark.parametrize("most", [500_000, 0])
def test_templates_of_a_host(spark, most):
    got = texts(site_text(spark.createDataFrame(site(), SCHEMA).repartition(5), most=most))
    for i in range(30):
        assert got[i] == passage(i + 50, 30) + ("\n\nA passage that a few pages quote" if i < 6 else "")
    for i in range(30, 60):
        assert got[i] == passage(i + 50, 30) + ("\n\nQuoted by a third" if i % 3 == 0 else "")
    assert {got[i] for i in range(60, 100)} == {passage(7, 30) + "\n\nSecond"}
    assert got[100] == "Our shop since 1900" and got[101] == got[102] == "" and got[103] == passage(9, 100000) and got[None] == "x"


def recount(rows, min_pages, share, article_share):
    """The operator's rule with dictionaries."""
    pages = [(i, u, *parse(h or "")) for i, u, h in rows]
    host = lambda u: (u or "").split("//")[-1].split("/")[0].split("@")[-1].split(":")[0].lower()
    seen, told = defaultdict(set), defaultdict(set)
    for _, u, found, events in pages:
        hashes, inside, page = subtrees(found, events)
        told[host(u)].add(page)
        for h, own in zip(hashes, inside):
            seen[host(u), h, own].add(page)
    out = {}
    for i, u, found, events in pages:
        inside = site_templates._regions(found)
        template = []
        for e, own in zip(found, inside):
            n = len(seen.get((host(u), e.hash, own), ()))
            enough = n >= min_pages and n >= len(told[host(u)]) * (article_share if own else share)
            template.append(bool(host(u)) and enough and e.tag in site_templates._BLOCKS and e.tag not in site_templates._WHOLE and e.size > 0)
        out[i] = main_text(found, events, template)
    return out


def test_recount(spark):
    rows = site()
    assert texts(site_text(spark.createDataFrame(rows, SCHEMA), 5, 0.1, 0.4)) == recount(rows, 5, 0.1, 0.4)


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
def test_recount_of_the_table(spark):
    pages = spark.read.parquet(str(DATA / "pages.parquet"))
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert texts(site_text(pages, 2, 0.01, 0.5)) == recount(rows, 2, 0.01, 0.5)


def test_nothing_and_clashing_columns(spark):
    names = ("host", "known", "row", "subtree", "inside", "page", "pages", "n")
    df = spark.createDataFrame(site()[:3], SCHEMA).select("*", *[F.lit(n).alias(n) for n in names], F.lit("old").alias("text"))
    got = site_text(df)
    assert got.columns == ["page_id", "url", *names, "text", "n_chars"]
    assert all(r[n] == n for r in got.collect() for n in names) and all(r.n_chars == len(r.text) and r.text != "old" for r in got.collect())
    assert site_text(spark.createDataFrame([], SCHEMA)).count() == 0
