"""Main text of web pages: subtrees that recur over a host's pages are its template and go."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import mix, slices

# a comment, a declaration, or a tag (quotes count only after '=')
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>", re.S
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)
_BLOCKS = _CLOSES_P | frozenset("body caption dd dt html li tbody td tfoot th thead tr summary legend option".split())
# an opening tag ends an open one of the first group, unless one of the second stands between them
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
_P_SCOPE = frozenset("article blockquote body div li main section table td th".split())
_NEVER = frozenset(
    "script style xmp iframe noembed noframes textarea title noscript template head nav footer aside form button select dialog menu svg canvas object "
    "audio video map".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead comment comments respond reply replies disqus discussion cookie cookies consent gdpr notice notices notification "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations popup modal overlay widget toolbar "
    "pagination pager skip copyright search".split()
)
_WHOLE = frozenset(["html", "body", "main", "article"])
_NAME = re.compile(r"[A-Z]?[a-z]+|[0-9]+|[A-Z]+")


@dataclass
class Element:
    """One element: its place in the page's events, its parent, and the hash of its subtree."""

    tag: str
    parent: int
    start: int
    junk: bool = False
    region: bool = False
    end: int = 0
    hash: int = 0
    size: int = 0  # characters of text inside
    parts: list[str] = field(default_factory=list)


def _junk(tag: str, attrs: dict[str, str]) -> bool:
    if tag in _NEVER:
        return True
    if tag in _WHOLE or not attrs:
        # reader comments may be marked as articles of their own
        return tag == "article" and any("comment" in attrs.get(a, "").lower() for a in ("class", "id", "itemprop"))
    if attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "style" in attrs and "display:none" in attrs["style"].replace(" ", "").lower():
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = [p.lower() for p in _NAME.findall(name)]
        if not _NAMES.isdisjoint(parts) and parts[0] not in ("has", "with", "no", "without"):
            return True
    return False


def parse(html: str) -> tuple[list[Element], list]:
    """Elements in page order, and the page as events: text, or an element's number (opened: n, closed: ~n)."""
    found: list[Element] = []
    events: list = []
    stack: list[int] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            n = stack.pop()
            e = found[n]
            events.append(~n)
            e.end = len(events)
            e.hash = xxhash.xxh3_64_intdigest(f"<{e.tag}>{''.join(e.parts)}".encode("utf-8", "replace")) >> 1
            e.parts = []
            if stack and e.tag not in _RAW:
                up = found[stack[-1]]
                up.parts.append(f"<{e.hash:x}>")
                up.size += e.size

    def close_nearest(tags, stop) -> None:
        for k in range(len(stack) - 1, -1, -1):
            tag = found[stack[k]].tag
            if tag in tags:
                close(k)
                return
            if tag in stop:
                return

    def text(data: str) -> None:
        if "&" in data:
            data = unescape(data)
        events.append(data)
        words = data.split()
        if words and stack:
            e = found[stack[-1]]
            plain = " ".join(words)
            e.parts.append(plain.replace("<", "<<"))
            e.size += len(plain)

    at = 0
    while True:
        token = _TOKEN.search(html, at)
        if (token.start() if token else len(html)) > at:
            text(html[at : token.start()] if token else html[at:])
        if token is None:
            break
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            close_nearest((tag,), ())
            continue
        if tag in _CLOSES_P:
            close_nearest(("p",), _P_SCOPE)
        if tag in _ENDS:
            close_nearest(*_ENDS[tag])
        body = token[3]
        attrs = {}
        if "=" in body or "hidden" in body:
            for name, double, single, plain in _ATTR.findall(body):
                attrs[name.lower()] = double or single or plain
        if tag in _VOID or body.endswith("/"):
            if tag in ("br", "hr"):
                events.append(" ")
            continue
        n = len(found)
        e = Element(tag, stack[-1] if stack else -1, len(events))
        e.junk = _junk(tag, attrs)
        e.region = tag in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop") == "articleBody"
        e.parts.append(attrs.get("class", ""))
        found.append(e)
        events.append(n)
        stack.append(n)
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            close(len(stack) - 1)
    close(0)
    return found, events


def _regions(found: list[Element]) -> list[bool]:
    """Whether each element lies in an article or main element."""
    inside: list[bool] = []
    for e in found:
        up = e.parent >= 0 and (inside[e.parent] or found[e.parent].region)
        inside.append(up)
    return inside


def subtrees(found: list[Element], events: list) -> tuple[list[int], list[bool], int]:
    """Hashes of a page's block subtrees with text, whether each lies in its article, and what the page is told by.

    The least hash of the blocks of prose tells pages apart: copies of one article have the same, so
    they count as one page when subtrees are counted, and near copies mostly do.
    """
    inside = _regions(found)
    hashes, where, least = [], [], None
    dead: list[bool] = []
    for e, own in zip(found, inside):
        gone = e.junk or (e.parent >= 0 and dead[e.parent])
        dead.append(gone)
        if e.tag not in _BLOCKS or not e.size or e.tag in _WHOLE:
            continue
        hashes.append(e.hash)
        where.append(own)
        if e.tag in ("p", "pre", "blockquote", "h1") and not gone:
            least = e.hash if least is None else min(least, e.hash)
    if least is None:
        least = xxhash.xxh3_64_intdigest("".join(x for x in events if isinstance(x, str)).encode("utf-8", "replace")) >> 1
    return hashes, where, least


def blocks_of(found: list[Element], events: list, gone: list[bool], root: Element | None, links: bool = True) -> list[str]:
    """Text of the blocks below ``root`` (None: the page), without the subtrees that go, white space made single.

    With ``links`` off, blocks that are links only are left out.
    """
    out: list[str] = []
    own: list[str] = []
    linked = total = 0
    in_link = 0
    at, end = (root.start, root.end) if root else (0, len(events))

    def flush() -> None:
        nonlocal linked, total
        words = "".join(own).split()
        if words and (links or linked < 0.8 * total):
            out.append(" ".join(words))
        own.clear()
        linked = total = 0

    while at < end:
        x = events[at]
        at += 1
        if isinstance(x, str):
            own.append(x)
            if not links:
                n = len(x) - x.count(" ")
                total += n
                linked += n if in_link else 0
            continue
        opened = x >= 0
        e = found[x if opened else ~x]
        if opened and gone[x]:
            if e.tag in _BLOCKS:
                flush()
            at = e.end
            continue
        if e.tag in _BLOCKS:
            flush()
        elif e.tag == "a":
            in_link += 1 if opened else -1
    flush()
    return out


def main_text(found: list[Element], events: list, template: list[bool]) -> str:
    """The article of a page; ``template`` tells which elements its host repeats."""
    holds = [False] * len(found)  # an article or main element inside
    for n in range(len(found) - 1, -1, -1):
        e = found[n]
        if e.parent >= 0 and (holds[n] or (e.region and not e.junk)):
            holds[e.parent] = True
    inside = _regions(found)
    gone: list[bool] = []
    heading = [e.tag == "h1" for e in found]
    for n in range(len(found) - 1, 0, -1):
        if heading[n] and found[n].parent >= 0:
            heading[found[n].parent] = True
    for n, e in enumerate(found):
        # an article's own header may hold its title
        header = e.tag == "header" and not (inside[n] and heading[n])
        own = e.tag in _NEVER or header or ((e.junk or template[n]) and not holds[n])
        gone.append((e.parent >= 0 and gone[e.parent]) or own)
    for kind in ("article", "main"):
        roots = [e for n, e in enumerate(found) if not gone[n] and e.region and (e.tag == "article") == (kind == "article") and not (kind == "article" and _in(found, n, "article"))]
        texts = [blocks_of(found, events, gone, e) for e in roots]
        best = max(texts, key=lambda t: sum(map(len, t)), default=[])
        if best:
            return "\n\n".join(best)
    return "\n\n".join(blocks_of(found, events, gone, None, links=False))


def _in(found: list[Element], n: int, tag: str) -> bool:
    n = found[n].parent
    while n >= 0:
        if found[n].tag == tag:
            return True
        n = found[n].parent
    return False


def _keys(host: int, hashes: list[int], inside: list[bool]) -> np.ndarray:
    """One number for a subtree of a host, inside or outside its articles."""
    h = np.array(hashes, np.uint64) * np.uint64(2) + np.array(inside, np.uint64)
    return mix(mix(h) ^ mix(np.full(len(h), host, np.int64).view(np.uint64))).view(np.int64)


def _pages(batches: Iterator[pa.RecordBatch], html: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of batches with about four megabytes of pages; a larger page stands alone."""
    for batch in batches:
        column = batch.column(html)
        sizes = [0 if n is None else n for n in pc.binary_length(column).to_pylist()]
        for a, b in slices(sizes, 1 << 22):
            yield batch.slice(a, b - a), column.slice(a, b - a).to_pylist()


def site_text(
    pages: DataFrame, min_pages: int = 10, share: float = 0.01, article_share: float = 0.5, most: int = 500_000
) -> DataFrame:
    """The article of every page, without what its site repeats around it.

    Every block element's subtree (tags, classes, text) is hashed and counted per host over its different pages, where
    copies of one article count once. A subtree is template, and goes, when it stands on ``min_pages`` pages or more and on at
    least ``share`` of the host's, or inside an article or main element of pages on at least ``article_share``: a
    passage that many articles quote is theirs, a notice put into each of them is not. What marks itself as no
    part of an article goes on any page: navigation, headers, footers, asides, forms, scripts, hidden parts, and elements whose
    role, class or id names adverts, notices, menus, comments and the like. The text is the longest article element's,
    else that of main, else what is left of the page without blocks that are links only.

    The share bounds a host's templates by its average page, so they go to tasks per host: broadcast while there are at
    most ``most`` of them over all hosts, beyond that joined by host. Counts are distinct pairs added up before and
    after the shuffle; a host of a third of all pages is spread by subtree.

    Returns the columns of ``pages`` but html, and text and n_chars (code points, long); columns of these two names are
    replaced. A null or empty html has the empty text. A page without host has no template. Rows that repeat a page are each
    returned. References are decoded, white space inside a block is made single, blocks are joined by two line feeds.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    known = F.when(host != "", F.xxhash64(host)).otherwise(0)
    html = F.col("html").cast("string")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _pages(batches, "html"):
            hosts, keys, told, inner = [], [], [], []
            for at, text in zip(batch.column("host").to_pylist(), texts):
                hashes, inside, page = subtrees(*parse(text or ""))
                own = np.unique(_keys(at, hashes, inside), return_index=True)
                # the host itself stands for all its pages
                hosts += [at] * (len(own[0]) + 1)
                keys += [0, *own[0].tolist()]
                inner += [False, *(inside[i] for i in own[1].tolist())]
                told += [page] * (len(own[0]) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), pa.array(inner, pa.bool_()), pa.array(told, pa.int64())],
                names=["host", "subtree", "inside", "page"],
            )

    seen = pages.where(host != "").select(known.alias("host"), html.alias("html")).mapInArrow(count, "host long, subtree long, inside boolean, page long")
    counted = seen.distinct().groupBy("host", "subtree", "inside").agg(F.count("*").alias("n"))
    counted = cut_lineage(counted.where((F.col("n") >= min_pages) | (F.col("subtree") == 0)), "subtrees")
    all_ = counted.where("subtree = 0").select("host", F.col("n").alias("pages"))
    enough = F.col("n") >= F.col("pages") * F.when(F.col("inside"), article_share).otherwise(share)
    template = cut_lineage(counted.where("subtree <> 0").join(all_, "host").where(enough).select("host", "subtree"), "templates")

    packed = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(0).alias("none")).alias("row")
    rows = pages.select(packed, known.alias("host"), html.alias("html"))
    few = template.count() <= most
    if few:
        sent = spark.sparkContext.broadcast(np.sort(np.array([r.subtree for r in template.select("subtree").toLocalIterator()], np.int64)))
    else:
        sent = None
        own = template.groupBy("host").agg(F.array_sort(F.collect_list("subtree")).alias("known"))
        rows = rows.join(own, "host", "left").select("row", "host", "html", "known")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _pages(batches, "html"):
            out = []
            hosts = batch.column("host").to_pylist()
            for i, (at, text) in enumerate(zip(hosts, texts)):
                if not text:
                    out.append("")
                    continue
                found, events = parse(text)
                if sent is not None:
                    table = sent.value
                else:
                    own = batch.column("known")[i].values
                    table = np.zeros(0, np.int64) if own is None else own.to_numpy()
                out.append(main_text(found, events, _on_template(found, at, table)))
            size = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), size], names=["row", "text", "n_chars"])

    schema = rows.select("row", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    found = rows.mapInArrow(extract, schema)
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], "text", "n_chars")


def _on_template(found: list[Element], host: int, table: np.ndarray) -> list[bool]:
    """Which elements have a subtree of the host's template."""
    if not len(table) or not found:
        return [False] * len(found)
    keys = _keys(host, [e.hash for e in found], _regions(found))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    fits = table[at] == keys
    return [bool(f) and e.tag in _BLOCKS and e.tag not in _WHOLE and e.size > 0 for f, e in zip(fits.tolist(), found)]
