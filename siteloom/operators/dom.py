"""HTML text -> element rows. The only operator that needs Python per page (Arrow batches)."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

# Python workers receive the code itself, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELEMENT = (
    "struct<seq:int,end_seq:int,depth:int,parent:int,owner:int,component:int,chrome:boolean,"
    "tag:string,classes:array<string>,attrs:map<string,string>,text:string,spaced:string,main:boolean>"
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
_HEADINGS = set(rules.HEADING_TAGS)
_CHROME = set(rules.CHROME_TAGS)
_FIELD = rules.FIELD_PREFIX
_P_SCOPE = {"div", "li", "td", "section", "article", "blockquote"}
_HEADING_SCOPE = {"div", "section", "article"}
_LINK_SCOPE = {"div", "li", "td", "section", "article"}
_BEFORE_SLASH = ("", " ", "\n", "\t", '"', "'")
_TEXT = {*rules.HEADING_TAGS, *rules.TEXT_TAGS, "a", "title", "option", "style"}


# a tag (quotes count only after '='), a comment, or a declaration
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style")}

# positions inside a row while a page is being read
_SEQ, _END, _DEPTH, _PARENT, _OWNER, _COMPONENT, _IN_CHROME, _TAG, _CLASSES, _ATTRS, _OWN_TEXT = range(11)
_SPACED, _MAIN, _MARK, _FROM, _UPTO, _FROM_CHUNK, _UPTO_CHUNK = range(11, 18)

_AT_ONCE = 1 << 18  # bytes of HTML whose elements are Python rows at a time; a longer page is alone


def outline(doc: str, primary: str, veto: str, items: frozenset) -> list[list]:
    """Elements of one page with their nesting interval; text is a slice of one page-wide buffer."""
    rows: list[list] = []
    stack: list[list] = []
    chunks: list[str] = []
    size = seen = 0

    def close(depth):
        for row in stack[depth:]:
            row[_END] = len(rows) - 1
            row[_UPTO], row[_UPTO_CHUNK] = size, len(chunks)
        del stack[depth:]

    def close_nearest(tags, stop):
        for k in range(len(stack) - 1, -1, -1):
            tag = stack[k][_TAG]
            if tag in tags:
                close(k)
                return
            if tag in stop:
                return

    at = 0
    while True:
        token = _TOKEN.search(doc, at)
        data = doc[at : token.start()] if token else doc[at:]
        if data:
            data = unescape(data) if "&" in data else data
            chunks.append(data)
            size += len(data)
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            close_nearest((tag,), ())
            continue
        if tag in _CLOSES_P:
            close_nearest(("p",), _P_SCOPE)
        if tag in _HEADINGS:
            close_nearest(_HEADINGS, _HEADING_SCOPE)
        elif tag == "li":
            close_nearest(("li",), ("ul", "ol"))
        elif tag == "a":
            close_nearest(("a",), _LINK_SCOPE)
        body = token[3]
        attrs = {}
        for name, double, single, plain in _ATTR.findall(body):
            value = double or single or plain
            attrs[name.lower()] = unescape(value) if "&" in value else value
        classes = attrs["class"].split() if "class" in attrs else []
        parent = owner = component = None
        chrome = tag in _CHROME
        regions = 1 if tag == "main" else 2 if tag == "body" else 0
        seen |= regions
        if stack:
            top = stack[-1]
            parent, owner, component = top[_SEQ], top[_OWNER], top[_COMPONENT]
            chrome = chrome or top[_IN_CHROME]
            regions |= top[_MAIN]
            if top[_MARK]:
                owner = parent
                if top[_MARK] == 1:
                    component = parent
        mark = 0
        if classes and tag == "div":
            if primary in classes and veto not in classes:
                mark = 1
            elif component is not None and not items.isdisjoint(classes):
                mark = 2
        seq = len(rows)
        row = [seq, seq, len(stack), parent, owner, component, chrome, tag, classes, attrs, None, None, regions, mark, size, size, len(chunks), len(chunks)]
        rows.append(row)
        if tag in _VOID or (body.endswith("/") and body[-2:-1] in _BEFORE_SLASH):
            continue
        stack.append(row)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(doc, at)
            raw = doc[at : end.start()] if end else doc[at:]
            if tag == "style":
                row[_OWN_TEXT] = raw
            at = end.end() if end else len(doc)
            close(len(stack) - 1)
    close(0)
    page, apart = "".join(chunks), " ".join(chunks)
    wanted = seen & 1 or seen & 2
    for row in rows:
        row[_MAIN] = bool(row[_MAIN] & wanted) if wanted else True
        if row[_OWN_TEXT] is None and (
            row[_TAG] in _TEXT or any(c.startswith(_FIELD) for c in row[_CLASSES])
        ):
            row[_OWN_TEXT] = page[row[_FROM] : row[_UPTO]]
            # each chunk before is followed by one blank there
            row[_SPACED] = apart[row[_FROM] + row[_FROM_CHUNK] : row[_UPTO] + row[_UPTO_CHUNK]]
    return rows


def _to_arrow(pages: list[list[list]]) -> pa.Array:
    rows = [r for page in pages for r in page]
    starts, at = [0], 0
    for page in pages:
        at += len(page)
        starts.append(at)
    keys, vals, offs = [], [], [0]
    for r in rows:
        keys.extend(r[9].keys())
        vals.extend(r[9].values())
        offs.append(len(keys))
    ints = [pa.array([r[i] for r in rows], pa.int32()) for i in range(6)]
    element = pa.StructArray.from_arrays(
        [
            *ints,
            pa.array([r[6] for r in rows], pa.bool_()),
            pa.array([r[7] for r in rows], pa.string()),
            pa.array([r[8] for r in rows], pa.list_(pa.string())),
            pa.MapArray.from_arrays(
                pa.array(offs, pa.int32()), pa.array(keys, pa.string()), pa.array(vals, pa.string())
            ),
            pa.array([r[10] for r in rows], pa.string()),
            pa.array([r[11] for r in rows], pa.string()),
            pa.array([r[12] for r in rows], pa.bool_()),
        ],
        names=[
            "seq", "end_seq", "depth", "parent", "owner", "component", "chrome", "tag", "classes",
            "attrs", "text", "spaced", "main",
        ],
    )
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), element)


def _portions(docs: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of about ``_AT_ONCE`` bytes; an element takes far more room as a Python row than in Arrow."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(docs).fill_null(0).to_pylist()):
        if i > start and size + n > _AT_ONCE:
            yield docs.slice(start, i - start)
            start, size = i, 0
        size += n
    yield docs.slice(start)


def _elements(batches: Iterator[pa.Array], primary: str, veto: str, markers: frozenset) -> Iterator[pa.Array]:
    for batch in batches:
        for docs in _portions(batch):
            yield _to_arrow([outline(doc.as_py() or "", primary, veto, markers) for doc in docs])


def parse(
    html: Column,
    primary: str = "component",
    veto: str = "component-content",
    items: tuple[str, ...] = tuple(rules.ITEM_MARKERS),
) -> Column:
    """array<element> of one page, in document order.

    ``owner`` is the nearest enclosing component or item, ``component`` the nearest enclosing
    component, both found on the way so that no containment join is needed later. ``text`` is the
    element's own subtree text, kept for headings, text blocks, links, titles, options and fields;
    ``spaced`` is the same with a blank between the pieces of adjacent elements. ``main``: the element
    lies in a main element; on a page without one in the body; without either anywhere. A task holds the
    elements of a portion of its pages, whatever the size of Arrow batches.
    """
    markers = frozenset(items)

    @F.arrow_udf(f"array<{ELEMENT}>")
    def elements(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _elements(batches, primary, veto, markers)

    return elements(html)


def dom_nodes(
    pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",), **markers
) -> DataFrame:
    """One row per element: the ``keep`` columns plus the element fields."""
    parsed = pages.select(*keep, parse(F.col(html), **markers).alias("_dom"))
    # the outer form keeps Spark from deriving a "has elements" filter that would parse twice
    return parsed.select(*keep, F.inline_outer("_dom")).where(F.col("seq").isNotNull())


def field_names(classes: Column, prefix: str = rules.FIELD_PREFIX) -> Column:
    hits = F.filter(classes, lambda c: c.startswith(prefix))
    return F.transform(hits, lambda c: F.substr(c, F.lit(len(prefix) + 1)))


def semantic_class(classes: Column, layout: str = rules.LAYOUT_CLASS) -> Column:
    """First class that is not a layout helper."""
    return F.coalesce(
        F.try_element_at(F.filter(classes, lambda c: ~c.rlike(layout)), F.lit(1)), F.lit("unknown")
    )


def uses_components(html: Column) -> Column:
    """Structured extraction applies to a page that shows both component and field markup."""
    return html.contains('class="component') & html.contains(rules.FIELD_PREFIX)


def adapter_majority(pages: DataFrame, html: str = "html") -> DataFrame:
    share = F.avg(uses_components(F.col(html)).cast("double"))
    return pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.when(share > 0.5, "component").otherwise("generic").alias("adapter"),
    )
