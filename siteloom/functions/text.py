"""Text normalisation."""

from __future__ import annotations

import html
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Python workers receive the code itself, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# what Python's \s matches, written for the JVM
_SPACE = r"(?U)[\s\x1c-\x1f]+"

_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&rsquo;", "’"), ("&lsquo;", "‘"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&eacute;", "é"), ("&egrave;", "è"),
    ("&agrave;", "à"), ("&ccedil;", "ç"), ("&amp;", "&"),
]


def _accent_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility decompositions of the Latin blocks, derived rather than listed."""
    singles, expansions = [], []
    for code in [*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        char = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if base == char:
            continue
        if len(base) == 1:
            singles.append((char, base))
        else:
            expansions.append((char, base))
    return "".join(a for a, _ in singles), "".join(b for _, b in singles), expansions


_FROM, _TO, _EXPAND = _accent_tables()
# letters only: fractions and spacing marks end up as blanks either way
_EXPAND = [(a, b) for a, b in _EXPAND if b.isalpha() and b.isascii()]
# the ranges that hold them; few ranges keep the test cheap
_HAS_DIGRAPH = "[\u0132-\u0149\u01c4-\u01f3\ufb00-\ufb06]"


def clean(c) -> Column:
    """Collapse every run of whitespace to one blank and trim; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), _SPACE, " "))


def norm(c) -> Column:
    return F.lower(clean(c))


def strip_tags(c: Column, sep: str = " ") -> Column:
    return F.regexp_replace(c, r"<[^>]+>", sep)


def unescape(c: Column) -> Column:
    """Common named entities, '&amp;' last so that escaped entities are decoded only once."""
    for name, char in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def unescape_all(c: Column) -> Column:
    """Every entity, numeric ones included; only texts with an ampersand go to Python."""
    return F.when(F.contains(c, F.lit("&")), unescape_exact(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


@F.pandas_udf(StringType())
def unescape_exact(s: pd.Series) -> pd.Series:
    """Every HTML5 entity; Arrow batches, for corpora where the common list is not enough."""
    return s.map(html.unescape, na_action="ignore")


def visible_text(c: Column, exact: bool = True) -> Column:
    """Text between the tags; without ``exact`` only the common named entities are decoded."""
    stripped = strip_tags(c)
    return clean(unescape_all(stripped) if exact else unescape(stripped))


def _fold(c: Column, keep: str) -> Column:
    """Lower-case letters and digits without accents (Latin blocks); the rest becomes single blanks."""
    plain = F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{M}+", "")
    expanded = plain
    for char, base in _EXPAND:
        expanded = F.replace(expanded, F.lit(char), F.lit(base))
    c = F.when(c.rlike(_HAS_DIGRAPH), expanded).otherwise(plain)
    c = F.replace(F.replace(F.lower(c), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.regexp_replace(c, f"[^a-z0-9{keep}]+", " ")


def heading_norm(c: Column) -> Column:
    """Accent-free, lower-case letters and digits separated by single blanks (Latin blocks)."""
    return F.trim(_fold(c, ""))


def heading_lines(c: Column) -> Column:
    """``heading_norm`` of every line of a text, folded in one pass over the whole text."""
    return F.transform(F.split(_fold(c, r"\n"), "\n"), lambda line: F.trim(line))


def first_filled(*cols) -> Column:
    """First value that is neither null nor empty: title, description and image fallbacks."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


@F.pandas_udf(StringType())
def heading_norm_exact(s: pd.Series) -> pd.Series:
    """As ``heading_norm`` for every script, not only the Latin blocks; Arrow batches."""
    flat = s.str.normalize("NFKD").str.replace(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]", "", regex=True)
    flat = flat.str.lower().str.replace("œ", "oe").str.replace("æ", "ae")
    return flat.str.replace("[^a-z0-9]+", " ", regex=True).str.strip()


def region(c: Column, tag: str = "main", fallback: str | None = None) -> Column:
    """Inner HTML of the first ``tag``; '' when absent unless a fallback tag is given."""

    def inner(name: str) -> Column:
        return F.regexp_extract(c, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)

    if fallback is None:
        return inner(tag)
    return F.when(c.rlike(rf"(?i)<{tag}\b"), inner(tag)).when(
        c.rlike(rf"(?is)<{fallback}\b[^>]*>.*</{fallback}>"), inner(fallback)
    ).otherwise(c)


def truncate(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def title_clean(c: Column, fallback: Column, limit: int | None = None) -> Column:
    joined = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\|\s*", " "))
    return F.coalesce(F.nullif(truncate(joined, limit) if limit else joined, F.lit("")), fallback)


def join_fragments(c: Column) -> Column:
    return F.array_join(c, "")


def label_or_self(c: Column, labels: dict[str, str]) -> Column:
    """Map known values to labels, pass the rest through."""
    if not labels:
        return c
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)
