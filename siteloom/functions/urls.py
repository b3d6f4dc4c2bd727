"""URLs, paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def is_image(c: Column) -> Column:
    return c.rlike(rules.IMAGE_EXT) & ~c.startswith("data:")


def is_external(c: Column) -> Column:
    return c.startswith("http")


def url_path(c: Column) -> Column:
    """Path component, also for relative references and URLs a strict parser would refuse."""
    bare = F.regexp_replace(c, r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    bare = F.regexp_replace(bare, r"^//[^/]*", "")
    return F.regexp_replace(bare, r";[^/]*$", "")


def origin(c: Column) -> Column:
    """scheme://host[:port]"""
    return F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def referer(c: Column) -> Column:
    """Origin with a closing slash; null when there is none."""
    return F.concat(F.nullif(origin(c), F.lit("")), F.lit("/"))


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def parent_path(c: Column) -> Column:
    return F.regexp_replace(c, r"/[^/]*$", "")


def strip_locale(c: Column) -> Column:
    """'/fr-FR/a/b' -> 'a/b'"""
    return F.regexp_replace(F.regexp_replace(c, r"^/?[a-z]{2}(-[A-Z]{2})?(?=/|$)", ""), r"^/+", "")


def page_path(url: Column) -> Column:
    """Path without leading/trailing slashes and without the page suffix."""
    return F.regexp_replace(F.regexp_replace(url_path(url), r"^/+|/+$", ""), r"\.html$", "")


def page_slug(url: Column) -> Column:
    """'home' for a locale root (or an empty path), else the last path segment."""
    path = page_path(url)
    return F.when((path == "") | path.rlike(rules.LOCALE_ROOT), F.lit("home")).otherwise(basename(path))


def page_key_of_node(path: Column, home: str, tail: int = 2) -> Column:
    """Page key of a content node below ``home``: drop the last ``tail`` segments, 'home' if none left."""
    rest = F.regexp_replace(F.replace(path, F.lit(home), F.lit("")), r"^/+|/+$", "")
    parts = F.split(rest, "/")
    key = F.when(
        F.size(parts) > tail, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - tail, F.lit(0))), "/")
    ).otherwise("")
    return F.when(key == "", "home").otherwise(key)


def percent_decode(c: Column) -> Column:
    """Decode %XX but leave '+' alone; malformed input passes through."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(c.contains("%"), F.coalesce(decoded, c)).otherwise(c)


def sanitize(c: Column, keep: str = "A-Za-z0-9._-") -> Column:
    return F.regexp_replace(c, f"[^{keep}]", "-")


_BASENAME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?(?:[^?#]*/)?([^/?#;]*)"
_NO_IMAGE_EXT = r"(?is)^(?!.*\.(?:png|jpe?g|webp|gif|svg|avif)(?:\?|$)).*$"


def filename_for(url: Column) -> Column:
    """Stable file name of an image reference. One linear chain: no step reads its input twice."""
    base = F.regexp_replace(F.regexp_extract(url, _BASENAME, 1), "^$", "image")
    return sanitize(F.regexp_replace(percent_decode(base), _NO_IMAGE_EXT, "$0.img"))


def upload_name(url: Column) -> Column:
    """Lower-case name for a re-imported file, always with an extension."""
    name = F.regexp_replace(sanitize(F.lower(basename(url)), "a-z0-9_.-"), r"^-+|-+$", "")
    name = F.when(name == "", "image.jpg").otherwise(name)
    return F.when(name.contains("."), name).otherwise(F.concat(name, F.lit(".jpg")))


def node_name(c: Column, limit: int | None = None) -> Column:
    """Name of a node; ``limit`` cuts it, at the price that long names may fall together."""
    name = F.regexp_replace(F.lower(c), "[^a-z0-9-]", "-")
    return F.left(name, F.lit(limit)) if limit else name


def _squash_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    segs = F.split(path, "/")
    last = F.element_at(segs, -1)
    kept = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    joined = F.array_join(kept, "/")
    needs_slash = last.isin(".", "..") & ~joined.endswith("/")
    joined = F.when(needs_slash, F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` as seen from the page ``base`` (RFC 3986 reference resolution)."""
    folder = F.regexp_replace(F.coalesce(F.nullif(url_path(base), F.lit("")), F.lit("/")), r"[^/]*$", "")
    path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    full = F.when(path.rlike(r"(^|/)\.\.?(/|$)"), _squash_dots(full)).otherwise(full)
    return (
        F.when(ref == "", base)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/]+:)", 1), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref))
        .when(ref.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), ref))
        .otherwise(F.concat(origin(base), full, F.regexp_extract(ref, r"([?#].*)$", 1)))
    )


def complete(base: Column, src: Column) -> Column:
    """Manifest sources are absolute or relative to the manifest base."""
    return F.when(src.startswith("http"), src).otherwise(F.concat(base, src))


def largest_srcset(c: Column) -> Column:
    """Candidate with the highest w/x descriptor; the later one wins a tie."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")

    def scored(part: Column, i: Column) -> Column:
        bits = F.split(part, r"\s+")
        n = F.regexp_extract(F.coalesce(F.try_element_at(bits, F.lit(2)), F.lit("")), r"^(\d+)[wx]", 1)
        return F.struct(
            F.coalesce(n.try_cast("bigint"), F.lit(0)).alias("n"), i.alias("i"), bits[0].alias("url")
        )

    return F.array_max(F.transform(parts, scored))["url"]


def width_param(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"[?&]w=(\d+)", 1).try_cast("int"), F.lit(0))


def css_urls(c: Column) -> Column:
    """All url(...) arguments in a style text, unquoted."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(r"url\(([^)]+)\)"), F.lit(1)), lambda u: F.btrim(u, F.lit("'\" "))
    )


def role_for(url: Column, alt: Column, cls: Column, hints=None) -> Column:
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (url, alt, cls)]))
    ladder = None
    for needle, role in hints or rules.ROLE_HINTS:
        hit = hay.contains(needle)
        ladder = F.when(hit, role) if ladder is None else ladder.when(hit, role)
    return ladder.otherwise(rules.DEFAULT_ROLE)


def image_source_kind(src: Column) -> Column:
    """empty / repository / fallback, by where an image is served from."""
    src = F.coalesce(src, F.lit(""))
    return (
        F.when(src == "", "empty")
        .when(src.contains("/files/"), "repository")
        .when(src.contains("static/"), "fallback")
        .otherwise("repository")
    )


def mime_for(name: Column) -> Column:
    ext = F.lower(F.substring_index(name, ".", -1))
    ladder = None
    for suffix, mime in rules.MIME_BY_EXT:
        ladder = F.when(ext == suffix, mime) if ladder is None else ladder.when(ext == suffix, mime)
    return ladder.otherwise(rules.DEFAULT_MIME)


def cache_key(url: Column, legacy: bool = False) -> Column:
    """Canonical storage key of a URL.

    ``legacy`` drops the query string, so differing queries collide; the default appends a digest
    of the query. In both, any dot anywhere (the host's included) counts as a suffix.
    """
    key = F.regexp_replace(url, r"^https?://", "")
    key = F.regexp_replace(key, r"\?.*$", "")
    key = F.regexp_replace(key, r"[^A-Za-z0-9._/-]", "_")
    key = F.regexp_replace(key, r"/+$", "/index.html")
    key = F.when(key == "", "index.html").otherwise(key)
    key = F.when(key.contains("."), key).otherwise(F.concat(key, F.lit(".html")))
    if legacy:
        return key
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.when(query == "", key).otherwise(F.concat(key, F.lit("@"), F.left(F.md5(query), F.lit(12))))


def is_challenge(body: Column) -> Column:
    return body.rlike(rules.CHALLENGE)


def is_block_status(status: Column) -> Column:
    return status.isin(rules.BLOCK_CODES)


def path_prefixes(c: Column) -> Column:
    """'/a/b/c' -> ['/a', '/a/b', '/a/b/c']"""
    parts = F.filter(F.split(c, "/"), lambda p: p != "")
    return F.when(
        F.size(parts) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))


def is_debris(name: Column) -> Column:
    return F.lower(name).rlike(rules.DEBRIS_NAME)


def looks_like_uuid(c: Column) -> Column:
    return (F.length(c) >= 32) & c.contains("-")


def partner_category(path: Column, categories: list[tuple[str, str]] | None = None) -> Column:
    """Category of a logo by its folder: the first of ``categories`` (part of the path, category) that fits."""
    ladder = None
    for needle, cat in categories or rules.PARTNER_CATEGORIES:
        hit = path.contains(needle)
        ladder = F.when(hit, cat) if ladder is None else ladder.when(hit, cat)
    return ladder.otherwise(rules.DEFAULT_PARTNER_CATEGORY)


def partner_name(path: Column, noise: list[str] | None = None) -> Column:
    """Display name from a logo path: prefix, campaign noise and version digits removed.

    ``noise`` holds extra patterns (campaign or venue wording) that differ per corpus.
    """
    stem = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    name = F.regexp_replace(stem, r"(?i)^logo[-_ ]*", "")
    for pattern in noise or []:
        name = F.regexp_replace(name, pattern, "")
    name = F.trim(F.regexp_replace(name, r"[-_]+", " "))
    name = F.regexp_replace(name, r"\s+\d+$", "")
    has_case = F.lower(name) != F.upper(name)
    one_case = has_case & ((name == F.lower(name)) | (name == F.upper(name)))
    name = F.when(one_case, F.initcap(name)).otherwise(name)
    return F.when(name == "", stem).otherwise(name)
