"""Design tokens mined from style sheets."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import css, rules, text
from ..session import cut_lineage
from .ranking import number_rows, top_n


def css_blocks(sheets: DataFrame, keep: tuple[str, ...] = ("file",), column: str = "css") -> DataFrame:
    """(keep, block_seq, body): the declarations between each innermost pair of braces."""
    found = F.regexp_extract_all(F.col(column), F.lit(rules.CSS_BLOCK), F.lit(1))
    return sheets.select(*keep, F.posexplode(found).alias("block_seq", "body"))


def _raw_colors(sheets: DataFrame, keep: tuple[str, ...], pattern: str) -> DataFrame:
    found = F.regexp_extract_all("body", F.lit(f"({pattern})"), F.lit(1))
    return css_blocks(sheets, keep).select(*keep, "block_seq", F.posexplode(found).alias("tok_seq", "raw"))


def color_literals(sheets: DataFrame, keep: tuple[str, ...] = ("file",), pattern: str = rules.COLOR) -> DataFrame:
    """(keep, block_seq, tok_seq, raw, canon) of every visible colour literal."""
    return _visible(_raw_colors(sheets, keep, pattern).withColumn("canon", css.canon(F.col("raw"))))


def _visible(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("canon").isNotNull() & ~F.col("canon").endswith("00"))


def font_literals(sheets: DataFrame, keep: tuple[str, ...] = ("file",)) -> DataFrame:
    found = F.regexp_extract_all("body", F.lit(rules.FONT_FAMILY), F.lit(1))
    rows = css_blocks(sheets, keep).select(*keep, "block_seq", F.posexplode(found).alias("tok_seq", "raw"))
    stack = text.clean(F.col("raw"))
    return rows.select(*keep, "block_seq", "tok_seq", stack.alias("stack")).where(
        (F.col("stack") != "") & ~F.col("stack").contains("var(")
    )


def frequencies(literals: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, uses, first): how often, and where first seen."""
    return literals.groupBy(value).agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct(*order)).alias("first"))


def color_tokens(sheets: DataFrame, order: tuple[str, ...] = ("file",), pattern: str = rules.COLOR) -> DataFrame:
    """(canon, uses, token, value): semantic names first, the rest numbered by frequency.

    First light neutral is the background, first dark neutral the text, the three most used
    saturated ones primary, secondary and accent. The distinct colours are counted map-side; the
    at most five semantic ones are picked by a top-n, the rest numbered by a range sort. Spellings
    are counted before they are interpreted.
    """
    raw = frequencies(_raw_colors(sheets, order, pattern), "raw", [*order, "block_seq", "tok_seq"])
    named = _visible(raw.withColumn("canon", css.canon(F.col("raw"))))
    counts = named.groupBy("canon").agg(F.sum("uses").alias("uses"), F.min("first").alias("first"))
    freq = cut_lineage(counts, "colors")  # one row per distinct colour, read by the steps below
    lum, sat = css.luminance(F.col("canon")), css.saturation(F.col("canon"))
    neutral = sat < rules.NEUTRAL_BELOW_SATURATION
    freq = freq.withColumn(
        "_class",
        F.when(neutral & (lum > rules.LIGHT_ABOVE), "light")
        .when(neutral & (lum < rules.DARK_BELOW), "dark")
        .when(neutral, "grey")
        .otherwise("saturated"),
    ).withColumn("_neg", -F.col("uses"))
    by_use = [F.col("_neg"), F.col("first")]
    head = top_n(freq.where("_class <> 'grey'"), ["_class"], by_use, 3)
    nth = F.row_number().over(W.partitionBy("_class").orderBy(*by_use))  # at most three rows a class
    name = (
        F.when((F.col("_class") == "light") & (nth == 1), "bg")
        .when((F.col("_class") == "dark") & (nth == 1), "text")
        .when((F.col("_class") == "saturated") & (nth == 1), "primary")
        .when((F.col("_class") == "saturated") & (nth == 2), "secondary")
        .when((F.col("_class") == "saturated") & (nth == 3), "accent")
    )
    named = head.select("canon", name.alias("_name")).where(F.col("_name").isNotNull())  # at most 5 rows
    all_named = freq.join(F.broadcast(named), "canon", "left")
    semantic = all_named.where(F.col("_name").isNotNull()).select(
        "canon", "uses", F.concat(F.lit("--color-"), F.col("_name")).alias("token")
    )
    rest = number_rows(all_named.where(F.col("_name").isNull()).drop("_name"), by_use)
    numbered = rest.select(
        "canon", "uses",
        F.concat(F.lit("--color-"), F.when(F.col("rn") < 10, F.lpad(F.col("rn").cast("string"), 2, "0")).otherwise(F.col("rn").cast("string"))).alias("token"),
    )
    return semantic.unionByName(numbered).withColumn("value", css.pretty(F.col("canon")))


def font_tokens(sheets: DataFrame, order: tuple[str, ...] = ("file",)) -> DataFrame:
    """(stack, uses, token): most used is body, next heading, the rest numbered."""
    freq = frequencies(font_literals(sheets, order), "stack", [*order, "block_seq", "tok_seq"])
    ranked = number_rows(freq.withColumn("_neg", -F.col("uses")), ["_neg", "first"])
    n = (F.col("rn") - 2).cast("string")
    token = (
        F.when(F.col("rn") == 1, "--font-body")
        .when(F.col("rn") == 2, "--font-heading")
        .otherwise(F.concat(F.lit("--font-"), F.when(F.col("rn") < 12, F.lpad(n, 2, "0")).otherwise(n)))
    )
    return ranked.select("stack", "uses", token.alias("token"))


def rewrite_tokens(
    sheets: DataFrame, colors: DataFrame, fonts: DataFrame | None = None, keep: tuple[str, ...] = ("file",),
    pattern: str = rules.COLOR,
) -> DataFrame:
    """(keep, css): every known literal inside a declaration block becomes ``var(--token)``.

    Each sheet is cut into pieces (text between literals, literal), the literals are joined to
    their tokens, and the pieces are put back in order, so the token table may be of any size and
    selectors are never touched. The cut marks are U+0001, which a style sheet cannot contain.
    Idempotent: a ``var()`` is not a literal.
    """
    block = r"(?s)(\{[^{}]*\}|[^{]+|\{)"
    parts = F.regexp_extract_all("css", F.lit(block), F.lit(1))
    blocks = sheets.select(*keep, F.posexplode(parts).alias("_b", "_part"))
    inside = F.col("_part").startswith("{") & F.col("_part").endswith("}")
    literal = rf"(?i)(font-family\s*:\s*[^;}}]+|{pattern.replace('(?i)', '')})"
    cut = F.split(F.regexp_replace("_part", literal, "\u0001$1\u0001"), "\u0001")
    pieces = blocks.select(
        *keep,
        "_b",
        F.posexplode(F.when(inside, cut).otherwise(F.array("_part"))).alias("_p", "_text"),
        inside.alias("_in"),
    )
    is_font = F.col("_in") & F.col("_text").rlike(r"(?i)^font-family\s*:")
    is_color = F.col("_in") & F.col("_text").rlike(f"^(?:{pattern})$")
    head = F.regexp_extract("_text", r"(?i)^(font-family\s*:\s*)", 1)
    stack = text.clean(F.regexp_replace("_text", r"(?i)^font-family\s*:\s*", ""))
    keyed = pieces.withColumn(
        "_key", F.when(is_font, stack).when(is_color, css.canon(F.col("_text")))
    )
    table = colors.select(F.col("canon").alias("_key"), "token")
    if fonts is not None:
        table = table.unionByName(fonts.select(F.col("stack").alias("_key"), "token"))
    from .joins import skew_join

    hit = skew_join(keyed, table, ["_key"])
    new = (
        F.when(F.col("token").isNull(), F.col("_text"))
        .when(is_font, F.concat(head, F.lit("var("), F.col("token"), F.lit(")")))
        .otherwise(F.concat(F.lit("var("), F.col("token"), F.lit(")")))
    )
    # pieces of one sheet meet again: bounded by that sheet's own text
    packed = hit.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("_b", "_p", new.alias("t")))).alias("_l"))
    return packed.select(*keep, F.array_join(F.transform("_l", lambda x: x["t"]), "").alias("css"))


def stylesheet_lines(colors: DataFrame, fonts: DataFrame) -> DataFrame:
    """(grp, ord, value): lines of the generated sheet, semantic colours first."""
    rank = F.array_position(F.array(*[F.lit(f"--color-{n}") for n in rules.SEMANTIC_COLORS]), F.col("token"))
    semantic = F.col("token").isin([f"--color-{n}" for n in rules.SEMANTIC_COLORS])
    c = colors.select(
        F.when(semantic, 0).otherwise(1).alias("grp"),
        F.when(semantic, rank).otherwise(F.regexp_extract("token", r"(\d+)$", 1).try_cast("bigint")).alias("ord"),
        F.when(semantic, F.concat(F.lit("  "), F.col("token"), F.lit(": "), F.col("value"), F.lit(";")))
        .otherwise(F.format_string("  %s: %s; /* used %dx */", "token", "value", "uses"))
        .alias("value"),
    )
    nth = F.regexp_extract("token", r"(\d+)$", 1).try_cast("bigint")
    f = fonts.select(
        F.lit(2).alias("grp"),
        F.when(F.col("token") == "--font-body", -2).when(F.col("token") == "--font-heading", -1).otherwise(nth).alias("ord"),
        F.format_string("  %s: %s;", "token", "stack").alias("value"),
    )
    return c.unionByName(f).orderBy("grp", "ord")


def stylesheet(colors: DataFrame, fonts: DataFrame) -> DataFrame:
    """(grp, ord, value): the whole generated sheet, a rule around its lines."""
    lines = stylesheet_lines(colors, fonts).select("grp", F.col("ord").cast("bigint").alias("ord"), "value")
    ends = colors.sparkSession.createDataFrame([(-1, 0, ":root {"), (3, 0, "}")], "grp int, ord bigint, value string")
    return lines.unionByName(ends).orderBy("grp", "ord")


def report_lines(colors: DataFrame) -> DataFrame:
    """(grp, ord, value): Markdown rows of the token report."""
    semantic = F.col("token").isin([f"--color-{n}" for n in rules.SEMANTIC_COLORS])
    rank = F.array_position(F.array(*[F.lit(f"--color-{n}") for n in rules.SEMANTIC_COLORS]), F.col("token"))
    last = F.when(semantic, F.substring_index("token", "-", -1)).otherwise(F.col("uses").cast("string"))
    return colors.select(
        F.when(semantic, 0).otherwise(1).alias("grp"),
        F.when(semantic, rank).otherwise(-F.col("uses")).alias("ord"),
        F.format_string("| `%s` | `%s` | %s |", F.col("token"), F.col("value"), last).alias("value"),
    ).orderBy("grp", "ord", "value")


def contrast_warnings(pairs: DataFrame, fg: str = "fg", bg: str = "bg", below: float = 2.0) -> DataFrame:
    ratio = css.contrast(F.col(fg), F.col(bg))
    return pairs.withColumn("ratio", ratio).withColumn("low", F.col("ratio") < below)
