"""Style-sheet queries; one sheet per part, its colours and fonts taken from the row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import css
from ..operators import tokens
from ..session import cut_lineage
from ..sources.pages import spread
from . import query
from .tables import table

# the literals a sheet holds, as SQL both engines read
_R, _G, _B = "p_size * 5 % 256", "p_size * p_size % 256", "p_size * 37 % 256"
_GREY = "p_partkey % 16"
_FONT = "CASE p_partkey % 4 WHEN 0 THEN 'Arial, sans-serif' WHEN 1 THEN 'Georgia' WHEN 2 THEN 'Arial, sans-serif' ELSE 'var(--font-x)' END"


def _sheets(spark, sf):
    part = spread(table(spark, sf, "part"), "p_partkey")
    s = lambda e: F.expr(f"CAST({e} AS STRING)")
    grey = F.lower(F.hex(F.expr(_GREY)))
    text = F.concat(
        F.lit("#f00 a { color: rgb("), s(_R), F.lit(", "), s(_G), F.lit(", "), s(_B), F.lit("); background: #"), grey, grey, grey,
        F.lit("; border: 1px solid rgba(0, 0, 0, 0) }\n.c"), s("p_partkey"), F.lit(" { font-family:  "), F.expr(_FONT),
        F.lit("; color: rgba(100%, 50%, 0, 0.5); outline-color: #FFFFFF }\n"),
    )
    return part.select(F.col("p_partkey").alias("file"), text.alias("css"))


_HEX = "'#' || lpad(lower(to_hex({r})), 2, '0') || lpad(lower(to_hex({g})), 2, '0') || lpad(lower(to_hex({b})), 2, '0') || '{a}'"
_GREY2 = "lower(to_hex(p_partkey % 16)) || lower(to_hex(p_partkey % 16))"
_LITS = f"""lits AS (
      SELECT p_partkey AS f, 0 AS b, 0 AS t, {_HEX.format(r='(' + _R + ')', g='(' + _G + ')', b='(' + _B + ')', a='ff')} AS canon FROM part
      UNION ALL SELECT p_partkey, 0, 1, '#' || {_GREY2} || {_GREY2} || {_GREY2} || 'ff' FROM part
      UNION ALL SELECT p_partkey, 1, 0, '#ff800080' FROM part UNION ALL SELECT p_partkey, 1, 1, '#ffffffff' FROM part)"""
_TOKENS = f"""{_LITS},
      freq AS (SELECT canon, count(*) AS uses, min(struct_pack(f, b, t)) AS first FROM lits GROUP BY canon),
      ch AS (SELECT *, ('0x' || canon[2:3])::INT / 255 AS r, ('0x' || canon[4:5])::INT / 255 AS g, ('0x' || canon[6:7])::INT / 255 AS bl FROM freq),
      hl AS (SELECT *, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + bl * 0.0722::DOUBLE AS lum, greatest(r, g, bl) AS hi, least(r, g, bl) AS lo FROM ch),
      sa AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 <= 0.5 THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2.0 - hi - lo) END AS sat FROM hl),
      cl AS (SELECT *, CASE WHEN sat < 0.15 AND lum > 0.8 THEN 'light' WHEN sat < 0.15 AND lum < 0.22 THEN 'dark' WHEN sat < 0.15 THEN 'grey' ELSE 'sat' END AS c FROM sa),
      rk AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY uses DESC, first) AS n FROM cl),
      nm AS (SELECT *, CASE WHEN c = 'light' AND n = 1 THEN 'bg' WHEN c = 'dark' AND n = 1 THEN 'text' WHEN c = 'sat' AND n = 1 THEN 'primary'
              WHEN c = 'sat' AND n = 2 THEN 'secondary' WHEN c = 'sat' AND n = 3 THEN 'accent' END AS name FROM rk),
      tk AS (SELECT canon, uses, first, '--color-' || name AS token FROM nm WHERE name IS NOT NULL
             UNION ALL SELECT canon, uses, first, '--color-' || lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INT, '0') FROM
               (SELECT canon, uses, first, row_number() OVER (ORDER BY uses DESC, first) AS n FROM nm WHERE name IS NULL)),
      colors AS (SELECT canon, uses, token, CASE WHEN canon[8:9] = 'ff' THEN canon[1:7] ELSE canon END AS value FROM tk)"""


@query("q40_color_tokens", f"WITH {_TOKENS} SELECT canon, uses, token, value FROM colors")
def color_tokens(spark, sf):
    return tokens.color_tokens(_sheets(spark, sf))


_FONTS = """fonts AS (SELECT stack, count(*) AS uses, row_number() OVER (ORDER BY count(*) DESC, min(f)) AS n FROM
      (SELECT p_partkey AS f, CASE WHEN p_partkey % 4 IN (0, 2) THEN 'Arial, sans-serif' ELSE 'Georgia' END AS stack FROM part WHERE p_partkey % 4 < 3) GROUP BY stack)"""


@query(
    "q40_font_tokens",
    f"WITH {_FONTS} SELECT stack, uses, CASE n WHEN 1 THEN '--font-body' ELSE '--font-heading' END AS token FROM fonts",
)
def font_tokens(spark, sf):
    return tokens.font_tokens(_sheets(spark, sf))


@query(
    "q41_contrast",
    f"""WITH c AS (SELECT p_partkey, [{_R}, {_G}, {_B}] AS a, [(p_partkey % 16) * 17, (p_partkey % 16) * 17, (p_partkey % 16) * 17] AS b FROM part),
        l AS (SELECT p_partkey, list_transform(a, lambda v: CASE WHEN v / 255 <= 0.03928 THEN v / 255 / 12.92 ELSE pow((v / 255 + 0.055) / 1.055, 2.4) END) AS x,
              list_transform(b, lambda v: CASE WHEN v / 255 <= 0.03928 THEN v / 255 / 12.92 ELSE pow((v / 255 + 0.055) / 1.055, 2.4) END) AS y FROM c),
        m AS (SELECT p_partkey, 0.2126 * x[1] + 0.7152 * x[2] + 0.0722 * x[3] AS p, 0.2126 * y[1] + 0.7152 * y[2] + 0.0722 * y[3] AS q FROM l)
        SELECT p_partkey, round((greatest(p, q) + 0.05) / (least(p, q) + 0.05), 4) AS ratio, (greatest(p, q) + 0.05) / (least(p, q) + 0.05) < 2.0 AS low FROM m""",
)
def contrast(spark, sf):
    s = lambda e: F.expr(f"CAST({e} AS STRING)")
    grey = F.lower(F.hex(F.expr(_GREY)))
    fg = css.canon(F.concat(F.lit("rgb("), s(_R), F.lit(","), s(_G), F.lit(","), s(_B), F.lit(")")))
    pairs = table(spark, sf, "part").select("p_partkey", fg.alias("fg"), css.canon(F.concat(F.lit("#"), grey, grey, grey)).alias("bg"))
    return tokens.contrast_warnings(pairs).select("p_partkey", F.round("ratio", 4).alias("ratio"), "low")


@query(
    "q42_token_rewrite",
    f"""WITH {_TOKENS}
        SELECT p_partkey AS file, '#f00 a {{ color: var(' || x.token || '); background: var(' || g.token || '); border: 1px solid rgba(0, 0, 0, 0) }}' || chr(10)
          || '.c' || p_partkey || ' {{ font-family:  ' || CASE p_partkey % 4 WHEN 1 THEN 'var(--font-heading)' WHEN 3 THEN 'var(--font-x)' ELSE 'var(--font-body)' END
          || '; color: var(' || o.token || '); outline-color: var(' || w.token || ') }}' || chr(10) AS css
        FROM part JOIN lits lx ON lx.f = p_partkey AND lx.b = 0 AND lx.t = 0 JOIN colors x ON x.canon = lx.canon
          JOIN lits lg ON lg.f = p_partkey AND lg.b = 0 AND lg.t = 1 JOIN colors g ON g.canon = lg.canon
          JOIN colors o ON o.canon = '#ff800080' JOIN colors w ON w.canon = '#ffffffff'""",
)
def token_rewrite(spark, sf):
    sheets = _sheets(spark, sf)
    colors = cut_lineage(tokens.color_tokens(sheets), "colors")
    fonts = cut_lineage(tokens.font_tokens(sheets), "fonts")
    return tokens.rewrite_tokens(sheets, colors, fonts)


@query(
    "q42_token_report",
    f"""WITH {_TOKENS}, {_FONTS}
        SELECT CASE WHEN canon = canon AND token SIMILAR TO '--color-[a-z]+' THEN '  ' || token || ': ' || value || ';' ELSE '  ' || token || ': ' || value || '; /* used ' || uses || 'x */' END AS value FROM colors
        UNION ALL SELECT '  ' || CASE n WHEN 1 THEN '--font-body' ELSE '--font-heading' END || ': ' || stack || ';' FROM fonts""",
)
def token_report(spark, sf):
    sheets = _sheets(spark, sf)
    return tokens.stylesheet_lines(tokens.color_tokens(sheets), tokens.font_tokens(sheets)).select("value")
