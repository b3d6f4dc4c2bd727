"""Colours: canonical '#rrggbbaa', perception measures, contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex_byte(x: Column) -> Column:
    """Two hex digits after half-even rounding and clamping to one byte."""
    byte = F.greatest(F.lit(0), F.least(F.lit(255), F.bround(x).cast("int")))
    return F.lower(F.lpad(F.hex(byte), 2, "0"))


def _hex_canon(tok: Column) -> Column:
    digits = F.lower(F.substr(tok, F.lit(2)))
    wide = F.when(F.length(digits) <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return F.concat(F.lit("#"), F.rpad(wide, 8, "f"))


def _rgb_canon(tok: Column) -> Column:
    """Channels count to 255, opacity to 1; either may be a percentage. Missing opacity is opaque."""
    nums = F.regexp_extract_all(tok, F.lit(r"(-?[\d.]+%?)"), F.lit(1))

    def digits(part: Column, at: Column) -> Column:
        value = F.regexp_replace(part, "%$", "").try_cast("double")
        is_pct = part.endswith("%")
        as_opacity = F.when(is_pct, value / 100).otherwise(value) * 255
        return _hex_byte(F.when(at == 3, as_opacity).when(is_pct, value * 255 / 100).otherwise(value))

    shown = F.array_join(F.transform(F.slice(nums, 1, 4), digits), "")
    return F.when(F.length(shown) >= 6, F.rpad(F.concat(F.lit("#"), shown), 9, "f"))


def canon(tok: Column) -> Column:
    """Null for an rgb() form with fewer than three numbers."""
    return F.when(tok.startswith("#"), _hex_canon(tok)).otherwise(_rgb_canon(tok))


def _channel(c: Column, at: int) -> Column:
    return F.conv(F.substring(c, at, 2), 16, 10).cast("double") / 255


def luminance(c: Column) -> Column:
    """Weighted sum of the raw channels."""
    return _channel(c, 2) * 0.2126 + _channel(c, 4) * 0.7152 + _channel(c, 6) * 0.0722


def saturation(c: Column) -> Column:
    """Saturation of the hue/lightness/saturation model."""
    r, g, b = (_channel(c, i) for i in (2, 4, 6))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    return (
        F.when(hi == lo, 0.0)
        .when((hi + lo) / 2 <= 0.5, (hi - lo) / (hi + lo))
        .otherwise((hi - lo) / (2.0 - hi - lo))
    )


def alpha(c: Column) -> Column:
    return _channel(c, 8)


def pretty(c: Column) -> Column:
    return F.when(F.substring(c, 8, 2) == "ff", F.substring(c, 1, 7)).otherwise(c)


def relative_luminance(c: Column) -> Column:
    """WCAG relative luminance (gamma-expanded channels)."""

    def lin(at: int) -> Column:
        v = _channel(c, at)
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return lin(2) * 0.2126 + lin(4) * 0.7152 + lin(6) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    la, lb = relative_luminance(a), relative_luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)
