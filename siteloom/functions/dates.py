"""Dates found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import MONTHS

_DMY = r"(\d{1,2})/(\d{1,2})/(\d{4})"


def dmy_to_iso(c: Column) -> Column:
    """First dd/mm/yyyy in the text as an instant string. Not validated: 31/02 passes."""
    part = [F.regexp_extract(c, _DMY, i) for i in (1, 2, 3)]
    return F.when(
        part[2] != "",
        F.concat(
            part[2], F.lit("-"), F.lpad(part[1], 2, "0"), F.lit("-"), F.lpad(part[0], 2, "0"),
            F.lit("T00:00:00.000"),
        ),
    )


def dmy_to_timestamp(c: Column) -> Column:
    """Typed variant: an impossible date is null."""
    return F.try_to_timestamp(F.regexp_extract(c, _DMY, 0), F.lit("d/M/yyyy")).cast("timestamp_ntz")


def day_to_instant(c: Column) -> Column:
    return F.concat(c, F.lit("T00:00:00.000"))


def localized(c: Column, lang: str = "fr", style: str = "long") -> Column:
    """'dd MMMM yyyy' or 'dd/MM/yyyy' in a fixed language; unparseable text passes through."""
    ts = F.try_to_timestamp(F.left(c, F.lit(10)), F.lit("yyyy-MM-dd"))
    if style == "short":
        return F.coalesce(F.date_format(ts, "dd/MM/yyyy"), c)
    names = F.array(*[F.lit(m) for m in MONTHS[lang]])
    text = F.concat_ws(
        " ", F.date_format(ts, "dd"), F.element_at(names, F.month(ts)), F.date_format(ts, "yyyy")
    )
    return F.when(ts.isNull(), c).otherwise(text)
