"""Strangers' columns carried past an operator's own names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carried(docs: DataFrame, added: tuple[str, ...], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn`` over (row, doc_id, text), where ``row`` holds all other columns of ``docs`` as one struct.

    ``fn`` may use any names but ``row``, which it returns with text and the columns ``added``; then the columns of
    ``docs`` stand as before, followed by ``added``, which replace columns of these names.
    """
    names = [c for c in docs.columns if c.lower() not in added]
    others = [c for c in names if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("nothing"))
    doc_id = F.col("doc_id") if "doc_id" in names else F.lit(None).cast("long").alias("doc_id")
    out = fn(docs.select(row.alias("row"), doc_id, F.col("text").cast("string").alias("text")))
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names], *added)
