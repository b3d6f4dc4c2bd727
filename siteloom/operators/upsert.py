"""Idempotent load and publish plans as full outer joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import skew_join


def _differs(columns: list[str], a: str, b: str) -> Column:
    tests = [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    return reduce(lambda x, y: x | y, tests) if tests else F.lit(False)


def upsert_plan(desired: DataFrame, existing: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """(keys, desired values, action): create, update, unchanged or orphan.

    Both sides are unique on ``keys``; one shuffle on the keys, none if both are bucketed on them.
    """
    cols = [*keys, *compare]
    d = desired.select(*cols).withColumn("_in", F.lit(True)).alias("d")
    e = existing.select(*cols).withColumn("_in", F.lit(True)).alias("e")
    on = reduce(lambda x, y: x & y, [F.col(f"d.{k}") == F.col(f"e.{k}") for k in keys])
    action = (
        F.when(F.col("e._in").isNull(), "create")
        .when(F.col("d._in").isNull(), "orphan")
        .when(_differs(compare, "d", "e"), "update")
        .otherwise("unchanged")
    )
    return d.join(e, on, "full_outer").select(
        *[F.coalesce(F.col(f"d.{k}"), F.col(f"e.{k}")).alias(k) for k in keys],
        *[
            F.when(F.col("d._in").isNull(), F.col(f"e.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
            for c in compare
        ],
        action.alias("action"),
    )


def apply_plan(plan: DataFrame, delete_orphans: bool = False) -> DataFrame:
    """The table after the plan ran."""
    rows = plan.where(F.col("action") != "orphan") if delete_orphans else plan
    return rows.drop("action")


def area_clean_plan(existing: DataFrame, published: DataFrame, key: str = "path") -> DataFrame:
    """Unpublished children that a reload removes first; published ones are kept."""
    return existing.join(published.select(key), key, "left_anti").withColumn("action", F.lit("delete"))


def publish_plan(edit: DataFrame, live: DataFrame, keys: list[str], modified: str = "last_modified") -> DataFrame:
    """(keys, action): publish what is missing or newer than in LIVE, retract what is gone."""
    e = edit.select(*keys, F.col(modified).alias("_edit"))
    v = live.select(*keys, F.col(modified).alias("_live"))
    action = (
        F.when(F.col("_live").isNull(), "publish_new")
        .when(F.col("_edit").isNull(), "unpublish")
        .when(F.col("_edit") > F.col("_live"), "publish_changed")
        .otherwise("in_sync")
    )
    return e.join(v, keys, "full_outer").select(*keys, action.alias("action"))


def translation_gaps(edit: DataFrame, live: DataFrame, id_col: str = "uuid", lang: str = "lang", value: str = "value") -> DataFrame:
    """EDIT translations absent from LIVE: ``missing_node`` or only ``missing_translation``."""
    e = edit.where(F.coalesce(F.col(value), F.lit("")) != "").select(id_col, lang)
    nodes = live.select(id_col).distinct().withColumn("_node", F.lit(True))
    values = live.where(F.coalesce(F.col(value), F.lit("")) != "").select(id_col, lang).distinct()
    gone = e.join(values, [id_col, lang], "left_anti").join(nodes, id_col, "left")
    return gone.select(
        id_col, lang, F.when(F.col("_node").isNull(), "missing_node").otherwise("missing_translation").alias("kind")
    )


def dangling_refs(refs: DataFrame, targets: DataFrame, ref: str = "target_uuid", uuid: str = "uuid") -> DataFrame:
    """References whose target does not exist.

    Missing targets are found on the distinct references, so the busy targets shuffle as single
    rows; only references to a missing target then meet the missing set.
    """
    wanted = refs.select(F.col(ref)).distinct()
    missing = wanted.join(targets.select(F.col(uuid).alias(ref)).distinct(), ref, "left_anti")
    return skew_join(refs, missing, [ref], "inner").select(*refs.columns)


def run_tally(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
