"""Positions and firsts that survive a group, or a whole table, too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOCAL_BITS = 33


def _cols(names) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def pick(df: DataFrame, keys: list[str], rank: list, keep: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the smallest ``rank``. Combines map-side, never sorts a group."""
    keep = keep or [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*keep), F.struct(*_cols(rank))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key. The filter on the rank lets Spark cut groups to n rows per input
    task before the shuffle, so a hot key sends at most tasks*n rows."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def bottom_k(df: DataFrame, keys: list[str], of: str, k: int) -> DataFrame:
    """A sample of ``k`` rows per key (none: of the table): those with the least hash of ``of``.

    Mergeable: the k least of two parts are the k least of both, so every task sends at most k rows per key and
    the sample depends on the rows alone, not on their order or partitioning.
    """
    return top_n(df, keys, [F.md5(F.col(of).cast("string")), of], k)


def number_rows(
    df: DataFrame, order: list, by: list[str] | None = None, name: str = "rn", parts: int | None = None
) -> DataFrame:
    """Exact 1-based row numbers, overall or within ``by``, without a single-task window.

    Rows are range-partitioned on (by, order), so a hot group is spread over many partitions, and
    written once; each row's position follows from its partition-local position plus the counts of
    the partitions before it. ``order`` must identify a row within its group.
    """
    by = by or []
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [*_cols(by), *_cols(order)]
    ranged = (
        df.repartitionByRange(parts, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = cut_lineage(ranged, "numbered").withColumn("_part", F.shiftright("_pos", _LOCAL_BITS))
    # one row per (group, partition): at most `parts` rows for any one group
    runs = placed.groupBy("_part", *by).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    runs = runs.select(F.col("_part").alias("_rpart"), *[F.col(c).alias(f"_r_{c}") for c in by], "_first", "_before")
    on = F.col("_part") == F.col("_rpart")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    if not by:
        runs = F.broadcast(runs)  # one row per partition
    return (
        placed.join(runs, on)
        .withColumn(name, (F.col("_pos") - F.col("_first") + F.col("_before") + 1).cast("bigint"))
        .select(*[F.col(c) for c in df.columns], name)
    )
