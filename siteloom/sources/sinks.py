"""Writers. Each is one distributed write; reports that must be a single ordered file say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_media_manifest(media: DataFrame, path: str, page: str = "page") -> None:
    """One JSON line per page with its ordered media; a group is one page's references."""
    item = F.struct("seq", "src", "file", "role", "alt")
    packed = media.groupBy(page).agg(F.array_sort(F.collect_list(item)).alias("media"))
    packed.write.mode("overwrite").json(path)


def write_content(rows: DataFrame, path: str, by: str = "host", fmt: str = "parquet") -> None:
    """Content rows, one folder per site. Rows of a site are spread over tasks, not gathered."""
    rows.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def write_import_result(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_observed(rows: DataFrame, path: str, fmt: str = "parquet", **metrics: Column) -> dict[str, object]:
    """Write ``rows`` and return aggregates taken while they were written, so tallies cost no second pass."""
    watch = Observation()
    rows.observe(watch, *[m.alias(name) for name, m in metrics.items()]).write.mode("overwrite").format(fmt).save(path)
    return watch.get


def run_metrics(status: str = "status") -> dict[str, Column]:
    """Tallies of a run for ``write_observed``: all rows and those that are ok, failed and skipped."""
    return {"total": F.count(F.lit(1))} | {s: F.count_if(F.col(status) == s) for s in ("ok", "failed", "skipped")}


def write_folder_map(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str, header: list[str] | None = None, order: tuple[str, ...] = ()) -> None:
    """Ordered text report. The lines are sorted in parallel into files whose names keep the order;
    a header goes into the first line set by its own rank."""
    ordered = lines
    if header:
        spark = lines.sparkSession
        head = spark.createDataFrame([(i, h) for i, h in enumerate(header)], "_h int, value string")
        ordered = head.select(F.lit(0).alias("_part"), "_h", "value").unionByName(
            lines.withColumn("_part", F.lit(1)).withColumn("_h", F.lit(0)), allowMissingColumns=True
        )
        ordered = ordered.orderBy("_part", "_h", *order)
    elif order:
        ordered = lines.orderBy(*order)
    ordered.select("value").write.mode("overwrite").text(path)


def write_type_baseline(types: DataFrame, path: str, column: str = "type") -> None:
    types.select(F.col(column).alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def write_crawl_errors(urls: DataFrame, path: str) -> None:
    urls.select(F.col("url").alias("value")).write.mode("overwrite").text(path)
