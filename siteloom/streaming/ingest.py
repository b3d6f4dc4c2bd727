"""Cache-first page ingest and incremental upserts over a store, and a keyed stream of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import MapType

from ..functions import urls
from ..operators.ranking import pick
from ..operators.upsert import upsert_plan
from .runs import KeyRuns


def page_stream(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def incremental_pages(
    stream: DataFrame,
    store: str,
    checkpoint: str,
    key: Column | None = None,
    order: str = "page_id",
    force: bool = False,
    trigger: dict | None = None,
    html: str = "html",
    status: str | None = None,
    capacity: int = 1 << 14,
) -> StreamingQuery:
    """Append good pages whose key is not stored yet.

    A capture that is empty, a challenge page or, where ``status`` names a column, a blocked or failed
    response is not stored, so a later good one of the same address still can be. A capture without key is
    keyed by ``slug``, if the stream has that column, else by ``order``, else by its content, so captures
    without URL are all kept. Within a batch the first page per key is stored: by ``order``, rows without it last,
    then by a hash of the row, so a repeated batch picks the same.

    Stored keys are looked up in bucketed runs with Bloom sketches (``runs.KeyRuns``, in ``store``-index): a batch reads
    what may hold its keys, neither the store nor all keys. Only the narrow keys are compared; pages are shuffled
    where a batch holds equal rows. Each batch writes its own folder and overwrites only that, and looks
    up only earlier batches. ``force`` stores one page per key of every batch, stored or not. ``store`` and
    ``checkpoint`` belong together: start both anew or neither.
    """
    key = key if key is not None else urls.cache_key(F.col("url"))

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good = (F.length(F.trim(html)) > 0) & ~urls.is_challenge(F.col(html))
        if status:
            code = F.coalesce(F.col(status), F.lit(200))
            good = good & ~urls.is_block_status(code) & (code < 400)
        slug = [F.concat(F.lit("slug:"), F.col("slug"))] if "slug" in batch.columns else []
        own = [F.concat(F.lit("row:"), F.col(order).cast("string")), F.concat(F.lit("text:"), F.sha2(html, 256))]
        hashed = [f.name for f in batch.schema.fields if not isinstance(f.dataType, MapType)]
        rows = batch.where(good).withColumn("cache_key", F.coalesce(key, *slug, *own)).withColumn("_row", F.xxhash64(*hashed))
        # the narrow keys choose, then the chosen rows are kept
        first = rows.groupBy("cache_key", order, "_row").agg(F.count("*").alias("_same"))
        first = pick(first, ["cache_key"], [F.col(order).isNull(), order, "_row"], [order, "_row", "_same"])
        runs = KeyRuns(spark, f"{store.rstrip('/')}-index", ["cache_key"], capacity=capacity)
        runs.vacuum(batch_id)
        seen = None if force else runs.lookup(first.select("cache_key"), batch_id)
        if seen is not None:
            first = first.join(seen, "cache_key", "left_anti")
        first = first.select(F.col("cache_key").alias("_key"), F.col(order).alias("_first"), F.col("_row").alias("_hash"), "_same")
        same = F.col("cache_key").eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_first")) & (F.col("_row") == F.col("_hash"))
        kept = rows.join(first, same).select(*rows.columns, "_same").drop("_row")
        single, equal = kept.where("_same = 1"), kept.where("_same > 1").dropDuplicates(["cache_key"])
        single.union(equal).drop("_same").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        stored = spark.read.schema(kept.drop("_same").schema).parquet(f"{store}/batch={batch_id}")
        runs.append(batch_id, stored.select("cache_key").distinct() if force else stored.select("cache_key"))

    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def keyed_pages(stream: DataFrame, captured: str, expiry: str, key: Column | None = None, order: str = "page_id", force: bool = False) -> DataFrame:
    """A stream of the first good capture per key, the keys held as Spark's own keyed state.

    For pipelines that go on from the stream instead of a store. A key is forgotten ``expiry`` after its
    capture time (``captured``), so state is bounded by that span and the next capture passes again; captures
    later than the watermark are dropped. Captures without key are told apart as in ``incremental_pages``; ``force`` lets
    every good capture pass. State is looked up by key in the state store, whatever has been seen before.
    """
    key = key if key is not None else urls.cache_key(F.col("url"))
    slug = [F.concat(F.lit("slug:"), F.col("slug"))] if "slug" in stream.columns else []
    own = [F.concat(F.lit("row:"), F.col(order).cast("string")), F.concat(F.lit("text:"), F.sha2("html", 256))]
    good = (F.length(F.trim("html")) > 0) & ~urls.is_challenge(F.col("html"))
    rows = stream.where(good).withColumn("cache_key", F.coalesce(key, *slug, *own)).withWatermark(captured, expiry)
    return rows if force else rows.dropDuplicatesWithinWatermark(["cache_key"])


def incremental_upserts(
    stream: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    store: str,
    checkpoint: str,
    keys: list[str],
    compare: list[str],
    trigger: dict | None = None,
    capacity: int = 1 << 14,
) -> StreamingQuery:
    """Upsert prepared rows into a change log: a batch appends only its new and changed rows.

    The batch is compared with the current rows of its own keys, which come from bucketed runs with Bloom
    sketches next to the log (``runs.KeyRuns``, in ``store``-index): runs are merged as they grow, the latest row of a
    key staying, so neither a batch nor ``read_latest`` reads the whole log. A replayed batch looks only at earlier
    batches and overwrites its own folder. ``prepare`` must leave one row per key.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        desired = prepare(batch).select(*keys, *compare)
        runs = KeyRuns(spark, f"{store.rstrip('/')}-index", keys, compare, capacity=capacity)
        runs.schema = desired.schema
        runs.vacuum(batch_id)
        known = runs.lookup(desired.select(*keys).na.drop("any"), batch_id)
        changed = desired
        if known is not None:
            plan = upsert_plan(desired, known, keys, compare)
            changed = plan.where(F.col("action").isin("create", "update")).drop("action")
        changed.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        runs.append(batch_id, spark.read.schema(desired.schema).parquet(f"{store}/batch={batch_id}"))

    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_latest(spark: SparkSession, store: str, keys: list[str], compare: list[str]) -> DataFrame:
    """Current rows of a store written by ``incremental_upserts``."""
    runs = KeyRuns(spark, f"{store.rstrip('/')}-index", keys, compare)
    return runs.latest(runs.batches())
