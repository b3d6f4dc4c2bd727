"""Session defaults and the one place that knows where intermediate tables may be written."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join stays split even when the next operator wanted its partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a derived "array is not empty" filter would evaluate every exploded expression twice
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    # bounds the HTML text held by one Python worker at a time
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


STATIC_DEFAULTS = {
    # call-site capture costs a JVM round trip per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "siteloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**STATIC_DEFAULTS, **SQL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """What the registered queries need of a session somebody else created: UTC, and no second parse."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rule, key = SQL_DEFAULTS["spark.sql.optimizer.excludedRules"], "spark.sql.optimizer.excludedRules"
    own = spark.conf.get(key, "") or ""
    if rule not in own:
        spark.conf.set(key, ",".join(filter(None, [own, rule])))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names, else below a warehouse that executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
        alone = re.match(r"local(\[|$)", spark.sparkContext.master)
        if not alone and not re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*://", root):
            # every executor would write to its own disk, and later reads would miss those files
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.applicationId not in _cleaned:
            _cleaned.add(spark.sparkContext.applicationId)
            atexit.register(_quiet_drop, spark)
    return root.rstrip("/")


_cleaned: set[str] = set()


def _quiet_drop(spark: SparkSession) -> None:
    """Stages below the warehouse go with the program; a stopped session has nothing left to ask."""
    try:
        drop_stages(spark)
    except Exception:  # noqa: BLE001  the JVM may be gone
        return


def stage_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{checkpoint_root(spark)}/siteloom/{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables; results still reading them must be done."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    One pass, readable by any executor afterwards, so a lost executor never forces a second,
    possibly different, evaluation of whatever produced it.
    """
    path = f"{stage_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
