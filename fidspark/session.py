"""Session helpers.

The library never creates a cluster session on its own; ``get_spark`` is for
tests, the bench and the smoke entry point.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: str | int = "*", app: str = "fidspark") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def one_row(df: DataFrame) -> DataFrame:
    """The result of ``df``, a one-row report, computed now, so that what it was computed from can be released."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` computed once, in files under ``spark.checkpoint.dir``, for steps that use it again; without that folder ``df`` itself."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/fidspark/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def default_buckets(spark: SparkSession) -> int:
    """Number of value buckets for prefix sums: one per shuffle partition."""
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # pragma: no cover
        return 200


def ensure_parallel(df):
    """Spread a small frame over the cores before Python-heavy or iterative work.

    A small file can scan as a single partition, which would serialise an
    Arrow kernel or every optimizer pass. The planner's size estimate decides,
    so no job runs here; results do not depend on it. Frames larger than one
    scan split per core pass through: their scans already have enough splits.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = 128 << 20  # default size of a scan split
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if estimate < cores * split else df
