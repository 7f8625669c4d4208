"""Helpers the operators share: the scratch folder, staged tables, let-bindings, word splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space; words are what stands between them.
SPACES = r"[\x20\x09-\x0D]+"


#: Scratch folders of sessions on one machine that name none, by application.
_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary folder, as in tests; on
    a cluster, whose machines would not see it, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="fidspark-llm-")
    return path.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/fidspark-llm/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def total(df: DataFrame, what: Column) -> int:
    """One whole number of an aggregate (0 for no rows)."""
    return int(df.agg(what.alias("n")).first()["n"] or 0)


#: A key that holds more than one in SHARES rows is hot; at any size there are fewer than SHARES such keys.
SHARES = 100


def hot_keys(counted: DataFrame, on: list[str], size: str) -> list[int]:
    """64-bit hashes of the hot keys of ``counted``, a table with one row per key and its number of rows ``size``."""
    n = total(counted, F.sum(size))
    return [r["h"] for r in counted.filter(F.col(size) * SHARES > n).select(F.xxhash64(*on).alias("h")).collect()]


def join_split(rows: DataFrame, keyed: DataFrame, on: list[str], hot: list[int], spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row per key: the rows of a hot key meet copies of it in many tasks, by the columns ``spread``.

    A key that shares its hash with a hot one is copied like it, on both sides, so the result stays that of the plain join.
    """
    if not hot:
        return rows.join(keyed, on, how)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.xxhash64(*on).isin(hot)
    left = rows.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int")).otherwise(0))
    right = keyed.withColumn("_part", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_part"], how).drop("_part")
