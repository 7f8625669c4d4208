"""Registry of named queries: a Spark builder plus, where one exists, the DuckDB oracle.

Both sides round their floating-point output to the same number of digits so
the driver's value hashes can agree; ``+ 0.0`` folds a negative zero.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    build: Builder
    sql: str | None
    floats: tuple[str, ...] = ()
    digits: int = 6
    ops: tuple[str, ...] = field(default_factory=tuple)  # SURVEY ids covered

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return round_floats(df, self.digits)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.floats:
            return self.sql
        rep = ", ".join(f"round(CAST({c} AS DOUBLE), {self.digits}) + 0.0 AS {c}" for c in self.floats)
        return f"SELECT * REPLACE ({rep}) FROM (\n{self.sql}\n) AS _q"


REGISTRY: dict[str, Entry] = {}


def round_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def register(name: str, sql: str | None = None, floats: Sequence[str] = (), digits: int = 6,
             ops: Sequence[str] = ()) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, tuple(floats), digits, tuple(ops))
        return fn

    return deco
