"""Scans and sinks.

Delimited files are read by Spark's CSV source (parallel, splittable); the
only driver-side work is sniffing the delimiter and header from the *first
line*.  Whitespace-separated files go through ``spark.read.text`` and a split
expression.  Sinks write one directory per table.
"""

from __future__ import annotations

import csv
import io
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidspark.spec import TableSpec

NULL_TOKEN = "?"
FIRST_ROWS = 1000  # rows that settle for most columns whether they hold a value


def _first_line(spark: SparkSession, path: str, skip: int = 0) -> str | None:
    """Line ``skip`` (from 0, blank ones not counted) of the first file that has any; None if that file is shorter."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    file = lines.select("file").first()
    if file is None:
        return None
    rows = lines.where(F.col("file") == file[0]).limit(skip + 1).collect()
    return rows[skip][0] if len(rows) > skip else None


def _without_leading(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The lines of all files of ``path`` that are not blank, without the first ``n`` of each file.

    A file's first lines stand in its block that starts at 0, which one task
    reads from the top, so each task counts them as they pass; no line is
    compared, sorted or shuffled. The ``n`` lines must lie within that block.
    """
    text = spark.read.text(path).where(F.trim("value") != "")
    if not n:
        return text
    first = F.when(F.col("_metadata.file_block_start") == 0, F.xxhash64("_metadata.file_path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            files = batch.column("file")
            for file in files.unique().drop_null().to_pylist():
                if (left := n - seen.get(file, 0)) > 0:
                    at = np.flatnonzero(np.asarray(files.is_valid()) & (files.fill_null(0).to_numpy() == file))[:left]
                    keep[at] = False
                    seen[file] = seen.get(file, 0) + len(at)
            yield batch.select(["value"]).filter(pa.array(keep))

    return text.select("value", first.alias("file")).mapInArrow(run, "value string")


def sniff_delimiter(line: str) -> str | None:
    try:
        return csv.Sniffer().sniff(line, delimiters=",;\t|").delimiter
    except csv.Error:
        return None


def _is_number(s: str) -> bool:
    try:
        float(s)
        return True
    except ValueError:
        return False


def _drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns with no non-null value. The whole input is read only for columns that are null in its first rows."""
    def held(rows: DataFrame, cols: Sequence[str]) -> set[str]:
        row = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return {c for i, c in enumerate(cols) if row[i] > 0}

    if not df.columns:
        return df
    keep = held(df.limit(FIRST_ROWS), df.columns)
    if left := [c for c in df.columns if c not in keep]:
        keep |= held(df, left)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep])


def read_table(spark: SparkSession, path: str, header: bool | None = None, names: Sequence[str] | None = None,
               numeric_header: str = "repair", null_value: str = NULL_TOKEN, skip_lines: int = 0,
               strip_suffix: str | None = None, drop_null_columns: bool = True) -> DataFrame:
    """Delimited scan with sniffed delimiter, '?' -> null, blank lines skipped.

    * header=None infers: a first line whose every field parses as a number is
      data, not names (``numeric_header='repair'`` keeps that row, unlike the
      reference, which loses it).
    * whitespace-separated files (no delimiter found) split on ``\\s*,\\s*|\\s+``.
    * ``skip_lines`` drops the leading lines of every file, ``strip_suffix``
      removes a trailing marker such as '.' from each record. Of several files
      each has these lines and, if any has, a header; a later row that reads
      like the header is data.
    * columns with no value at all are dropped.
    """
    first = _first_line(spark, path, skip_lines)
    if first is None:
        return spark.createDataFrame([], "empty string")
    delim = sniff_delimiter(first)
    fields = next(csv.reader(io.StringIO(first), delimiter=delim)) if delim else first.split()
    if header is None:
        header = not (numeric_header == "repair" and all(_is_number(f.strip()) for f in fields if f.strip()))
    needs_text = delim is None or skip_lines or strip_suffix
    if not needs_text:
        df = (spark.read.option("header", header).option("sep", delim).option("nullValue", null_value)
              .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
              .option("mode", "PERMISSIVE").csv(path))
    else:
        txt = _without_leading(spark, path, skip_lines + int(header))
        val = F.trim(F.col("value"))
        if strip_suffix:
            val = F.regexp_replace(val, "\\" + strip_suffix + "+$", "")
        pattern = r"\s*,\s*|\s+" if delim is None else "\\" + delim if delim in "|.^$*+?" else delim
        parts = F.split(val, pattern)
        width = len(fields)
        hdr = [f.strip() for f in fields]
        cols = [F.when(F.trim(F.get(parts, F.lit(i))) == null_value, None).otherwise(F.trim(F.get(parts, F.lit(i)))).alias(
            hdr[i] if header else f"_c{i}") for i in range(width)]
        df = txt.select(*cols)
    if names:
        cols = list(names) if len(names) == len(df.columns) else [f"feature_{i}" for i in range(len(df.columns))]
        df = df.toDF(*cols)
    return _drop_all_null(df) if drop_null_columns else df


def read_splits(spark: SparkSession, paths: dict[str, str], spec: TableSpec) -> DataFrame:
    """One CSV per split -> one DataFrame with ``split``; numerics double, categoricals string,
    target double for regression (string otherwise)."""
    parts = []
    for split, p in paths.items():
        d = read_table(spark, p, header=spec.header, names=spec.names or None)
        parts.append(d.withColumn("split", F.lit(split)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    sel = []
    for c in out.columns:
        if c in spec.num or (c == spec.target and spec.task == "regression"):
            sel.append(F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c))
        elif c in spec.cat or c == spec.target:
            sel.append(F.col(c).cast("string"))
        else:
            sel.append(F.col(c))
    return out.select(*sel)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """One directory per table, optionally partitioned (e.g. by split)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_report(tables: dict[str, DataFrame], out_dir: str, fmt: str = "csv") -> None:
    """Report tables (tens of rows each) -> one file per table (``coalesce(1)``)."""
    for name, df in tables.items():
        w = df.coalesce(1).write.mode("overwrite")
        if fmt == "json":
            w.json(f"{out_dir}/{name}")
        else:
            w.option("header", True).csv(f"{out_dir}/{name}")
