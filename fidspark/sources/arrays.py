"""Tables kept as array files per split (X_num_<split>.npy, X_cat_<split>.npy, y_<split>.npy).

A Python data source reads the arrays' headers on the driver and deals row
ranges to tasks; each task seeks to its rows in the files that exist and reads
nothing else, so numbers, categories and target of a row come together without
a join. Folders are any that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTS = ("X_num", "X_cat", "y")
ROWS_PER_TASK = 1 << 18


@dataclass
class Header:
    """Where an array's rows lie in its file."""

    file: str
    dtype: np.dtype
    shape: tuple[int, ...]
    start: int

    @property
    def width(self) -> int:
        return self.shape[1] if len(self.shape) > 1 else 1


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def header(folder: str, name: str) -> Header | None:
    """The header of ``folder``/``name``.npy; None if there is no such file."""
    store, base = _store(folder)
    file = f"{base}/{name}.npy"
    if store.get_file_info(file).type != fs.FileType.File:
        return None
    with store.open_input_file(file) as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if dtype.hasobject:
            raise ValueError(f"{name}.npy holds Python objects, which cannot be read by row range; save it with a text or number type")
        if by_column:
            raise ValueError(f"{name}.npy is stored column by column")
        return Header(file, dtype, shape, f.tell())


def _rows(folder: str, h: Header, lo: int, hi: int) -> np.ndarray:
    store, _ = _store(folder)
    with store.open_input_file(h.file) as f:
        f.seek(h.start + lo * h.width * h.dtype.itemsize)
        data = f.read((hi - lo) * h.width * h.dtype.itemsize)
    return np.frombuffer(io.BytesIO(data).getbuffer(), h.dtype).reshape(hi - lo, h.width)


@dataclass
class RowRange(InputPartition):
    split: str
    lo: int
    hi: int


class SplitArrays(DataSource):
    """Format ``split_arrays``; options: path, splits (comma-joined, default those of train, val and test that exist)."""

    @classmethod
    def name(cls) -> str:
        return "split_arrays"

    def _found(self) -> dict[str, dict[str, Header]]:
        asked = self.options.get("splits")
        found = {}
        for split in asked.split(",") if asked else ("train", "val", "test"):
            parts = {p: h for p in PARTS if (h := header(self.options["path"], f"{p}_{split}"))}
            if "y" in parts:
                found[split] = parts
            elif asked:
                raise FileNotFoundError(f"y_{split}.npy")
        if not found:
            raise FileNotFoundError(f"no y_<split>.npy in {self.options['path']}")
        for split, parts in found.items():
            if len({h.shape[0] for h in parts.values()}) > 1:
                raise ValueError(f"the arrays of {split} differ in their number of rows")
        return found

    def schema(self) -> str:
        parts = next(iter(self._found().values()))
        kind = "string" if parts["y"].dtype.kind in "US" else "double" if parts["y"].dtype.kind == "f" else "long"
        cols = [f"num_{i} double" for i in range(parts["X_num"].width if "X_num" in parts else 0)]
        cols += [f"cat_{i} string" for i in range(parts["X_cat"].width if "X_cat" in parts else 0)]
        return ", ".join(["split string", "row long", *cols, f"y {kind}"])

    def reader(self, schema) -> DataSourceReader:
        return SplitReader(self.options["path"], self._found(), int(self.options.get("rows", ROWS_PER_TASK)))


def _text(column: np.ndarray) -> pa.Array:
    return pa.array([x.decode() if isinstance(x, bytes) else str(x) for x in column.tolist()], pa.string())


class SplitReader(DataSourceReader):
    def __init__(self, folder: str, found: dict[str, dict[str, Header]], rows: int):
        self.folder, self.found, self.rows = folder, found, rows

    def partitions(self) -> list[RowRange]:
        return [RowRange(split, lo, min(lo + self.rows, parts["y"].shape[0])) for split, parts in self.found.items()
                for lo in range(0, parts["y"].shape[0], self.rows)] or [RowRange(next(iter(self.found)), 0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if part.hi == part.lo:
            return
        arrays = {p: _rows(self.folder, h, part.lo, part.hi) for p, h in self.found[part.split].items()}
        cols = {"split": pa.array([part.split] * (part.hi - part.lo), pa.string()), "row": pa.array(np.arange(part.lo, part.hi))}
        for i in range(arrays["X_num"].shape[1] if "X_num" in arrays else 0):
            cols[f"num_{i}"] = pa.array(arrays["X_num"][:, i].astype(np.float64))
        for i in range(arrays["X_cat"].shape[1] if "X_cat" in arrays else 0):
            cols[f"cat_{i}"] = _text(arrays["X_cat"][:, i])
        y = arrays["y"][:, 0]
        cols["y"] = _text(y) if y.dtype.kind in "US" else pa.array(y.astype(np.float64 if y.dtype.kind == "f" else np.int64))
        yield pa.RecordBatch.from_pydict(cols)


def read_split_arrays(spark: SparkSession, folder: str, splits: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One table of all splits: split, row (from 0 within the split), num_0.., cat_0.., y.

    ``X_num`` and ``X_cat`` may be missing, ``y`` tells which splits there are.
    Numbers become doubles (NaN stays), categories text, y text, double or long
    by its type. Arrays of Python objects are refused.
    """
    spark.dataSource.register(SplitArrays)
    reader = spark.read.format("split_arrays").option("path", folder).option("rows", rows_per_task)
    return (reader.option("splits", splits) if splits else reader).load()
