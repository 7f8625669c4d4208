"""Table description: column roles, task type and label."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import DataFrame

Task = Literal["binclass", "multiclass", "regression"]


@dataclass(frozen=True)
class TableSpec:
    num: tuple[str, ...] = ()
    cat: tuple[str, ...] = ()
    target: str | None = None
    task: Task = "binclass"
    names: tuple[str, ...] = ()
    header: bool = True
    file_type: str = "csv"
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        both = set(self.num) & set(self.cat)
        if both or (self.target is not None and self.target in set(self.num) | set(self.cat)):
            raise ValueError(f"column roles overlap: {sorted(both) or self.target}")

    @property
    def features(self) -> list[str]:
        return [*self.num, *self.cat]

    def order(self) -> list[str]:
        """Columns in [num.., cat.., target] order."""
        return [*self.num, *self.cat, *([self.target] if self.target else [])]

    def resolve_label(self, df: DataFrame, label: str | int | None = None) -> str:
        """Label column by case/space-insensitive name or by index; default last."""
        from fidspark.operators import prep

        return prep.resolve_label(df, self.target if label is None else label)

    def metadata(self) -> dict[str, dict]:
        """Per-column role metadata (P32), usable as StructField metadata."""
        out = {c: {"role": "num", "sdtype": "numerical"} for c in self.num}
        out.update({c: {"role": "cat", "sdtype": "categorical"} for c in self.cat})
        if self.target:
            kind = "numerical" if self.task == "regression" else "categorical"
            out[self.target] = {"role": "target", "sdtype": kind}
        return out

    def annotate(self, df: DataFrame) -> DataFrame:
        """``df`` with the roles in its schema's metadata (P32); columns without a role stay as they are."""
        for c, roles in self.metadata().items():
            df = df.withMetadata(c, roles)
        return df

    @classmethod
    def from_json(cls, path_or_text: str) -> "TableSpec":
        """Info-JSON source (S6): num/cat/target column indices plus names."""
        text = path_or_text
        if not path_or_text.lstrip().startswith("{"):
            with open(path_or_text, encoding="utf-8") as fh:
                text = fh.read()
        info = json.loads(text)
        names = list(info.get("column_names") or info.get("names") or [])

        def pick(key: str) -> tuple[str, ...]:
            idx = info.get(key, [])
            return tuple(names[i] if names else f"col_{i}" for i in idx)

        tgt = pick("target_col_idx")
        return cls(
            num=pick("num_col_idx"),
            cat=pick("cat_col_idx"),
            target=tgt[0] if tgt else None,
            task=info.get("task_type", "binclass"),
            names=tuple(names),
            header=bool(info.get("header", "infer") != "None"),
            file_type=info.get("file_type", "csv"),
        )
