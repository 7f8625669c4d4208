"""Small SQL-text helpers for the DuckDB oracle strings in ``__spark_entry__``.

They only paste text; nothing here parses or plans SQL.
"""

from __future__ import annotations

from typing import Sequence


def long_sql(view: str, cols: Sequence[str], keep: Sequence[str] = ("side",)) -> str:
    """Unpivot ``cols`` of ``view`` into (keep..., feature, value DOUBLE), nulls kept."""
    k = "".join(f"{c}, " for c in keep)
    return "\nUNION ALL ".join(
        f"SELECT {k}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {view}" for c in cols
    )


def clean_label_sql(c: str) -> str:
    s = f"regexp_replace(trim(CAST({c} AS VARCHAR)), '\\|.*$', '')"
    return f"CASE WHEN {c} IS NULL OR {s} IN ('', '?', 'nan', 'None') THEN NULL ELSE {s} END"


def kolmogorov_sf_sql(lam: str, terms: int = 100) -> str:
    series = (f"list_sum(list_transform(range(1, {terms + 1}), "
              f"lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * ({lam}) * ({lam}))))")
    return f"CASE WHEN ({lam}) < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * {series})) END"


def portable_hash_sql(key: str, seed: int = 0) -> str:
    from fidspark.functions import portable_hash_sql as h

    return h(key, seed)
