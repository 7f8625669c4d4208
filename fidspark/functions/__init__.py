"""Column-expression helpers (all JVM-side, no Python UDFs)."""

from fidspark.functions.exprs import (
    HASH_RANGE,
    clean_label,
    hash_uniform,
    kolmogorov_sf,
    null_markers,
    portable_hash,
    portable_hash_sql,
    safe_div,
)

__all__ = [
    "HASH_RANGE",
    "clean_label",
    "hash_uniform",
    "kolmogorov_sf",
    "null_markers",
    "portable_hash",
    "portable_hash_sql",
    "safe_div",
]
