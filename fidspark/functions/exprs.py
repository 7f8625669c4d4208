"""Scalar column expressions shared by the operators.

Draws and splits use a *portable* keyed hash (md5 of key and seed) instead of
``rand()``: it gives the same in Spark and in any SQL engine, does not depend on
how the data is partitioned, and is stable when a lost task is recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the digest that a draw uses, and the number of values they have.
HASH_DIGITS = 10
HASH_RANGE = 16**HASH_DIGITS


def portable_hash_sql(key: str, seed: int = 0) -> str:
    """SQL text of the hash: leading hex digits of md5(key:seed), read in a way that any engine can."""
    digest = f"md5(concat({key}, ':{int(seed)}'))"
    return "(" + " + ".join(f"CAST(instr('123456789abcdef', substr({digest}, {i + 1}, 1)) AS BIGINT) * {16 ** (HASH_DIGITS - 1 - i)}"
                            for i in range(HASH_DIGITS)) + ")"


def hash_uniform_sql(key: str, seed: int = 0) -> str:
    return f"({portable_hash_sql(key, seed)} / {HASH_RANGE}e0)"


def portable_hash(key: Column | str, seed: int = 0) -> Column:
    """A whole number below HASH_RANGE; different seeds give independent draws."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("long").cast("string"), F.lit(f":{int(seed)}")))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def hash_uniform(key: Column | str, seed: int = 0) -> Column:
    """Deterministic value in [0, 1) from a row key and a seed."""
    return portable_hash(key, seed) / F.lit(float(HASH_RANGE))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(num, den)


# Label tokens that mean "missing" after cleaning.
MISSING_LABEL_TOKENS = ["", "?", "nan", "None"]


def clean_label(c: Column | str) -> Column:
    """Trim, drop an annotation suffix after '|', and null out missing tokens."""
    col = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.trim(col.cast("string")), r"\|.*$", "")
    return F.when(col.isNull() | s.isin(*MISSING_LABEL_TOKENS), F.lit(None).cast("string")).otherwise(s)


def null_markers(c: Column | str, marks=("?", "", " ")) -> Column:
    """Turn missing-value markers into SQL NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(col.cast("string")).isin(*[m.strip() for m in marks]), None).otherwise(col)


def kolmogorov_sf(lam: Column, terms: int = 100) -> Column:
    """Survival function of the Kolmogorov distribution, Q(l) = 2 sum (-1)^(k-1) exp(-2 k^2 l^2).

    Clipped to [0, 1]; for l < 0.2 the value is 1 to within 1e-9.
    """
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))
