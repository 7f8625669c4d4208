"""Encoders and their inverses.

Fitted state is a small "stats" DataFrame or dict (one value per column, or
one row per category) computed by one aggregate over the *train* side;
applying it is a column expression or a broadcast join against a
dictionary whose size is the number of categories.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidspark.functions import hash_uniform
from fidspark.functions.numeric import beta_ppf, normal_cdf
from fidspark.operators import cdf
from fidspark.session import kept


# --------------------------------------------------------------------------- numeric scalers

def fit_scale(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """One aggregate: mean, population std, min, max per column."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
                 *[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    return {c: {"mean": row[f"m_{c}"], "std": row[f"s_{c}"] or 1.0, "min": row[f"lo_{c}"], "max": row[f"hi_{c}"]}
            for c in cols}


def standard_scale(df: DataFrame, st: dict, inverse: bool = False) -> DataFrame:
    """(x - mean) / std (population std, 0 -> 1) and its inverse."""
    out = []
    for c in df.columns:
        if c in st:
            m, s = st[c]["mean"], st[c]["std"]
            out.append(((F.col(c) * s + m) if inverse else ((F.col(c) - m) / s)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def minmax_scale(df: DataFrame, st: dict, centered: bool = False, inverse: bool = False) -> DataFrame:
    """To [0,1] (or [-1,1] when centered); inverse clips into the fitted range."""
    out = []
    for c in df.columns:
        if c not in st:
            out.append(F.col(c))
            continue
        lo, hi = st[c]["min"], st[c]["max"]
        w = (hi - lo) if hi != lo else 1.0
        if not inverse:
            x = (F.col(c) - lo) / w
            out.append((x * 2 - 1 if centered else x).alias(c))
        else:
            x = (F.col(c) + 1) / 2 if centered else F.col(c)
            out.append(F.greatest(F.least(x * w + lo, F.lit(hi)), F.lit(lo)).alias(c))
    return df.select(*out)


def log_clip(c: str, lo: float = 1.0, hi: float = 20000.0) -> Column:
    """E5: ln(clip(y, lo, hi))."""
    return F.log(F.greatest(F.least(F.col(c).cast("double"), F.lit(hi)), F.lit(lo)))


def log_encode(df: DataFrame, cols: Sequence[str], sentinel: float = -9999999.0, eps: float = 1.0,
               inverse: bool = False, lower: dict | None = None) -> tuple[DataFrame, dict]:
    """Bounded log transform, sentinel untouched.

    min > 0: ln(x); min == 0: ln(x + eps); min < 0: ln(x - min + eps).
    The inverse applies exp and undoes the shift for every case.
    """
    if lower is None:
        row = df.agg(*[F.min(F.when(F.col(c) != sentinel, F.col(c))).alias(c) for c in cols]).first()
        lower = {c: row[c] for c in cols}
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(F.col(c))
            continue
        lo = lower[c]
        shift = 0.0 if lo > 0 else (eps if lo == 0 else eps - lo)
        x = F.col(c)
        e = (F.exp(x) - shift) if inverse else F.log(x + F.lit(shift))
        out.append(F.when(x == sentinel, x).otherwise(e).alias(c))
    return df.select(*out), lower


def round_integers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Round half to even (as NumPy) and cast to long."""
    return df.select(*[F.bround(F.col(c)).cast("long").alias(c) if c in cols else F.col(c) for c in df.columns])


def dequantize_inverse(c: str, dist: str = "uniform") -> Column:
    """E13 inverse: floor for uniform noise, round-half-even otherwise."""
    return (F.floor(F.col(c)) if dist == "uniform" else F.bround(F.col(c))).cast("long")


def dequantize(df: DataFrame, cols: Sequence[str], key: str, factor: float = 1.0, seed: int = 0,
               dist: str = "uniform") -> DataFrame:
    """Add noise drawn per (row, column) by a hash: u * ``factor`` (uniform) or a Beta(factor, factor) value less 0.5
    (beta), by its quantile at u. Other ``dist`` add nothing. Nulls stay."""

    @F.pandas_udf("double")
    def beta(u: pd.Series) -> pd.Series:
        return pd.Series(beta_ppf(u.to_numpy(np.float64), factor, factor))

    out = []
    for i, c in enumerate(df.columns):
        if c in cols:
            u = hash_uniform(key, seed * 131 + i)
            noise = u * factor if dist == "uniform" else beta(u) - 0.5 if dist == "beta" else F.lit(0.0)
            out.append((F.col(c).cast("double") + noise).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# --------------------------------------------------------------------------- categorical

def fit_dictionary(df: DataFrame, cols: Sequence[str], order: str = "alpha") -> DataFrame:
    """(feature, value, idx) per column: idx by sorted string (alpha) or by frequency (freq, ties by value)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value").where(F.col("value").isNotNull())
    cnt = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    by = ["value"] if order == "alpha" else [F.desc("n"), F.asc("value")]
    return cdf.numbered(cnt, ["feature"], by).withColumn("idx", (F.col("rn") - 1).cast("int")).drop("rn")


def ordinal(df: DataFrame, cols: Sequence[str], dictionary: DataFrame, unknown: str = "max+1") -> DataFrame:
    """Category -> index from the train dictionary; unknown -> K (max + 1; 0 for an empty dictionary) or null."""
    out = df
    for c in cols:
        known = dictionary.where(F.col("feature") == c)
        out = out.join(known.select(F.col("value").alias("_v"), F.col("idx").alias("_i")), out[c].cast("string") == F.col("_v"), "left")
        if unknown == "max+1":  # one row, also of an empty dictionary
            out = out.withColumn("_k", F.lit(1)).join(known.agg(F.count("*").cast("int").alias("_n")).withColumn("_k", F.lit(1)), "_k")
            out = out.withColumn("_i", F.coalesce("_i", "_n")).drop("_k", "_n")
        out = out.withColumn(c, F.col("_i")).drop("_v", "_i")
    return out


def ordinal_inverse(df: DataFrame, cols: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """E14 inverse: index -> category via the dictionary; the planner broadcasts it where it is small."""
    out = df
    for c in cols:
        known = dictionary.where(F.col("feature") == c).select(F.col("value").alias("_v"), F.col("idx").alias("_i"))
        out = out.join(known, out[c] == F.col("_i"), "left").withColumn(c, F.col("_v")).drop("_v", "_i")
    return out


def one_hot(df: DataFrame, col: str, categories: Sequence[str], out: str | None = None) -> DataFrame:
    """Array of 0/1 over the known categories; unknown -> all zeros."""
    arr = F.array(*[(F.col(col).cast("string") == F.lit(v)).cast("double") for v in categories])
    return df.withColumn(out or f"{col}_oh", F.coalesce(arr, F.array(*[F.lit(0.0)] * len(categories))))


def categories_of(dictionary: DataFrame, col: str) -> list[str]:
    """Sorted category list of one column (size = #categories)."""
    return [r[0] for r in dictionary.where(F.col("feature") == col).orderBy("idx").select("value").collect()]


def decode_one_hot(df: DataFrame, arr: str, categories: Sequence[str], out: str) -> DataFrame:
    """Arg-max of the block -> category."""
    cats = F.array(*[F.lit(v) for v in categories])
    pos = F.array_position(F.col(arr), F.array_max(F.col(arr)))
    return df.withColumn(out, F.element_at(cats, pos.cast("int")))


def collapse_rare(df: DataFrame, cols: Sequence[str], min_frequency: float, train: DataFrame | None = None,
                  rare: str = "__rare__") -> DataFrame:
    """Category -> ``rare`` if its train count < round(n * min_frequency)."""
    train = train if train is not None else df
    n = train.count()
    thr = round(n * min_frequency)
    long = train.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
    keep = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= thr)
    out = df
    for c in cols:
        kc = keep.where(F.col("feature") == c).select(F.col("value").alias(f"_v_{c}"))
        out = out.join(kc, out[c].cast("string") == F.col(f"_v_{c}"), "left").withColumn(
            c, F.when(F.col(f"_v_{c}").isNotNull(), F.col(c).cast("string")).otherwise(F.lit(rare))).drop(f"_v_{c}")
    return out


def numeric_nulls(df: DataFrame, cols: Sequence[str], policy: str = "mean", train: DataFrame | None = None) -> DataFrame:
    """Drop rows with null numerics, or fill with the train mean."""
    if policy == "drop":
        return df.na.drop(subset=list(cols))
    train = train if train is not None else df
    row = train.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return df.select(*[F.coalesce(F.col(c), F.lit(row[c])).alias(c) if c in cols else F.col(c) for c in df.columns])


def categorical_nulls(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Null -> most frequent train value (smallest value on ties)."""
    train = train if train is not None else df
    d = fit_dictionary(train, cols, order="freq").where(F.col("idx") == 0)
    modes = {r["feature"]: r["value"] for r in d.collect()}  # one row per column
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(modes.get(c))).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def leave_one_out(df: DataFrame, col: str, y: str, sigma: float = 0.0, key: str | None = None,
                  seed: int = 0) -> DataFrame:
    """(sum(y) - y) / (n - 1) per category (global mean when n == 1), times (1 + N(0, sigma)) noise."""
    # sums per category and overall are aggregates that join back, so no category's rows meet in one task
    groups = df.groupBy(F.col(col).alias("_c")).agg(F.sum(y).alias("_s"), F.count(F.lit(1)).alias("_n"))
    overall = df.agg(F.avg(y).alias("_m")).withColumn("_k", F.lit(1))
    groups = groups.withColumn("_k", F.lit(1)).join(overall, "_k").drop("_k")
    df = df.join(groups, F.col(col).eqNullSafe(F.col("_c")))
    loo = F.when(F.col("_n") > 1, (F.col("_s") - F.col(y)) / (F.col("_n") - 1)).otherwise(F.col("_m"))
    if sigma and key:
        u1, u2 = hash_uniform(key, seed), hash_uniform(key, seed + 1)
        z = F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * np.pi * u2)
        loo = loo * (1 + sigma * z)
    return df.withColumn(f"{col}_loo", loo).drop("_c", "_s", "_n", "_m")


def ordinal_ratio(df: DataFrame, cols: Sequence[str], dictionary: DataFrame, inverse: bool = False) -> DataFrame:
    """Frequency index / size (dictionary ordered by frequency); inverse rounds and clips."""
    sizes = {r["feature"]: r["k"] for r in dictionary.groupBy("feature").agg(F.count(F.lit(1)).alias("k")).collect()}
    if not inverse:
        out = ordinal(df, cols, dictionary, unknown="null")
        return out.select(*[(F.col(c) / F.lit(float(sizes[c]))).alias(c) if c in cols else F.col(c) for c in out.columns])
    tmp = df.select(*[F.least(F.greatest(F.round(F.col(c) * sizes[c]), F.lit(0)), F.lit(sizes[c] - 1)).cast("int").alias(c)
                      if c in cols else F.col(c) for c in df.columns])
    return ordinal_inverse(tmp, cols, dictionary)


# --------------------------------------------------------------------------- quantile transform

def quantile_grid(df: DataFrame, cols: Sequence[str], n_quantiles: int | None = None) -> dict[str, list[float]]:
    """E3 fit: references = percentile(c, linspace(0,1,nq)) with nq = max(min(n // 30, 1000), 10)."""
    n = df.count()
    nq = n_quantiles or max(min(n // 30, 1000), 10)
    probs = [float(x) for x in np.linspace(0.0, 1.0, nq)]
    counts = kept(cdf.value_counts(df, cols, n="n_r"), "values")
    pre = cdf.prefix_sums(counts, ["feature"], "value", ["n_r"])
    q = cdf.quantiles(pre, probs, sides=["n_r"]).collect()  # nq values per column
    grid: dict[str, list[float]] = {c: [0.0] * nq for c in cols}
    pos = {p: i for i, p in enumerate(probs)}
    for r in q:
        grid[r["feature"]][pos[r["p"]]] = r["q"]
    return grid


# Coefficients of the published rational approximation of the normal quantile
# (relative error below 1.2e-9).
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]


def normal_ppf(p: np.ndarray) -> np.ndarray:
    """Vectorised standard normal quantile for p in (0, 1)."""
    p = np.asarray(p, dtype=np.float64)
    out = np.empty_like(p)
    lo, hi = p < 0.02425, p > 1 - 0.02425
    mid = ~(lo | hi)
    q = p[mid] - 0.5
    r = q * q
    out[mid] = (((((_A[0] * r + _A[1]) * r + _A[2]) * r + _A[3]) * r + _A[4]) * r + _A[5]) * q / \
        (((((_B[0] * r + _B[1]) * r + _B[2]) * r + _B[3]) * r + _B[4]) * r + 1)
    for mask, sign, pp in ((lo, 1.0, p[lo]), (hi, -1.0, 1 - p[hi])):
        qq = np.sqrt(-2 * np.log(pp))
        out[mask] = sign * (((((_C[0] * qq + _C[1]) * qq + _C[2]) * qq + _C[3]) * qq + _C[4]) * qq + _C[5]) / \
            ((((_D[0] * qq + _D[1]) * qq + _D[2]) * qq + _D[3]) * qq + 1)
    return out


def quantile_normal(df: DataFrame, grid: dict[str, list[float]], inverse: bool = False) -> DataFrame:
    """E3 transform: interpolate on the broadcast grid, then the normal quantile (Arrow batches)."""
    clip = 1e-7
    bc = df.sparkSession.sparkContext.broadcast(grid)

    def make(col: str):
        @F.pandas_udf("double")
        def fwd(x: pd.Series) -> pd.Series:
            g = np.asarray(bc.value[col])
            ref = np.linspace(0, 1, len(g))
            if not inverse:
                # average of forward and backward interpolation handles repeated grid values
                u = 0.5 * (np.interp(x, g, ref) - np.interp(-x, -g[::-1], -ref[::-1]))
                return pd.Series(normal_ppf(np.clip(u, clip, 1 - clip)))
            return pd.Series(np.interp(normal_cdf(x.to_numpy(np.float64)), ref, g))

        return fwd

    return df.select(*[make(c)(F.col(c).cast("double")).alias(c) if c in grid else F.col(c) for c in df.columns])
