"""Correlations and associations.

Pairwise Pearson sums are matrix products over Arrow batches (n, x, y, xx, yy, xy
of all pairs, each over its complete rows), one path for every width.  Spearman ranks are exact averaged ranks from the CDF core, so a
hot value never lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidspark.operators import cdf
from fidspark.session import kept


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(list(cols), 2))


def pairwise_corr(df: DataFrame, cols: Sequence[str], group: str | None = None, centre: Sequence[float] | None = None) -> DataFrame:
    """Long (group?, feature_a, feature_b, corr) over the upper triangle (Pearson).

    Each pair uses the rows where both values are present, at any width: a task
    sums n, x, y, xx, yy and xy of all pairs as matrix products over its Arrow
    batches and returns one row per pair, which a group-by adds up. Values are
    centred first, for accuracy, on ``centre`` or else on the column means,
    which takes a pass of its own. Null without two different values on both
    sides.
    """
    d, g = len(cols), [group] if group else []
    pairs = np.triu_indices(d, 1)
    base = df.select(*(F.col(c).cast("string").alias("g") for c in g), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)))
    means = base.agg(*(F.avg(f"x{i}") for i in range(d))).first() if centre is None else centre
    centre = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def sums(x: np.ndarray, there: np.ndarray) -> np.ndarray:
        sx, sq = x.T @ there, (x * x).T @ there
        return np.stack([(there.T @ there)[pairs], sx[pairs], sx.T[pairs], sq[pairs], sq.T[pairs], (x.T @ x)[pairs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            columns = [batch.column(f"x{i}") for i in range(d)]
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]).astype(float)
            x = np.where(there > 0, np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]) - centre, 0.0)
            coded = batch.column("g").dictionary_encode() if group else pa.nulls(batch.num_rows, pa.string()).dictionary_encode()
            names_ = [*coded.dictionary.to_pylist(), None]
            code = coded.indices.fill_null(len(names_) - 1).to_numpy(zero_copy_only=False)
            for i in np.unique(code):
                own = code == i
                total[names_[i]] = total.get(names_[i], 0) + sums(x[own], there[own])
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(pairs[0]), pa.string()), pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1].astype(np.int32)),
                                              *(pa.array(v) for v in t)], names=["g", "i", "j", *names])

    parts = base.mapInArrow(run, "g string, i int, j int, " + ", ".join(f"{c} double" for c in names))
    s = parts.groupBy("g", "i", "j").agg(*(F.sum(c).alias(c) for c in names))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    spread = (vx > 1e-13 * F.col("sxx")) & (vy > 1e-13 * F.col("syy"))
    corr = F.when((F.col("n") > 1) & spread, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    name = F.array(*(F.lit(c) for c in cols))
    return s.select(*(F.col("g").alias(c) for c in g), F.get(name, F.col("i")).alias("feature_a"), F.get(name, F.col("j")).alias("feature_b"), corr.alias("corr"))


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Row id for re-assembling ranks.  Stable for deterministic inputs (file scans);
    checkpoint a non-deterministic input first."""
    return df.withColumn(name, F.monotonically_increasing_id())


def rank_columns(df: DataFrame, cols: Sequence[str], group: str | None = None) -> DataFrame:
    """Replace each column by its average rank (ties averaged), per ``group``.

    Each column is counted by value on its own; the ranks of all are one table,
    computed once. Rows stay whole: a column's ranks are broadcast where they
    are few, else rows are shuffled by that column, hot values left in place.
    """
    g = [group] if group else []
    base = df.select(*g, *[F.col(c).cast("double").alias(c) for c in cols])
    ranks = kept(cdf.average_ranks(kept(cdf.value_counts(base, cols, g), "values"), [*g, "feature"], "value", "n"), "ranks")
    distinct = {r["feature"]: r["n"] for r in ranks.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # one row per column
    rows = with_row_id(base)
    for c in cols:
        rows = cdf.rank_column(rows, c, ranks.where(F.col("feature") == c), g, "n", distinct.get(c, 0), "_rid")
    return rows.select(*g, "_rid", *cols)


def spearman_diff_pairs(r: DataFrame, s: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A7 detail: feature_a, feature_b, real_corr, synthetic_corr, abs_diff (Spearman)."""
    both = r.select(F.lit("real").alias("side"), *cols).unionByName(s.select(F.lit("synthetic").alias("side"), *cols))
    ranked = rank_columns(both, cols, group="side")
    # ranks lie around half the number of a side's values: that is known without ranking
    counts = both.agg(*(F.count(c) / 4 for c in cols)).first()
    c = pairwise_corr(ranked, cols, group="side", centre=list(counts))
    out = c.groupBy("feature_a", "feature_b").agg(
        F.max(F.when(F.col("side") == "real", F.col("corr"))).alias("real_corr"),
        F.max(F.when(F.col("side") == "synthetic", F.col("corr"))).alias("synthetic_corr"),
    )
    return out.withColumn("abs_diff", F.abs(F.col("real_corr") - F.col("synthetic_corr")))


def spearman_diff(r: DataFrame, s: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean absolute Spearman difference over the upper triangle; NaN pairs dropped; 0 if none."""
    return spearman_diff_pairs(r, s, cols).agg(
        F.coalesce(F.avg(F.nanvl("abs_diff", F.lit(None).cast("double"))), F.lit(0.0)).alias("mean_abs_spearman_corr_diff")
    )


# --------------------------------------------------------------------------- mixed associations

def associations(df: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """Long upper-triangle matrix (feature_a, feature_b, assoc).

    num-num: Pearson.  num-cat: correlation ratio eta = sqrt(sum n_g (m_g - m)^2 / sum (y - m)^2).
    cat-cat: bias-corrected Cramer's V; chi-square with Yates' continuity
    correction when the table has one degree of freedom (2 x 2), 0 when the
    corrected dimension is degenerate.
    """
    parts = []
    if len(num) >= 2:
        parts.append(pairwise_corr(df, num).withColumnRenamed("corr", "assoc"))
    if num and cat:
        parts.append(_correlation_ratio(df, num, cat))
    if len(cat) >= 2:
        parts.append(_cramers_v(df, cat))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _correlation_ratio(df: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    d = df.select(*[F.col(c).cast("double").alias(c) for c in num], *[F.col(c).cast("string").alias(c) for c in cat])
    tot = d.agg(*[F.avg(c).alias(f"m_{c}") for c in num], *[F.var_pop(c).alias(f"v_{c}") for c in num],
                *[F.count(c).alias(f"n_{c}") for c in num])
    long = d.unpivot(list(num), list(cat), "cat_feature", "cat_value")
    grp = long.groupBy("cat_feature", "cat_value").agg(
        *[F.count(c).alias(f"k_{c}") for c in num], *[F.avg(c).alias(f"g_{c}") for c in num])
    # tot is one row: attach it through a constant equi-join key
    g = grp.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k")
    rows = []
    for c in num:
        between = F.sum(F.col(f"k_{c}") * F.pow(F.col(f"g_{c}") - F.col(f"m_{c}"), 2))
        total = F.first(F.col(f"v_{c}")) * F.first(F.col(f"n_{c}"))
        eta = F.when(between == 0, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(between, total)))
        rows.append(g.groupBy("cat_feature").agg(eta.alias("assoc")).select(
            F.col("cat_feature").alias("feature_a"), F.lit(c).alias("feature_b"), "assoc"))
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


def _cramers_v(df: DataFrame, cat: Sequence[str]) -> DataFrame:
    pairs = _pairs(cat)
    d = df.select(*[F.col(c).cast("string").alias(c) for c in cat])
    long = d.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(a).alias("va"), F.col(b).alias("vb"))
        for a, b in pairs])).alias("_p")).select("_p.*")
    key = ["feature_a", "feature_b"]
    # observed cells only: (#categories a) x (#categories b) rows per pair at most
    ct = long.where(F.col("va").isNotNull() & F.col("vb").isNotNull()).groupBy(
        *key, "va", "vb").agg(F.count(F.lit(1)).alias("o"))
    t = ct.select(
        "*",
        F.sum("o").over(Window.partitionBy(*key, "va")).alias("ra"),
        F.sum("o").over(Window.partitionBy(*key, "vb")).alias("cb"),
        F.sum("o").over(Window.partitionBy(*key)).alias("n"),
    ).withColumn("e", F.col("ra") * F.col("cb") / F.col("n"))
    st = t.groupBy(*key).agg(
        F.count_distinct("va").alias("r"), F.count_distinct("vb").alias("k"), F.first("n").alias("n"),
        F.sum(F.col("o") * F.col("o") / F.col("e")).alias("o2e"),
        F.sum(F.pow(F.greatest(F.abs(F.col("o") - F.col("e")) - 0.5, F.lit(0.0)), 2) / F.col("e")).alias("yates_obs"),
    )
    # 2 x 2 tables (one degree of freedom) take Yates' correction; their grid has 4 cells, so the
    # unobserved cells are enumerated only for those pairs.
    two = t.join(F.broadcast(st.where("r = 2 AND k = 2").select(*key)), key)
    rows = two.select(*key, "va", "ra", "n").distinct()
    cols = two.select(*key, "vb", "cb").distinct()
    miss = rows.join(cols, key).join(two.select(*key, "va", "vb"), [*key, "va", "vb"], "left_anti")
    e = F.col("ra") * F.col("cb") / F.col("n")
    yz = miss.groupBy(*key).agg(F.sum(F.pow(F.greatest(e - 0.5, F.lit(0.0)), 2) / e).alias("yates_unobs"))
    res = st.join(yz, key, "left")
    n = F.col("n").cast("double")
    # sum over the full grid of (o-e)^2/e == sum over observed o^2/e - n
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2),
                  F.col("yates_obs") + F.coalesce(F.col("yates_unobs"), F.lit(0.0))).otherwise(F.col("o2e") - n)
    phi2c = F.greatest(F.lit(0.0), chi2 / n - (F.col("k") - 1) * (F.col("r") - 1) / (n - 1))
    rc = F.col("r") - F.pow(F.col("r") - 1, 2) / (n - 1)
    kc = F.col("k") - F.pow(F.col("k") - 1, 2) / (n - 1)
    den = F.least(kc - 1, rc - 1)
    v = F.when(den == 0, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(phi2c, den)))
    return res.select(*key, v.alias("assoc"))


def association_diff(r: DataFrame, s: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """A17 per pair on both sides: feature_a, feature_b, real_assoc, synthetic_assoc, abs_diff."""
    a = associations(r, num, cat).withColumnRenamed("assoc", "real_assoc")
    b = associations(s, num, cat).withColumnRenamed("assoc", "synthetic_assoc")
    j = a.join(b, ["feature_a", "feature_b"], "full_outer")
    return j.withColumn("abs_diff", F.abs(F.col("real_assoc") - F.col("synthetic_assoc")))


def association_distance(r: DataFrame, s: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """Frobenius norm of the full matrix difference = sqrt(2 * sum over the upper triangle)."""
    return association_diff(r, s, num, cat).agg(
        F.sqrt(2.0 * F.sum(F.pow(F.col("abs_diff"), 2))).alias("association_distance"))
