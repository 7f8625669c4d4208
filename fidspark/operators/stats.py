"""Descriptive comparison metrics.

Rule: all columns go through *one* aggregate or one long-form shuffle; never
one job per column.  Quantiles are exact and come from the CDF core.
"""

from __future__ import annotations

from typing import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidspark.functions import clean_label
from fidspark.functions.numeric import ks_exact
from fidspark.operators import cdf
from fidspark.session import kept

# The tail levels, and the sample size up to which the p-value of the KS test is exact.
TAIL_PROBS = (0.01, 0.05, 0.95, 0.99)
KS_EXACT_ROWS = 10_000


def _pct_name(p: float) -> str:
    return f"q{int(round(p * 100)):02d}"


# --------------------------------------------------------------------------- labels

def stack_labels(r: DataFrame, s: DataFrame, label: str) -> DataFrame:
    """(side, lab) with cleaned labels; side 'real' / 'synthetic' (U1 on one column)."""
    return r.select(F.lit("real").alias("side"), clean_label(label).alias("lab")).unionByName(
        s.select(F.lit("synthetic").alias("side"), clean_label(label).alias("lab"))
    )


def label_mode_numeric(labs: DataFrame, threshold: float = 0.95) -> bool:
    """True if >= 95 % of the rows on *both* sides parse as numbers (one tiny aggregate)."""
    ok = F.expr("try_cast(lab AS DOUBLE)").isNotNull().cast("double")
    row = labs.agg(
        F.avg(F.when(F.col("side") == "real", ok)).alias("r"),
        F.avg(F.when(F.col("side") == "synthetic", ok)).alias("s"),
    ).first()
    return row is not None and (row["r"] or 0) >= threshold and (row["s"] or 0) >= threshold


def class_distribution(
    r: DataFrame, s: DataFrame, label: str, expected: Sequence[int] | None = None
) -> DataFrame:
    """A1: class, real_count, synthetic_count, real_prop, synthetic_prop, abs_prop_diff.

    Numeric mode (fixed class list, or >= 95 % numeric on both sides): classes
    are integers (truncated) kept as text.  Otherwise cleaned strings.  With a
    fixed list, other classes are ignored before proportions and absent ones
    are kept with zero counts.
    """
    labs = stack_labels(r, s, label)
    numeric = bool(expected) or label_mode_numeric(labs)
    if numeric:
        cls = F.expr("try_cast(lab AS DOUBLE)").cast("long")
        labs = labs.select("side", cls.alias("cls")).where(F.col("cls").isNotNull())
    else:
        labs = labs.select("side", F.col("lab").alias("cls")).where(F.col("cls").isNotNull())
    counts = labs.groupBy("cls").agg(
        F.count_if(F.col("side") == "real").alias("real_count"),
        F.count_if(F.col("side") == "synthetic").alias("synthetic_count"),
    )
    if expected:
        spark = r.sparkSession
        want = spark.createDataFrame([(int(c),) for c in expected], "cls long")
        counts = want.join(counts, "cls", "left").na.fill(0, ["real_count", "synthetic_count"])
    w = Window.partitionBy()  # report-size table (one row per class)
    out = counts.select(
        F.col("cls").cast("string").alias("class"),
        "real_count",
        "synthetic_count",
        (F.col("real_count") / F.greatest(F.sum("real_count").over(w), F.lit(1))).alias("real_prop"),
        (F.col("synthetic_count") / F.greatest(F.sum("synthetic_count").over(w), F.lit(1))).alias("synthetic_prop"),
    )
    return out.withColumn("abs_prop_diff", F.abs(F.col("real_prop") - F.col("synthetic_prop")))


def class_counts(df: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """A2: count per class over a fixed class list, zero-filled."""
    spark = df.sparkSession
    want = spark.createDataFrame([(int(c),) for c in classes], "class long")
    got = df.select(F.expr(f"try_cast(`{label}` AS DOUBLE)").cast("long").alias("class")).groupBy("class").count()
    return want.join(got, "class", "left").select("class", F.coalesce("count", F.lit(0)).alias("count"))


# --------------------------------------------------------------------------- numeric, per feature

class NumericComparison:
    """Shared two-sided value counts + CDF for a set of numeric columns.

    Build once, derive every per-feature table from it (tail quantiles, IQR
    outliers, KS, Wasserstein, range checks).  ``persist`` the counts for
    several consumers; Spark recomputes them from the scan if lost.
    """

    def __init__(self, r: DataFrame, s: DataFrame, cols: Sequence[str], buckets: int | None = None):
        self.cols = list(cols)
        self.counts = cdf.two_sided_counts(r, s, self.cols)
        self.pre = cdf.prefix_sums(self.counts, ["feature"], "value", ["n_r", "n_s"], buckets)

    def unpersist(self) -> None:
        """Release what :meth:`persist` holds, once its consumers have run."""
        for held in (self.counts, self.pre.table, self.pre.totals):
            held.unpersist()

    def persist(self) -> "NumericComparison":
        """Materialise the distinct-value table and its CDF once for several consumers.

        MEMORY_AND_DISK blocks are recomputed from lineage if an executor is lost."""
        from pyspark import StorageLevel

        self.counts = self.counts.persist(StorageLevel.MEMORY_AND_DISK)
        pre = cdf.prefix_sums(self.counts, ["feature"], "value", ["n_r", "n_s"])
        self.pre = cdf.Prefix(pre.table.persist(StorageLevel.MEMORY_AND_DISK),
                              pre.totals.persist(StorageLevel.MEMORY_AND_DISK))
        return self

    # A3
    def tail_quantiles(self, probs: Sequence[float] = TAIL_PROBS) -> DataFrame:
        q = cdf.quantiles(self.pre, probs)
        aggs = []
        for p in probs:
            nm = _pct_name(p)
            sel = F.col("p") == float(p)
            aggs.append(F.max(F.when(sel & (F.col("side") == "n_r"), F.col("q"))).alias(f"real_{nm}"))
            aggs.append(F.max(F.when(sel & (F.col("side") == "n_s"), F.col("q"))).alias(f"synthetic_{nm}"))
        wide = q.groupBy("feature").agg(*aggs)
        return wide.select(
            "feature",
            *[c for p in probs for c in (f"real_{_pct_name(p)}", f"synthetic_{_pct_name(p)}")],
            *[F.abs(F.col(f"real_{_pct_name(p)}") - F.col(f"synthetic_{_pct_name(p)}")).alias(f"abs_diff_{_pct_name(p)}")
              for p in probs],
        )

    def real_quantiles(self, probs: Sequence[float]) -> DataFrame:
        """(feature, q_<pp>...) from the real side only; one row per feature (small)."""
        q = cdf.quantiles(self.pre, probs, sides=["n_r"])
        return q.groupBy("feature").agg(
            *[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(_pct_name(p)) for p in probs]
        )

    # A4
    def iqr_outlier_rate(self) -> DataFrame:
        fences = self.real_quantiles([0.25, 0.75]).select(
            "feature",
            (F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))).alias("lo"),
            (F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("hi"),
        )
        c = self.counts.join(F.broadcast(fences), "feature", "left")  # fences: one row per feature
        inside = F.coalesce(F.col("value").between(F.col("lo"), F.col("hi")), F.lit(False))
        out = c.groupBy("feature").agg(
            F.try_divide(F.sum(F.when(~inside, F.col("n_r")).otherwise(0)), F.sum("n_r")).alias("real_outlier_rate"),
            F.try_divide(F.sum(F.when(~inside, F.col("n_s")).otherwise(0)), F.sum("n_s")).alias("synthetic_outlier_rate"),
        )
        return out.withColumn("abs_rate_diff", F.abs(F.col("real_outlier_rate") - F.col("synthetic_outlier_rate")))

    # A5
    def ks(self, exact_rows: int = KS_EXACT_ROWS) -> DataFrame:
        """Per feature the KS statistic and its p-value: exact where both samples have at most ``exact_rows`` values
        (ties counted as the lattice of all orders does), else asymptotic."""
        st = cdf.ks_statistic(self.pre)
        full = self.counts.select("feature").distinct()  # keep all-null features as null
        st = full.join(st, "feature", "left")
        series = cdf.ks_pvalue(F.col("ks_statistic"), F.col("n_r").cast("double"), F.col("n_s").cast("double"))
        if not exact_rows:
            return st.select("feature", "ks_statistic", series.alias("p_value"))

        @F.pandas_udf("double")
        def exact(d: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([ks_exact(x, int(a), int(b)) if a <= exact_rows and b <= exact_rows else None for x, a, b in zip(d, m, n)], dtype="float64")

        few = F.greatest("n_r", "n_s") <= exact_rows
        asked = [F.when(few, F.col(c)).otherwise(F.lit(0)) for c in ("n_r", "n_s")]
        return st.withColumn("_exact", exact(F.coalesce("ks_statistic", F.lit(0.0)), *[F.coalesce(c, F.lit(0)).cast("long") for c in asked])).select(
            "feature", "ks_statistic", F.when(few, F.col("_exact")).otherwise(series).alias("p_value"))

    # A16
    def wasserstein(self) -> DataFrame:
        mm = self.counts.where(F.col("n_r") > 0).groupBy("feature").agg(
            F.min("value").alias("lo"), F.max("value").alias("hi")
        )
        scale = mm.select("feature", "lo", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
                          .otherwise(F.lit(1.0)).alias("width"))
        return cdf.wasserstein(self.pre, scale)

    # A9
    def range_violations(self) -> DataFrame:
        mm = self.counts.where(F.col("n_r") > 0).groupBy("feature").agg(
            F.min("value").alias("mn"), F.max("value").alias("mx")
        )
        c = self.counts.join(F.broadcast(mm), "feature", "left")
        below = F.coalesce(F.col("value") < F.col("mn"), F.lit(False))
        above = F.coalesce(F.col("value") > F.col("mx"), F.lit(False))
        return c.groupBy("feature").agg(
            F.try_divide(F.sum(F.when(below, F.col("n_s")).otherwise(0)), F.sum("n_s")).alias("below_min_rate"),
            F.try_divide(F.sum(F.when(above, F.col("n_s")).otherwise(0)), F.sum("n_s")).alias("above_max_rate"),
        )

    # A10
    def binary_violations(self) -> DataFrame:
        """Per binary column (real distinct non-null values within {0,1}): synthetic share outside {0,1}."""
        isbin = self.counts.groupBy("feature").agg(
            F.bool_and(F.when(F.col("n_r") > 0, F.col("value").isin(0.0, 1.0))).alias("is_bin"),
            F.sum(F.when(F.col("value").isNotNull(), F.col("n_r"))).alias("nn_r"),
        )
        bins = isbin.where(F.col("is_bin") & (F.col("nn_r") > 0)).select("feature")
        c = self.counts.join(F.broadcast(bins), "feature")
        ok = F.coalesce(F.col("value").isin(0.0, 1.0), F.lit(False))
        return c.groupBy("feature").agg(
            F.try_divide(F.sum(F.when(~ok, F.col("n_s")).otherwise(0)), F.sum("n_s")).alias("invalid_rate")
        )


def tail_quantiles(r: DataFrame, s: DataFrame, cols: Sequence[str], probs: Sequence[float] = TAIL_PROBS) -> DataFrame:
    return NumericComparison(r, s, cols).tail_quantiles(probs)


def iqr_outlier_rate(r: DataFrame, s: DataFrame, cols: Sequence[str]) -> DataFrame:
    return NumericComparison(r, s, cols).iqr_outlier_rate()


def ks_two_sample(r: DataFrame, s: DataFrame, cols: Sequence[str], exact_rows: int = KS_EXACT_ROWS) -> DataFrame:
    return NumericComparison(r, s, cols).ks(exact_rows)


def ks_significant_share(ks: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Share of features with p < alpha (null p counts as not significant)."""
    return ks.agg(F.avg(F.coalesce(F.col("p_value") < alpha, F.lit(False)).cast("double")).alias("ks_sig_feature_rate"))


def wasserstein_1d(r: DataFrame, s: DataFrame, cols: Sequence[str]) -> DataFrame:
    return NumericComparison(r, s, cols).wasserstein()


def range_violations(r: DataFrame, s: DataFrame, cols: Sequence[str]) -> DataFrame:
    return NumericComparison(r, s, cols).range_violations()


def binary_violations(r: DataFrame, s: DataFrame, cols: Sequence[str]) -> DataFrame:
    return NumericComparison(r, s, cols).binary_violations()


def validity_summary(r: DataFrame, s: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A9 + A10 roll-up: unweighted means over columns (0 when no binary column)."""
    nc = NumericComparison(r, s, cols)
    rv = nc.range_violations().agg(
        F.avg("below_min_rate").alias("range_violation_rate_below_min"),
        F.avg("above_max_rate").alias("range_violation_rate_above_max"),
    )
    bv = nc.binary_violations().agg(F.coalesce(F.avg("invalid_rate"), F.lit(0.0)).alias("binary_constraint_violation_rate"))
    return rv.withColumn("_k", F.lit(1)).join(bv.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each


# --------------------------------------------------------------------------- imputation

def real_medians(r: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of the real side (CDF core), returned as a small dict (one value per column)."""
    counts = kept(cdf.value_counts(r, cols, n="n_r"), "values")
    pre = cdf.prefix_sums(counts, ["feature"], "value", ["n_r"])
    q = cdf.quantiles(pre, [0.5], sides=["n_r"])
    got = {row["feature"]: row["q"] for row in q.collect()}  # one row per column
    return {c: got.get(c) for c in cols}


def impute_median(r: DataFrame, s: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Fill nulls with the real median on both sides, then 0 for all-null columns."""
    med = real_medians(r, cols)
    return fill_numbers(r, med), fill_numbers(s, med)


def fill_numbers(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Nulls of the named columns become their value, 0 where that is null."""
    return df.select(*[
        F.coalesce(F.col(c).cast("double"), F.lit(values[c] if values[c] is not None else 0.0)).alias(c)
        if c in values else F.col(c)
        for c in df.columns
    ])


# --------------------------------------------------------------------------- profile

def integer_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row, ``<col>`` = every non-null value is whole (one aggregate for all columns)."""
    return df.agg(*[
        F.coalesce(F.bool_and(F.col(c).cast("double") % 1 == 0), F.lit(True)).alias(c) for c in cols
    ])


def category_sizes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n_categories) -- distinct non-null values per column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
    return long.where(F.col("value").isNotNull()).groupBy("feature").agg(F.count_distinct("value").alias("n_categories"))


def profile(df: DataFrame, num: Sequence[str], cat: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(numeric profile, category table).

    numeric: feature, min, max, is_int, n_rows, n_null.
    categories: feature, value, n, freq_rank (1 = most frequent; ties by value).
    """
    long = cdf.long_form(df, num)
    nump = long.groupBy("feature").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(F.bool_and(F.col("value") % 1 == 0), F.lit(True)).alias("is_int"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
    )
    cats = (df.select(*[F.col(c).cast("string").alias(c) for c in cat])
            .unpivot([], list(cat), "feature", "value")
            .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    cats = cdf.numbered(cats, ["feature"], [F.desc("n"), F.asc_nulls_last("value")], "freq_rank")
    return nump, cats.withColumn("freq_rank", F.col("freq_rank").cast("int"))


# --------------------------------------------------------------------------- over runs

def average_runs(reports: DataFrame) -> DataFrame:
    """(metric, value) averaged over runs, NaN/null ignored."""
    v = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    return reports.groupBy("metric").agg(F.avg(v).alias("value"))


def report_runs(reports: DataFrame, digits: int = 3) -> DataFrame:
    """error = (1 - score) * 100 per run; mean and sample std, rounded."""
    err = (1.0 - F.col("value").cast("double")) * 100.0
    return reports.groupBy("metric").agg(
        F.round(F.avg(err), digits).alias("error_mean"),
        F.round(F.stddev_samp(err), digits).alias("error_std"),
    )


def seed_summary(reports: DataFrame) -> DataFrame:
    """Per (split, metric): count, mean, population std over seeds."""
    return reports.groupBy("split", "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
    )
