"""Frequency-based similarity.

Categorical frequencies come from one ``groupBy(feature, value)`` over a long
form of all categorical columns with both sides counted in the same pass
(conditional counts), which is the full outer join J1 without a join.
"""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidspark.operators import assoc
from fidspark.operators.stats import NumericComparison


def category_counts(r: DataFrame, s: DataFrame, cats: Sequence[str]) -> DataFrame:
    """(feature, value, n_r, n_s, p_r, p_s) over the union of categories, nulls excluded."""
    def lng(df: DataFrame, side: int) -> DataFrame:
        d = df.select(*[F.col(c).cast("string").alias(c) for c in cats])
        return d.unpivot([], list(cats), "feature", "value").withColumn("_side", F.lit(side))

    c = lng(r, 0).unionByName(lng(s, 1)).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count_if(F.col("_side") == 0).alias("n_r"), F.count_if(F.col("_side") == 1).alias("n_s"))
    w = Window.partitionBy("feature")  # one row per category: report-size partitions
    return c.select("*", F.try_divide(F.col("n_r"), F.sum("n_r").over(w)).alias("p_r"),
                    F.try_divide(F.col("n_s"), F.sum("n_s").over(w)).alias("p_s"))


def js_distance(r: DataFrame, s: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Jensen-Shannon distance, base 2, per categorical column (union of categories)."""
    c = category_counts(r, s, cats)
    m = (F.col("p_r") + F.col("p_s")) / 2

    def kl(p):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    return c.groupBy("feature").agg(
        F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(kl(F.col("p_r"))) + 0.5 * F.sum(kl(F.col("p_s"))))).alias("jsd"))


def tv_complement(r: DataFrame, s: DataFrame, cats: Sequence[str]) -> DataFrame:
    """(feature, score): 1 - 0.5 * sum |p - q| over the category union."""
    c = category_counts(r, s, cats)
    return c.groupBy("feature").agg(
        (1.0 - 0.5 * F.sum(F.abs(F.coalesce("p_r", F.lit(0.0)) - F.coalesce("p_s", F.lit(0.0))))).alias("score"))


def column_shapes(r: DataFrame, s: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """(feature, metric, score): KS complement for numeric, TV complement for categorical."""
    parts = []
    if num:
        ks = NumericComparison(r, s, num).ks()
        parts.append(ks.select("feature", F.lit("KSComplement").alias("metric"),
                               (1.0 - F.col("ks_statistic")).alias("score")))
    if cat:
        parts.append(tv_complement(r, s, cat).select("feature", F.lit("TVComplement").alias("metric"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shape_score(shapes: DataFrame, target_only: bool = False) -> DataFrame:
    """Mean of the column scores (min when only the target was synthesised)."""
    agg = F.min("score") if target_only else F.avg("score")
    return shapes.agg(agg.alias("shape"))


def _binned(df: DataFrame, num: Sequence[str], edges: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """Numeric columns -> bin index 0..bins-1 of equal-width bins over the real range (clipped)."""
    out = []
    for c in df.columns:
        if c in num:
            lo, hi = edges[c]
            width = (hi - lo) / bins if hi > lo else 1.0
            b = F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit(width))
            out.append(F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("string").alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return df.select(*out)


def real_ranges(r: DataFrame, num: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = r.agg(*[F.min(F.col(c).cast("double")).alias(f"mn_{c}") for c in num],
                *[F.max(F.col(c).cast("double")).alias(f"mx_{c}") for c in num]).first()  # one row
    return {c: (row[f"mn_{c}"], row[f"mx_{c}"]) for c in num}


def column_pair_trends(r: DataFrame, s: DataFrame, num: Sequence[str], cat: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature_a, feature_b, metric, score).

    numeric pair: 1 - |rho_r - rho_s| / 2 (Pearson).  Other pairs: contingency
    similarity 1 - 0.5 * sum |p_r(a,b) - p_s(a,b)| with numeric columns cut
    into ``bins`` equal-width bins of the real range.
    """
    parts = []
    if len(num) >= 2:
        rc = assoc.pairwise_corr(r, num).withColumnRenamed("corr", "cr")
        sc = assoc.pairwise_corr(s, num).withColumnRenamed("corr", "cs")
        parts.append(rc.join(sc, ["feature_a", "feature_b"]).select(
            "feature_a", "feature_b", F.lit("CorrelationSimilarity").alias("metric"),
            (1.0 - F.abs(F.col("cr") - F.col("cs")) / 2.0).alias("score")))
    cols = list(num) + list(cat)
    mixed = [(a, b) for a, b in combinations(cols, 2) if not (a in num and b in num)]
    if mixed:
        edges = real_ranges(r, num) if num else {}
        rb, sb = _binned(r.select(cols), num, edges, bins), _binned(s.select(cols), num, edges, bins)

        def pairs_long(df: DataFrame, side: int) -> DataFrame:
            return df.select(F.explode(F.array(*[
                F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                         F.col(a).alias("va"), F.col(b).alias("vb")) for a, b in mixed])).alias("_p")
            ).select("_p.*").withColumn("_side", F.lit(side))

        key = ["feature_a", "feature_b"]
        ct = pairs_long(rb, 0).unionByName(pairs_long(sb, 1)).groupBy(*key, "va", "vb").agg(
            F.count_if(F.col("_side") == 0).alias("n_r"), F.count_if(F.col("_side") == 1).alias("n_s"))
        w = Window.partitionBy(*key)
        ct = ct.select("*", F.try_divide(F.col("n_r"), F.sum("n_r").over(w)).alias("p_r"),
                       F.try_divide(F.col("n_s"), F.sum("n_s").over(w)).alias("p_s"))
        parts.append(ct.groupBy(*key).agg(
            F.lit("ContingencySimilarity").alias("metric"),
            (1.0 - 0.5 * F.sum(F.abs(F.col("p_r") - F.col("p_s")))).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_score(shapes: DataFrame, trends: DataFrame) -> DataFrame:
    """One row of the mean column score, the mean pair score and their mean; scores that are null do not count."""
    trend = trends.agg(F.avg("score").alias("trend")).withColumn("_k", F.lit(1))
    return shape_score(shapes).withColumn("_k", F.lit(1)).join(trend, "_k").select(
        "shape", "trend", ((F.col("shape") + F.col("trend")) / 2.0).alias("overall"))


def coverage(r: DataFrame, s: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """(feature, metric, score).

    RangeCoverage: max(0, 1 - (max(0,(s_min-r_min)/w) + max(0,(r_max-s_max)/w))), w = r_max - r_min.
    CategoryCoverage: share of real categories that the synthetic side contains.
    """
    parts = []
    if num:
        def mm(df, tag):
            return df.agg(*[F.min(F.col(c).cast("double")).alias(f"{tag}mn_{c}") for c in num],
                          *[F.max(F.col(c).cast("double")).alias(f"{tag}mx_{c}") for c in num]).withColumn("_k", F.lit(1))
        j = mm(r, "r").join(mm(s, "s"), "_k")  # two one-row aggregates
        rows = []
        for c in num:
            w = F.col(f"rmx_{c}") - F.col(f"rmn_{c}")
            lo = F.greatest(F.lit(0.0), F.try_divide(F.col(f"smn_{c}") - F.col(f"rmn_{c}"), w))
            hi = F.greatest(F.lit(0.0), F.try_divide(F.col(f"rmx_{c}") - F.col(f"smx_{c}"), w))
            rows.append(F.struct(F.lit(c).alias("feature"), F.lit("RangeCoverage").alias("metric"),
                                 F.greatest(F.lit(0.0), 1.0 - (lo + hi)).alias("score")))
        parts.append(j.select(F.explode(F.array(*rows)).alias("_x")).select("_x.*"))
    if cat:
        c = category_counts(r, s, cat)
        parts.append(c.where(F.col("n_r") > 0).groupBy("feature").agg(
            F.lit("CategoryCoverage").alias("metric"), F.avg((F.col("n_s") > 0).cast("double")).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def density_table(r: DataFrame, s: DataFrame, num: Sequence[str], bins: int = 20) -> DataFrame:
    """(feature, bin, real_density, synthetic_density): shared equal-width bins of the real range."""
    edges = real_ranges(r, num)
    rb, sb = _binned(r.select(num), num, edges, bins), _binned(s.select(num), num, edges, bins)
    lr = rb.unpivot([], list(num), "feature", "bin").withColumn("_side", F.lit(0))
    ls = sb.unpivot([], list(num), "feature", "bin").withColumn("_side", F.lit(1))
    c = lr.unionByName(ls).where(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(
        F.count_if(F.col("_side") == 0).alias("n_r"), F.count_if(F.col("_side") == 1).alias("n_s"))
    w = Window.partitionBy("feature")
    return c.select("feature", F.col("bin").cast("int").alias("bin"),
                    F.try_divide(F.col("n_r"), F.sum("n_r").over(w)).alias("real_density"),
                    F.try_divide(F.col("n_s"), F.sum("n_s").over(w)).alias("synthetic_density"))


def stat_similarity(r: DataFrame, s: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """One row [avg WD (min-max scaled), avg JSD, association distance]."""
    wd = NumericComparison(r, s, num).wasserstein().agg(F.avg("wd").alias("avg_wd"))
    jsd = js_distance(r, s, cat).agg(F.avg("jsd").alias("avg_jsd"))
    ad = assoc.association_distance(r, s, num, cat)
    k = F.lit(1)
    return wd.withColumn("_k", k).join(jsd.withColumn("_k", k), "_k").join(ad.withColumn("_k", k), "_k").drop("_k")
