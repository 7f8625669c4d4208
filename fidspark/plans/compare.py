"""The compare plan: real vs synthetic summary (A11), as the reference's main report.

scan -> align (P2) -> split label (P4) -> numeric coercion (P5) -> median
imputation (A8) -> one shared value-count/CDF table for every per-feature
metric -> one-row roll-up.  :func:`compare_full` adds the model-based and
nearest-neighbour families, :func:`compare_runs` several synthetic tables.
"""

from __future__ import annotations

from functools import partial
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidspark.operators import assoc, iforest, models, nn, prep, stats
from fidspark.session import ensure_parallel, one_row
from fidspark.sources import io


def combine_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Put several one-row aggregates side by side without a join.

    Each row is unpivoted to (metric, value); the union (a few rows) is pivoted
    back by one global aggregate, so the plan has no cartesian product.
    """
    names = [c for p in parts for c in p.columns]
    longs = [p.select(*[F.col(c).cast("double").alias(c) for c in p.columns]).unpivot([], p.columns, "metric", "value")
             for p in parts]
    u = longs[0]
    for x in longs[1:]:
        u = u.unionByName(x)
    return u.groupBy().agg(*[F.max(F.when(F.col("metric") == c, F.col("value"))).alias(c) for c in names])


def compare_summary(
    r: DataFrame, s: DataFrame, label: str | int | None = None, num: Sequence[str] | None = None,
    expected: Sequence[int] | None = None, spearman: bool = True,
) -> DataFrame:
    """One row of the metrics that SQL can express (13 with Spearman)."""
    r, s = prep.align(r, s)
    lab = prep.resolve_label(r, label)
    feats = list(num) if num is not None else [c for c in r.columns if c != lab]
    rx, sx = prep.to_numeric(r.select(feats)), prep.to_numeric(s.select(feats))
    rx, sx = stats.impute_median(rx, sx, feats)
    nc = stats.NumericComparison(rx, sx, feats).persist()

    cls = stats.class_distribution(r, s, lab, expected).agg(
        F.avg("abs_prop_diff").alias("class_abs_prop_diff_mean"), F.max("abs_prop_diff").alias("class_abs_prop_diff_max"))
    tail = nc.tail_quantiles().agg(F.avg(
        (F.col("abs_diff_q01") + F.col("abs_diff_q05") + F.col("abs_diff_q95") + F.col("abs_diff_q99")) / 4.0
    ).alias("tail_abs_diff_mean"))
    iqr = nc.iqr_outlier_rate().agg(F.avg("abs_rate_diff").alias("univariate_outlier_rate_gap_mean"),
                                    F.max("abs_rate_diff").alias("univariate_outlier_rate_gap_max"))
    ks = nc.ks().agg(F.avg("ks_statistic").alias("ks_stat_mean"), F.max("ks_statistic").alias("ks_stat_max"),
                     F.avg(F.coalesce(F.col("p_value") < 0.05, F.lit(False)).cast("double")).alias("ks_sig_feature_rate"))
    rng = nc.range_violations().agg(F.avg("below_min_rate").alias("range_violation_rate_below_min"),
                                    F.avg("above_max_rate").alias("range_violation_rate_above_max"))
    binv = nc.binary_violations().agg(
        F.coalesce(F.avg("invalid_rate"), F.lit(0.0)).alias("binary_constraint_violation_rate"))
    parts = [cls, tail, iqr, ks, rng, binv]
    if spearman:
        parts.insert(3, assoc.spearman_diff(rx, sx, feats))
    out = one_row(combine_rows(parts))
    nc.unpersist()
    return out


def _tables(r, s, num, label, key, expected, seed):
    return compare_summary(r.select(*num, label), s.select(*num, label), label, num, expected)


def _forest(r, s, num, label, key, expected, seed):
    return iforest.outlier_gap(r, s, num, seed=seed, key=key)


def _neighbours(r, s, num, label, key, expected, seed):
    return nn.nn_distance(r, s, num, key, key)[1]


def _propensity(r, s, num, label, key, expected, seed):
    scored, metrics = models.propensity(r, s, num, seed=seed)
    metrics = one_row(metrics)
    scored.unpersist()
    return metrics


def _tstr(r, s, num, label, key, expected, seed):
    return models.tstr(r, s, num, label)


def _outliers(r, s, num, label, key, expected, seed):
    return iforest.outlier_utility(r, s, num, key, seed=seed)


# families of metrics by name; all see the sides after the imputation of numbers
FAMILIES = {"tables": _tables, "iforest": _forest, "neighbours": _neighbours, "propensity": _propensity, "tstr": _tstr,
            "outliers": _outliers}


def compare_full(r: DataFrame, s: DataFrame, label: str, num: Sequence[str], key: str, expected: Sequence[int] | None = None,
                 metrics: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """One row of the named families' metrics (default: all of ``FAMILIES``, 34 metrics).

    ``key``: a whole-number row key, distinct within each side. Numbers are
    coerced and imputed with the real medians first.
    """
    return _reports(r, [s], label, num, key, expected, metrics, seed)[0]


def _reports(r: DataFrame, runs: Sequence[DataFrame], label: str, num: Sequence[str], key: str, expected: Sequence[int] | None = None,
             metrics: Sequence[str] | None = None, seed: int = 42, parallel: int = 6) -> list[DataFrame]:
    """The report of each run; the imputed sides are held during the call, the families of all runs work side by side on them."""
    wanted = list(FAMILIES) if metrics is None else list(metrics)
    unknown = set(wanted) - set(FAMILIES)
    if unknown:
        raise ValueError(f"no metrics named {sorted(unknown)}; there are {sorted(FAMILIES)}")
    tables = [prep.to_numeric(d.select(key, label, *num), num) for d in (r, *runs)]
    medians = stats.real_medians(tables[0], num)
    real, *synthetic = [ensure_parallel(stats.fill_numbers(d, medians)).persist(StorageLevel.MEMORY_AND_DISK) for d in tables]

    def row(name: str, s: DataFrame) -> DataFrame:
        return one_row(FAMILIES[name](real, s, num, label, key, expected, seed))

    try:
        rows = models.side_by_side([partial(row, name, s) for s in synthetic for name in wanted], parallel)
    finally:
        for d in (real, *synthetic):
            d.unpersist()
    return [combine_rows(rows[i * len(wanted):(i + 1) * len(wanted)]) for i in range(len(runs))]


def compare_runs(r: DataFrame, runs: Sequence[DataFrame], label: str, num: Sequence[str], key: str, **kw) -> DataFrame:
    """(run_id, metric, value) of every synthetic run; :func:`fidspark.operators.stats.average_runs` averages them."""
    reports = _reports(r, runs, label, num, key, **kw)
    return prep.stack_runs([p.unpivot([], p.columns, "metric", "value") for p in reports])


def write_reports(reports: DataFrame, folder: str) -> None:
    """The metrics per run and their averages as CSV with header under ``folder``."""
    io.write_report({"per_run_summary_metrics": reports.orderBy("run_id", "metric"),
                     "summary_metrics": stats.average_runs(reports).orderBy("metric")}, folder)
