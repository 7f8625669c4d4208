"""Registered queries: descriptive comparison over the ``feat`` fixture (whole lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidspark.operators import stats
from fidspark.plans import fixtures as fx
from fidspark.plans.catalog import register
from fidspark.plans.sqltext import clean_label_sql, kolmogorov_sf_sql, long_sql

NUM = fx.FEAT_NUM
FEAT = fx.cte("feat")
LONG = f"long AS ({long_sql('feat', NUM)})\n"


def _q(p: float) -> str:
    return f"q{int(round(p * 100)):02d}"


# ----------------------------------------------------------------- SQL bodies (use a CTE named `long`)

def tail_sql(long: str = "long") -> str:
    sel = ", ".join(
        f"quantile_cont(value, {p}) FILTER (WHERE side = 'real') AS real_{_q(p)}, "
        f"quantile_cont(value, {p}) FILTER (WHERE side = 'synthetic') AS synthetic_{_q(p)}"
        for p in stats.TAIL_PROBS
    )
    diffs = ", ".join(f"abs(real_{_q(p)} - synthetic_{_q(p)}) AS abs_diff_{_q(p)}" for p in stats.TAIL_PROBS)
    return f"SELECT *, {diffs} FROM (SELECT feature, {sel} FROM {long} GROUP BY feature)"


def iqr_sql(long: str = "long") -> str:
    inside = "coalesce(value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1), false)"
    return f"""SELECT feature, real_outlier_rate, synthetic_outlier_rate,
  abs(real_outlier_rate - synthetic_outlier_rate) AS abs_rate_diff FROM (
  SELECT l.feature,
    avg(CASE WHEN {inside} THEN 0.0 ELSE 1.0 END) FILTER (WHERE side = 'real') AS real_outlier_rate,
    avg(CASE WHEN {inside} THEN 0.0 ELSE 1.0 END) FILTER (WHERE side = 'synthetic') AS synthetic_outlier_rate
  FROM {long} l JOIN (
    SELECT feature, quantile_cont(value, 0.25) FILTER (WHERE side = 'real') AS q1,
           quantile_cont(value, 0.75) FILTER (WHERE side = 'real') AS q3
    FROM {long} GROUP BY feature) f ON l.feature = f.feature
  GROUP BY l.feature)"""


def cdf_sql(long: str = "long") -> str:
    """Two-sided running counts per distinct value (W1), plus next value."""
    return f"""SELECT feature, value,
    CAST(sum(n_r) OVER w AS DOUBLE) AS c_r, CAST(sum(n_s) OVER w AS DOUBLE) AS c_s,
    CAST(sum(n_r) OVER (PARTITION BY feature) AS DOUBLE) AS t_r,
    CAST(sum(n_s) OVER (PARTITION BY feature) AS DOUBLE) AS t_s,
    lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt
  FROM (SELECT feature, value, count(*) FILTER (WHERE side = 'real') AS n_r,
               count(*) FILTER (WHERE side = 'synthetic') AS n_s
        FROM {long} WHERE value IS NOT NULL GROUP BY feature, value)
  WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def ks_sql(long: str = "long") -> str:
    lam = "sqrt(n_r * n_s / (n_r + n_s)) * ks_statistic"
    return f"""SELECT feature, ks_statistic, {kolmogorov_sf_sql(lam)} AS p_value FROM (
  SELECT feature, max(abs(c_r / t_r - c_s / t_s)) AS ks_statistic, any_value(t_r) AS n_r, any_value(t_s) AS n_s
  FROM ({cdf_sql(long)}) GROUP BY feature)"""


def wd_sql(long: str = "long") -> str:
    return f"""SELECT c.feature, coalesce(sum(abs(c_r / t_r - c_s / t_s) * (nxt - value)
    / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END), 0.0) AS wd
  FROM ({cdf_sql(long)}) c JOIN (
    SELECT feature, min(value) AS lo, max(value) AS hi FROM {long} WHERE side = 'real' GROUP BY feature
  ) m ON c.feature = m.feature GROUP BY c.feature"""


def range_sql(long: str = "long") -> str:
    return f"""SELECT l.feature, avg(CASE WHEN value < mn THEN 1.0 ELSE 0.0 END) AS below_min_rate,
    avg(CASE WHEN value > mx THEN 1.0 ELSE 0.0 END) AS above_max_rate
  FROM {long} l JOIN (SELECT feature, min(value) AS mn, max(value) AS mx FROM {long}
                      WHERE side = 'real' GROUP BY feature) m ON l.feature = m.feature
  WHERE side = 'synthetic' GROUP BY l.feature"""


def binary_sql(long: str = "long") -> str:
    return f"""SELECT l.feature, avg(CASE WHEN coalesce(value IN (0.0, 1.0), false) THEN 0.0 ELSE 1.0 END) AS invalid_rate
  FROM {long} l JOIN (SELECT feature FROM {long} WHERE side = 'real' AND value IS NOT NULL GROUP BY feature
                      HAVING bool_and(value IN (0.0, 1.0))) b ON l.feature = b.feature
  WHERE side = 'synthetic' GROUP BY l.feature"""


def class_sql(view: str, label: str) -> str:
    return f"""SELECT CAST(cls AS VARCHAR) AS class, real_count, synthetic_count,
    real_count / greatest(sum(real_count) OVER (), 1) AS real_prop,
    synthetic_count / greatest(sum(synthetic_count) OVER (), 1) AS synthetic_prop,
    abs(real_count / greatest(sum(real_count) OVER (), 1)
        - synthetic_count / greatest(sum(synthetic_count) OVER (), 1)) AS abs_prop_diff
  FROM (SELECT cls, count(*) FILTER (WHERE side = 'real') AS real_count,
               count(*) FILTER (WHERE side = 'synthetic') AS synthetic_count
        FROM (SELECT side, {clean_label_sql(label)} AS cls FROM {view}) WHERE cls IS NOT NULL GROUP BY cls)"""


def imputed_sql(view: str, cols) -> str:
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in cols)
    fills = ", ".join(f"coalesce(CAST(f.{c} AS DOUBLE), m.{c}, 0.0) AS {c}" for c in cols)
    return (f"SELECT f.side, {fills}, f.l_linestatus FROM {view} f, "
            f"(SELECT {meds} FROM {view} WHERE side = 'real') m")


TAIL_FLOATS = [f"{k}_{_q(p)}" for p in stats.TAIL_PROBS for k in ("real", "synthetic")] + [
    f"abs_diff_{_q(p)}" for p in stats.TAIL_PROBS]
CLASS_FLOATS = ["real_prop", "synthetic_prop", "abs_prop_diff"]


# ----------------------------------------------------------------- queries

@register("class_distribution", FEAT + "SELECT * FROM (" + class_sql("feat", "l_linestatus") + ")",
          CLASS_FLOATS, ops=("A1", "S5", "U3", "W5", "J1", "T1"))
def q_class_distribution(spark, d):
    r, s = fx.pair(spark, d)
    return stats.class_distribution(r, s, fx.FEAT_LABEL)


@register("class_distribution_fixed", FEAT + f"""
SELECT CAST(e.cls AS VARCHAR) AS class, coalesce(real_count, 0) AS real_count,
  coalesce(synthetic_count, 0) AS synthetic_count,
  coalesce(real_count, 0) / greatest(sum(coalesce(real_count, 0)) OVER (), 1) AS real_prop,
  coalesce(synthetic_count, 0) / greatest(sum(coalesce(synthetic_count, 0)) OVER (), 1) AS synthetic_prop,
  abs(coalesce(real_count, 0) / greatest(sum(coalesce(real_count, 0)) OVER (), 1)
      - coalesce(synthetic_count, 0) / greatest(sum(coalesce(synthetic_count, 0)) OVER (), 1)) AS abs_prop_diff
FROM (SELECT CAST(unnest([0, 1]) AS BIGINT) AS cls) e LEFT JOIN (
  SELECT cls, count(*) FILTER (WHERE side = 'real') AS real_count,
         count(*) FILTER (WHERE side = 'synthetic') AS synthetic_count
  FROM (SELECT side, CAST(trunc(TRY_CAST({clean_label_sql('is_big')} AS DOUBLE)) AS BIGINT) AS cls FROM feat)
  WHERE cls IS NOT NULL GROUP BY cls) c ON e.cls = c.cls""", CLASS_FLOATS, ops=("A1",))
def q_class_distribution_fixed(spark, d):
    r, s = fx.pair(spark, d)
    return stats.class_distribution(r, s, "is_big", expected=(0, 1))


@register("class_counts_fixed_range", """
SELECT c.class, CAST(coalesce(g.n, 0) AS BIGINT) AS count
FROM (SELECT CAST(unnest(range(0, 9)) AS BIGINT) AS class) c LEFT JOIN (
  SELECT CAST(trunc(TRY_CAST(l_linenumber AS DOUBLE)) AS BIGINT) AS class, count(*) AS n
  FROM lineitem GROUP BY 1) g ON c.class = g.class""", ops=("A2",))
def q_class_counts(spark, d):
    return stats.class_counts(fx.table(spark, d, "lineitem"), "l_linenumber", range(0, 9))


@register("tail_quantiles", FEAT + "," + LONG + tail_sql(), TAIL_FLOATS, ops=("A3",))
def q_tail_quantiles(spark, d):
    r, s = fx.pair(spark, d)
    return stats.tail_quantiles(r, s, NUM)


@register("iqr_outlier_rate", FEAT + "," + LONG + iqr_sql(),
          ["real_outlier_rate", "synthetic_outlier_rate", "abs_rate_diff"], ops=("A4",))
def q_iqr(spark, d):
    r, s = fx.pair(spark, d)
    return stats.iqr_outlier_rate(r, s, NUM)


@register("ks_two_sample", FEAT + "," + LONG + ks_sql(), ["ks_statistic", "p_value"], ops=("A5", "W1"))
def q_ks(spark, d):
    r, s = fx.pair(spark, d)
    return stats.ks_two_sample(r, s, NUM, exact_rows=0)


@register("ks_exact", """WITH t AS (SELECT s_suppkey % 2 AS side, s_acctbal AS v FROM supplier), k AS (
  SELECT count(*) FILTER (side = 0) AS m, count(*) FILTER (side = 1) AS n FROM t),
c AS (SELECT v, sum(count(*) FILTER (side = 0)) OVER (ORDER BY v) AS a, sum(count(*) FILTER (side = 1)) OVER (ORDER BY v) AS b FROM t GROUP BY v),
ks AS (SELECT m, n, max(abs(CAST(a * n - b * m AS BIGINT))) AS d FROM c, k GROUP BY m, n),
rows_ AS (SELECT m, n, d, i, list_transform(range(0, n + 1), lambda j: CASE WHEN abs(i * n - j * m) >= d THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS off
  FROM ks, range(0, m + 1) AS g(i)),
paths AS (WITH RECURSIVE p AS (
  SELECT 0::BIGINT AS i, m, list_reduce(list_prepend([0.0::DOUBLE], list_transform(range(1, n + 1), lambda j: [off[j + 1]])),
    lambda acc, x: list_append(acc, CASE WHEN x[1] > 0 THEN 1.0 ELSE acc[-1] END)) AS met FROM rows_ WHERE i = 0
  UNION ALL
  SELECT r.i, r.m, list_reduce(list_prepend([CASE WHEN r.off[1] > 0 THEN 1.0 ELSE p.met[1] END], list_transform(range(1, r.n + 1), lambda j: [CAST(j AS DOUBLE), r.off[j + 1], p.met[j + 1]])),
    lambda acc, x: list_append(acc, CASE WHEN x[2] > 0 THEN 1.0 ELSE (x[3] * r.i + acc[-1] * x[1]) / (r.i + x[1]) END))
  FROM p JOIN rows_ r ON r.i = p.i + 1) SELECT met[-1] AS p_value FROM p WHERE i = m)
SELECT 's_acctbal' AS feature, d / CAST(m * n AS DOUBLE) AS ks_statistic, p_value FROM ks, paths""", ["ks_statistic", "p_value"], ops=("A5",))
def q_ks_exact(spark, d):
    s = fx.table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    even = F.col("s_suppkey") % 2 == 0
    return stats.ks_two_sample(s.where(even), s.where(~even), ["s_acctbal"])


@register("wasserstein_1d", FEAT + "," + LONG + wd_sql(), ["wd"], ops=("A16", "W1", "W3", "E2"))
def q_wd(spark, d):
    r, s = fx.pair(spark, d)
    return stats.wasserstein_1d(r, s, NUM)


@register("range_violations", FEAT + "," + LONG + range_sql(), ["below_min_rate", "above_max_rate"], ops=("A9", "J2"))
def q_range(spark, d):
    r, s = fx.pair(spark, d)
    return stats.range_violations(r, s, NUM)


@register("binary_violations", FEAT + "," + LONG + binary_sql(), ["invalid_rate"], ops=("A10", "U6"))
def q_binary(spark, d):
    r, s = fx.pair(spark, d)
    return stats.binary_violations(r, s, NUM)


@register("impute_median", FEAT + imputed_sql("feat", NUM), NUM, ops=("A8", "P5"))
def q_impute(spark, d):
    r, s = fx.pair(spark, d)
    cols = NUM + [fx.FEAT_LABEL]
    ri, si = stats.impute_median(r.select(cols), s.select(cols), NUM)
    return ri.select(F.lit("real").alias("side"), *cols).unionByName(
        si.select(F.lit("synthetic").alias("side"), *cols))
