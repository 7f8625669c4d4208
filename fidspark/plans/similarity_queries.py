"""Registered queries: correlations, associations and frequency similarity over ``feat``."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from fidspark.operators import assoc, freq, stats
from fidspark.plans import fixtures as fx
from fidspark.plans.catalog import register
from fidspark.plans.sqltext import long_sql
from fidspark.plans.stats_queries import FEAT, NUM, imputed_sql, ks_sql, wd_sql

A_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
A_CAT = ["l_returnflag", "l_linestatus"]
T_NUM = ["l_quantity", "l_discount", "l_tax"]
T_CAT = ["l_returnflag"]


def _imputed(spark, d):
    r, s = fx.pair(spark, d)
    cols = NUM + [fx.FEAT_LABEL]
    return stats.impute_median(r.select(cols), s.select(cols), NUM)


# ----------------------------------------------------------------- Spearman

def _rank_sql(view: str, cols) -> str:
    rk = ", ".join(
        f"rank() OVER (PARTITION BY side ORDER BY {c}) + (count(*) OVER (PARTITION BY side, {c}) - 1) / 2.0 AS {c}"
        for c in cols)
    return f"SELECT side, {rk} FROM {view}"


def spearman_pairs_sql(view: str = "rk", cols=NUM) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) FILTER (WHERE side = 'real') AS real_corr, "
        f"corr({a}, {b}) FILTER (WHERE side = 'synthetic') AS synthetic_corr FROM {view}"
        for a, b in combinations(cols, 2))


SPEAR_CTE = FEAT + f", imp AS ({imputed_sql('feat', NUM)}), rk AS ({_rank_sql('imp', NUM)})\n"


@register("spearman_pairs", SPEAR_CTE + f"SELECT *, abs(real_corr - synthetic_corr) AS abs_diff FROM ({spearman_pairs_sql()})",
          ["real_corr", "synthetic_corr", "abs_diff"], ops=("A7", "W2", "J6"))
def q_spearman_pairs(spark, d):
    ri, si = _imputed(spark, d)
    return assoc.spearman_diff_pairs(ri, si, NUM)


@register("spearman_diff", SPEAR_CTE + f"""SELECT coalesce(avg(abs(real_corr - synthetic_corr)), 0.0)
  AS mean_abs_spearman_corr_diff FROM ({spearman_pairs_sql()})""", ["mean_abs_spearman_corr_diff"], ops=("A7",))
def q_spearman(spark, d):
    ri, si = _imputed(spark, d)
    return assoc.spearman_diff(ri, si, NUM)


# ----------------------------------------------------------------- associations

def assoc_side_sql(view: str) -> str:
    """Upper-triangle association rows (side, feature_a, feature_b, assoc) for ``view``."""
    parts = [
        f"SELECT side, '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS assoc FROM {view} GROUP BY side"
        for a, b in combinations(A_NUM, 2)]
    for c in A_CAT:
        for x in A_NUM:
            parts.append(f"""SELECT g.side, '{c}' AS feature_a, '{x}' AS feature_b,
  CASE WHEN sum(n_g * pow(g_x - m_x, 2)) = 0 THEN 0.0 ELSE sqrt(sum(n_g * pow(g_x - m_x, 2)) / any_value(v_x * n)) END AS assoc
FROM (SELECT side, CAST({c} AS VARCHAR) AS cv, count({x}) AS n_g, avg({x}) AS g_x FROM {view} GROUP BY side, cv) g
JOIN (SELECT side, avg({x}) AS m_x, var_pop({x}) AS v_x, count({x}) AS n FROM {view} GROUP BY side) t ON g.side = t.side
GROUP BY g.side""")
    for a, b in combinations(A_CAT, 2):
        parts.append(f"""SELECT side, '{a}' AS feature_a, '{b}' AS feature_b,
  CASE WHEN least(kc - 1, rc - 1) = 0 THEN 0.0
       ELSE sqrt(greatest(0.0, (o2e - n) / n - (k - 1) * (r - 1) / (n - 1)) / least(kc - 1, rc - 1)) END AS assoc
FROM (SELECT side, r, k, n, o2e, r - pow(r - 1, 2) / (n - 1) AS rc, k - pow(k - 1, 2) / (n - 1) AS kc FROM (
  SELECT side, CAST(count(DISTINCT va) AS DOUBLE) AS r, CAST(count(DISTINCT vb) AS DOUBLE) AS k,
         CAST(any_value(n) AS DOUBLE) AS n, sum(o * o / (ra * cb / n)) AS o2e FROM (
    SELECT *, sum(o) OVER (PARTITION BY side, va) AS ra, sum(o) OVER (PARTITION BY side, vb) AS cb,
           sum(o) OVER (PARTITION BY side) AS n
    FROM (SELECT side, CAST({a} AS VARCHAR) AS va, CAST({b} AS VARCHAR) AS vb, count(*) AS o FROM {view}
          WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)) GROUP BY side))""")
    return "\nUNION ALL ".join(parts)


ASSOC_PAIRS_SQL = f"""SELECT feature_a, feature_b, real_assoc, synthetic_assoc, abs(real_assoc - synthetic_assoc) AS abs_diff
FROM (SELECT feature_a, feature_b, max(assoc) FILTER (WHERE side = 'real') AS real_assoc,
             max(assoc) FILTER (WHERE side = 'synthetic') AS synthetic_assoc
      FROM ({assoc_side_sql('feat')}) GROUP BY feature_a, feature_b)"""


@register("associations", FEAT + ASSOC_PAIRS_SQL, ["real_assoc", "synthetic_assoc", "abs_diff"],
          ops=("A17", "J6"))
def q_assoc(spark, d):
    r, s = fx.pair(spark, d)
    return assoc.association_diff(r, s, A_NUM, A_CAT)


@register("association_distance", FEAT + f"SELECT sqrt(2.0 * sum(pow(abs_diff, 2))) AS association_distance FROM ({ASSOC_PAIRS_SQL})",
          ["association_distance"], ops=("A18",))
def q_assoc_dist(spark, d):
    r, s = fx.pair(spark, d)
    return assoc.association_distance(r, s, A_NUM, A_CAT)


# ----------------------------------------------------------------- frequency

def cat_prob_sql(view: str, cats) -> str:
    lng = "\nUNION ALL ".join(
        f"SELECT side, '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM {view}" for c in cats)
    return f"""SELECT feature, value, n_r, n_s, n_r / sum(n_r) OVER (PARTITION BY feature) AS p_r,
    n_s / sum(n_s) OVER (PARTITION BY feature) AS p_s
  FROM (SELECT feature, value, count(*) FILTER (WHERE side = 'real') AS n_r,
               count(*) FILTER (WHERE side = 'synthetic') AS n_s
        FROM ({lng}) WHERE value IS NOT NULL GROUP BY feature, value)"""


def jsd_sql(view: str, cats) -> str:
    kl = "CASE WHEN {p} > 0 THEN {p} * log2({p} / ((p_r + p_s) / 2)) ELSE 0.0 END"
    return (f"SELECT feature, sqrt(greatest(0.0, 0.5 * sum({kl.format(p='p_r')}) + 0.5 * sum({kl.format(p='p_s')}))) AS jsd "
            f"FROM ({cat_prob_sql(view, cats)}) GROUP BY feature")


@register("js_distance", FEAT + jsd_sql("feat", A_CAT), ["jsd"], ops=("A15", "J1", "U4"))
def q_jsd(spark, d):
    r, s = fx.pair(spark, d)
    return freq.js_distance(r, s, A_CAT)


SHAPES_SQL = (f"SELECT feature, 'KSComplement' AS metric, 1.0 - ks_statistic AS score FROM ({ks_sql()})\n"
              f"UNION ALL SELECT feature, 'TVComplement' AS metric, 1.0 - 0.5 * sum(abs(p_r - p_s)) AS score "
              f"FROM ({cat_prob_sql('feat', A_CAT)}) GROUP BY feature")
LONG = f"long AS ({long_sql('feat', NUM)})\n"


@register("column_shapes", FEAT + "," + LONG + SHAPES_SQL, ["score"], ops=("A20",))
def q_shapes(spark, d):
    r, s = fx.pair(spark, d)
    return freq.column_shapes(r, s, NUM, A_CAT)


@register("shape_score", FEAT + "," + LONG + f"SELECT avg(score) AS shape FROM ({SHAPES_SQL})", ["shape"], ops=("A20",))
def q_shape_score(spark, d):
    r, s = fx.pair(spark, d)
    return freq.shape_score(freq.column_shapes(r, s, NUM, A_CAT))


@register("shape_score_target_only", FEAT + "," + LONG + f"SELECT min(score) AS shape FROM ({SHAPES_SQL})",
          ["shape"], ops=("A23",))
def q_shape_min(spark, d):
    r, s = fx.pair(spark, d)
    return freq.shape_score(freq.column_shapes(r, s, NUM, A_CAT), target_only=True)


def _binned_sql(view: str, num, cat, bins: int) -> str:
    sel = []
    for c in num:
        w = f"(CASE WHEN mx_{c} > mn_{c} THEN (mx_{c} - mn_{c}) / {float(bins)} ELSE 1.0 END)"
        sel.append(f"CAST(CAST(least(greatest(floor((CAST({c} AS DOUBLE) - mn_{c}) / {w}), 0), {bins - 1}) AS BIGINT) "
                   f"AS VARCHAR) AS {c}")
    sel += [f"CAST({c} AS VARCHAR) AS {c}" for c in cat]
    mm = ", ".join(f"min(CAST({c} AS DOUBLE)) AS mn_{c}, max(CAST({c} AS DOUBLE)) AS mx_{c}" for c in num)
    return f"SELECT side, {', '.join(sel)} FROM {view}, (SELECT {mm} FROM {view} WHERE side = 'real') e"


def trends_sql(view: str, num, cat, bins: int = 10) -> str:
    parts = [f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, 'CorrelationSimilarity' AS metric,
  1.0 - abs(corr({a}, {b}) FILTER (WHERE side = 'real') - corr({a}, {b}) FILTER (WHERE side = 'synthetic')) / 2.0 AS score
  FROM {view}""" for a, b in combinations(num, 2)]
    cols = list(num) + list(cat)
    for a, b in combinations(cols, 2):
        if a in num and b in num:
            continue
        parts.append(f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, 'ContingencySimilarity' AS metric,
  1.0 - 0.5 * sum(abs(coalesce(p_r, 0) - coalesce(p_s, 0))) AS score FROM (
  SELECT n_r / sum(n_r) OVER () AS p_r, n_s / sum(n_s) OVER () AS p_s FROM (
    SELECT {a}, {b}, count(*) FILTER (WHERE side = 'real') AS n_r, count(*) FILTER (WHERE side = 'synthetic') AS n_s
    FROM bn GROUP BY {a}, {b}))""")
    return f"WITH bn AS ({_binned_sql(view, num, cat, bins)})\n" + "\nUNION ALL ".join(parts)


@register("column_pair_trends", FEAT + f"SELECT * FROM ({trends_sql('feat', T_NUM, T_CAT)})", ["score"], ops=("A21",))
def q_trends(spark, d):
    r, s = fx.pair(spark, d)
    return freq.column_pair_trends(r, s, T_NUM, T_CAT)


@register("quality_score", FEAT + "," + LONG + f"""SELECT shape, trend, (shape + trend) / 2.0 AS overall FROM
  (SELECT avg(score) AS shape FROM ({SHAPES_SQL})), (SELECT avg(score) AS trend FROM ({trends_sql('feat', T_NUM, T_CAT)}))""",
          ["shape", "trend", "overall"], ops=("A20", "A21"))
def q_quality(spark, d):
    r, s = fx.pair(spark, d)
    return freq.quality_score(freq.column_shapes(r, s, NUM, A_CAT), freq.column_pair_trends(r, s, T_NUM, T_CAT))


def coverage_sql(view: str, num, cat) -> str:
    parts = [f"""SELECT '{c}' AS feature, 'RangeCoverage' AS metric,
  greatest(0.0, 1.0 - (greatest(0.0, (smn - rmn) / (rmx - rmn)) + greatest(0.0, (rmx - smx) / (rmx - rmn)))) AS score
  FROM (SELECT min(CAST({c} AS DOUBLE)) FILTER (WHERE side = 'real') AS rmn, max(CAST({c} AS DOUBLE)) FILTER (WHERE side = 'real') AS rmx,
               min(CAST({c} AS DOUBLE)) FILTER (WHERE side = 'synthetic') AS smn,
               max(CAST({c} AS DOUBLE)) FILTER (WHERE side = 'synthetic') AS smx FROM {view})""" for c in num]
    parts.append(f"""SELECT feature, 'CategoryCoverage' AS metric, avg(CASE WHEN n_s > 0 THEN 1.0 ELSE 0.0 END) AS score
  FROM ({cat_prob_sql(view, cat)}) WHERE n_r > 0 GROUP BY feature""")
    return "\nUNION ALL ".join(parts)


@register("coverage", FEAT + coverage_sql("feat", NUM, A_CAT), ["score"], ops=("A22",))
def q_coverage(spark, d):
    r, s = fx.pair(spark, d)
    return freq.coverage(r, s, NUM, A_CAT)


def density_sql(view: str, num, bins: int = 20) -> str:
    lng = "\nUNION ALL ".join(f"SELECT side, '{c}' AS feature, {c} AS bin FROM bn" for c in num)
    return f"""WITH bn AS ({_binned_sql(view, num, [], bins)})
SELECT feature, CAST(bin AS INTEGER) AS bin, n_r / sum(n_r) OVER (PARTITION BY feature) AS real_density,
       n_s / sum(n_s) OVER (PARTITION BY feature) AS synthetic_density
FROM (SELECT feature, bin, count(*) FILTER (WHERE side = 'real') AS n_r, count(*) FILTER (WHERE side = 'synthetic') AS n_s
      FROM ({lng}) WHERE bin IS NOT NULL GROUP BY feature, bin)"""


@register("density_table", FEAT + f"SELECT * FROM ({density_sql('feat', NUM)})", ["real_density", "synthetic_density"],
          ops=("A24",))
def q_density(spark, d):
    r, s = fx.pair(spark, d)
    return freq.density_table(r, s, NUM)


@register("stat_similarity", FEAT + "," + LONG + f"""SELECT
  (SELECT avg(wd) FROM ({wd_sql()})) AS avg_wd,
  (SELECT avg(jsd) FROM ({jsd_sql('feat', A_CAT)})) AS avg_jsd,
  (SELECT sqrt(2.0 * sum(pow(abs_diff, 2))) FROM ({ASSOC_PAIRS_SQL})) AS association_distance""",
          ["avg_wd", "avg_jsd", "association_distance"], ops=("A19",))
def q_stat_sim(spark, d):
    r, s = fx.pair(spark, d)
    wd = freq.NumericComparison(r, s, NUM).wasserstein().agg(F.avg("wd").alias("avg_wd"))
    jsd = freq.js_distance(r, s, A_CAT).agg(F.avg("jsd").alias("avg_jsd"))
    ad = assoc.association_distance(r, s, A_NUM, A_CAT)
    k = F.lit(1)
    return wd.withColumn("_k", k).join(jsd.withColumn("_k", k), "_k").join(ad.withColumn("_k", k), "_k").drop("_k")
