"""Registered queries: model-based comparison (Spark ML, isolation forest).

Learners are randomised/iterative, so most entries have no SQL oracle
(rows-only check); label encoding and the feature transform are exact SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fidspark.operators import iforest, models, prep, stats
from fidspark.plans import compare, fixtures as fx
from fidspark.plans.catalog import register
from fidspark.plans.sqltext import clean_label_sql
from fidspark.plans.stats_queries import NUM

FEAT = fx.cte("feat")
MCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _imputed_pair(spark, d):
    r, s = fx.pair(spark, d)
    cols = MCOLS + [fx.FEAT_LABEL]
    return stats.impute_median(r.select(cols), s.select(cols), MCOLS)


@register("encode_labels", FEAT + f""", lab AS (SELECT side, {clean_label_sql('l_returnflag')} AS v FROM feat),
dic AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS y FROM (SELECT DISTINCT v FROM lab WHERE v IS NOT NULL))
SELECT lab.side, lab.v AS l_returnflag, dic.y FROM lab LEFT JOIN dic ON lab.v = dic.v""", ["y"], ops=("M4",))
def q_encode_labels(spark, d):
    v = fx.view(spark, d, "feat").select("side", "l_returnflag")
    v = v.withColumn("l_returnflag", F.when(F.col("l_returnflag") == "?", None).otherwise(F.col("l_returnflag")))
    r, s, _ = models.encode_labels(v.where("side = 'real'"), v.where("side = 'synthetic'"), "l_returnflag")
    return r.unionByName(s).select("side", "l_returnflag", "y")


@register("ml_features", """WITH st AS (SELECT min(o_totalprice) AS mn1, max(o_totalprice) AS mx1,
  min(CAST(o_custkey % 100 AS DOUBLE)) AS mn2, max(CAST(o_custkey % 100 AS DOUBLE)) AS mx2 FROM orders)
SELECT o_orderkey, CASE WHEN mn1 >= 0 AND mx1 >= 1000 THEN ln(greatest(o_totalprice, 0.01))
  ELSE (o_totalprice - mn1) / (mx1 - mn1) * 5.0 END AS o_totalprice,
  CASE WHEN mn2 >= 0 AND mx2 >= 1000 THEN ln(greatest(CAST(o_custkey % 100 AS DOUBLE), 0.01))
  ELSE (CAST(o_custkey % 100 AS DOUBLE) - mn2) / (mx2 - mn2) * 5.0 END AS small FROM orders, st""",
          ["o_totalprice", "small"], ops=("M8",))
def q_ml_features(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 100).cast("double").alias("small"))
    return models.ml_features(o, o, ["o_totalprice", "small"])


@register("propensity_pmse", ops=("M1", "U1", "W4"))
def q_pmse(spark, d):
    r, s = _imputed_pair(spark, d)
    _, m = models.propensity(r, s, MCOLS, folds=5, seed=42)
    return m


@register("detection_score", ops=("M2",))
def q_detection(spark, d):
    r, s = _imputed_pair(spark, d)
    return models.detection_score(r, s, MCOLS, folds=3, seed=42)


@register("tstr", ops=("M3", "W7", "M10", "M11"))
def q_tstr(spark, d):
    r, s = _imputed_pair(spark, d)
    return models.tstr(r, s, MCOLS, fx.FEAT_LABEL)


@register("utility_gap", ops=("M5", "X3"))
def q_utility(spark, d):
    r, s = _imputed_pair(spark, d)
    return models.utility_gap(r, [s], MCOLS, fx.FEAT_LABEL)


@register("regression_utility", ops=("M6",))
def q_regression_utility(spark, d):
    r, s = _imputed_pair(spark, d)
    return models.utility_gap(r, [s], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", task="regression")


@register("ml_efficiency", ops=("M7", "M8", "M9"))
def q_ml_efficiency(spark, d):
    v = fx.view(spark, d, "near").select("p_partkey", "side", "p_size", "p_retailprice", "p_type", "p_brand")
    v = v.withColumn("label", (F.col("p_size") > 25).cast("int"))
    r, s = v.where("side = 'real'"), v.where("side = 'synthetic'")
    return models.ml_efficiency(s, r, ["p_size", "p_retailprice"], "label", ["p_type"])


@register("propensity_metrics", fx.cte("scored") + """, c AS (SELECT avg(label) AS c FROM scored),
m AS (SELECT avg((score - c) ** 2) AS pmse,
  -avg(label * ln(score + 1e-12) + (1 - label) * ln(1 - score + 1e-12)) AS domain_classifier_logloss FROM scored, c),
a AS (SELECT (sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2.0) / (p * (n - p)) AS domain_classifier_auroc FROM (
  SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
    CAST(count(*) FILTER (WHERE label = 1) OVER () AS DOUBLE) AS p, CAST(count(*) OVER () AS DOUBLE) AS n FROM scored) GROUP BY p, n)
SELECT pmse, domain_classifier_auroc, domain_classifier_logloss FROM m, a""",
          ["pmse", "domain_classifier_auroc", "domain_classifier_logloss"], ops=("M1",))
def q_propensity_metrics(spark, d):
    v = fx.view(spark, d, "scored").select(F.col("label").cast("double").alias("y"), F.col("score").alias("p"))
    return models.propensity_metrics(v)


@register("fold_copies", """WITH t AS (SELECT CAST(l_returnflag AS VARCHAR) AS l_returnflag,
  CASE WHEN l_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
g AS (SELECT y, count(*) AS n FROM t GROUP BY y)
SELECT y, f AS fold, CAST((n + 4 - f) // 5 AS DOUBLE) AS w FROM g, range(0, 5) r(f)""", ["y", "w"], ops=("W4", "M1"))
def q_fold_copies(spark, d):
    v = fx.table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_orderkey") % 2 == 0, 1.0).otherwise(0.0).alias("y"))
    return prep.fold_copies(v, ["l_returnflag"], "y", 5).groupBy("y", F.col("fold").cast("long").alias("fold")).agg(F.sum("w").alias("w"))


@register("ml_features_one_hot", """WITH c AS (SELECT list(v ORDER BY v) AS cats FROM (SELECT DISTINCT CAST(p_type AS VARCHAR) AS v
  FROM part WHERE p_partkey % 2 = 1))
SELECT p_partkey, CAST(coalesce(list_position(cats, CAST(p_type AS VARCHAR)), 0) AS INTEGER) AS position, len(cats) AS width FROM part, c""",
          ops=("M8",))
def q_ml_one_hot(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_type", F.col("p_size").cast("double").alias("p_size"))
    x = models.ml_features(p, p.where("p_partkey % 2 = 1"), ["p_size"], ["p_type"])
    return x.select("p_partkey", F.array_position("p_type_oh", 1.0).cast("int").alias("position"),
                    F.size("p_type_oh").cast("long").alias("width"))


@register("iforest_outlier_gap", ops=("M15", "F3"))
def q_iforest(spark, d):
    r, s = _imputed_pair(spark, d)
    return iforest.outlier_gap(r.select(MCOLS), s.select(MCOLS), MCOLS, n_trees=300, seed=42)


@register("outlier_utility", ops=("M16", "T2", "M12"))
def q_outlier_utility(spark, d):
    r, s = fx.pair(spark, d, "near")
    return iforest.outlier_utility(r.select("p_partkey", "p_size", "p_retailprice"),
                                   s.select("p_partkey", "p_size", "p_retailprice"),
                                   ["p_size", "p_retailprice"], "p_partkey", n_trees=300, seed=42)


FULL = ["p_size", "p_retailprice"]


@register("compare_full", ops=("A11", "F5"))
def q_compare_full(spark, d):
    r, s = fx.pair(spark, d, "near")
    return compare.compare_full(r, s, "p_type", FULL, "p_partkey")


NEAR_SIDES = """WITH near AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(p_type AS VARCHAR) AS t FROM part),
r AS (SELECT * FROM near WHERE p_partkey % 2 = 0), s AS (SELECT *, CAST(p_partkey // 2 % 2 AS INTEGER) AS run_id FROM near WHERE p_partkey % 2 = 1)
"""


@register("compare_runs_neighbours", NEAR_SIDES + """, z AS (SELECT avg(p_size) AS ma, stddev_pop(p_size) AS sa, avg(p_retailprice) AS mb,
  stddev_pop(p_retailprice) AS sb FROM r),
d AS (SELECT s.run_id, s.p_partkey, min(sqrt(((s.p_size - r.p_size) / sa) ** 2 + ((s.p_retailprice - r.p_retailprice) / sb) ** 2)) AS x
  FROM s, r, z GROUP BY ALL)
SELECT run_id, u.metric, u.value FROM (SELECT run_id, avg(x) AS nn_distance_mean, median(x) AS nn_distance_median,
  quantile_cont(x, 0.95) AS nn_distance_p95, avg(CASE WHEN x < 1e-6 THEN 1.0 ELSE 0.0 END) AS nn_near_duplicate_rate FROM d GROUP BY run_id) q,
  LATERAL (SELECT unnest(['nn_distance_mean', 'nn_distance_median', 'nn_distance_p95', 'nn_near_duplicate_rate']) AS metric,
           unnest([nn_distance_mean, nn_distance_median, nn_distance_p95, nn_near_duplicate_rate]) AS value) u""", ["value"], ops=("A11", "U7", "A25", "A26"))
def q_compare_runs(spark, d):
    r, s = fx.pair(spark, d, "near")
    runs = [s.where(F.floor(F.col("p_partkey") / 2) % 2 == i) for i in range(2)]
    return compare.compare_runs(r, runs, "p_type", FULL, "p_partkey", metrics=["neighbours"])


@register("compare_runs", ops=("A11", "U7", "F5"))
def q_compare_all_runs(spark, d):
    r, s = fx.pair(spark, d, "near")
    runs = [s.where(F.floor(F.col("p_partkey") / 2) % 2 == i) for i in range(2)]
    return compare.compare_runs(r, runs, "p_type", FULL, "p_partkey")


@register("class_distribution_sorted", NEAR_SIDES + """, a AS (SELECT t, count(*) / (SELECT count(*) FROM r) AS p FROM r GROUP BY t),
b AS (SELECT t, count(*) / (SELECT count(*) FROM s) AS p FROM s GROUP BY t)
SELECT t AS class, coalesce(a.p, 0) AS real_prop, coalesce(b.p, 0) AS synthetic_prop FROM a FULL JOIN b USING (t) ORDER BY class""",
          ["real_prop", "synthetic_prop"], ops=("T1", "A1"))
def q_sorted(spark, d):
    r, s = fx.pair(spark, d, "near")
    return stats.class_distribution(r, s, "p_type").orderBy("class").select(F.col("class").cast("string").alias("class"), "real_prop", "synthetic_prop")
