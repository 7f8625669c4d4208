"""Registered queries: metrics from labels and scores over ``scored`` (whole orders table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidspark.operators import scores
from fidspark.plans import fixtures as fx
from fidspark.plans.catalog import register

SC = fx.cte("scored")


def per_class_sql(view: str, y: str, p: str) -> str:
    return f"""(SELECT cls, support, tp, predicted,
    coalesce(tp / nullif(predicted, 0), 0.0) AS prec, coalesce(tp / nullif(support, 0), 0.0) AS rec,
    CASE WHEN coalesce(tp / nullif(predicted, 0), 0.0) + coalesce(tp / nullif(support, 0), 0.0) > 0
         THEN 2 * coalesce(tp / nullif(predicted, 0), 0.0) * coalesce(tp / nullif(support, 0), 0.0)
              / (coalesce(tp / nullif(predicted, 0), 0.0) + coalesce(tp / nullif(support, 0), 0.0)) ELSE 0.0 END AS f1
  FROM (SELECT coalesce(yc.cls, pc.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
               coalesce(predicted, 0) AS predicted
        FROM (SELECT y AS cls, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM c GROUP BY y) yc
        FULL JOIN (SELECT p AS cls, sum(n) AS predicted FROM c GROUP BY p) pc ON yc.cls = pc.cls))"""


def report_sql(view: str, y: str, p: str, positive: str | None) -> str:
    pos = ""
    if positive is not None:
        pos = (f", (SELECT prec FROM pcl WHERE cls = '{positive}') AS precision_pos, "
               f"(SELECT rec FROM pcl WHERE cls = '{positive}') AS recall_pos, "
               f"(SELECT f1 FROM pcl WHERE cls = '{positive}') AS f1_pos")
    return f""", c AS (SELECT CAST({y} AS VARCHAR) AS y, CAST({p} AS VARCHAR) AS p, count(*) AS n FROM {view} GROUP BY ALL),
pcl AS {per_class_sql(view, y, p)}
SELECT (SELECT sum(tp) / sum(support) FROM pcl WHERE support > 0) AS accuracy,
       (SELECT avg(f1) FROM pcl) AS f1_macro,
       (SELECT sum(f1 * support) / sum(support) FROM pcl WHERE support > 0) AS f1_weighted,
       (SELECT sum(tp) / sum(support) FROM pcl WHERE support > 0) AS f1_micro{pos}"""


REP_COLS = ["accuracy", "f1_macro", "f1_weighted", "f1_micro"]


@register("classification_report_binary", SC + report_sql("scored", "label", "prediction", "1"),
          REP_COLS + ["precision_pos", "recall_pos", "f1_pos"], ops=("M10",))
def q_report_bin(spark, d):
    return scores.classification_report(fx.view(spark, d, "scored"), "label", "prediction", positive="1")


@register("classification_report_multiclass", SC + report_sql("scored", "mlabel", "mpred", None), REP_COLS, ops=("M10",))
def q_report_multi(spark, d):
    return scores.classification_report(fx.view(spark, d, "scored"), "mlabel", "mpred")


@register("inverse_weighted_f1", SC + f""", c AS (SELECT CAST(mlabel AS VARCHAR) AS y, CAST(mpred AS VARCHAR) AS p, count(*) AS n
  FROM scored GROUP BY ALL), pcl AS {per_class_sql('scored', 'mlabel', 'mpred')}
SELECT sum(f1 * (1 - share)) / (any_value(k) - 1) AS inverse_weighted_f1 FROM (
  SELECT f1, support / sum(support) OVER () AS share, count(*) OVER () AS k FROM pcl WHERE support > 0)""",
          ["inverse_weighted_f1"], ops=("M9",))
def q_iwf1(spark, d):
    return scores.inverse_weighted_f1(fx.view(spark, d, "scored"), "mlabel", "mpred")


AUC_SQL = SC + """SELECT (sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2.0) / (p * (n - p)) AS auroc FROM (
  SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
         CAST(count(*) FILTER (WHERE label = 1) OVER () AS DOUBLE) AS p, CAST(count(*) OVER () AS DOUBLE) AS n
  FROM scored) GROUP BY p, n"""


@register("auroc", AUC_SQL, ["auroc"], ops=("M11", "W2"))
def q_auroc(spark, d):
    return scores.auroc(fx.view(spark, d, "scored"), "label", "score")


@register("average_precision", SC + """SELECT sum(npos * cum_pos / cum_n) / sum(npos) AS average_precision FROM (
  SELECT npos, sum(npos) OVER w AS cum_pos, sum(n) OVER w AS cum_n FROM (
    SELECT score, count(*) AS n, count(*) FILTER (WHERE label = 1) AS npos FROM scored GROUP BY score)
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
          ["average_precision"], ops=("M12", "W1"))
def q_ap(spark, d):
    return scores.average_precision(fx.view(spark, d, "scored"), "label", "score")


@register("regression_report", SC + """SELECT sqrt(avg(pow(o_totalprice - pred_price, 2))) AS rmse,
  avg(abs(o_totalprice - pred_price)) AS mae,
  avg(abs(o_totalprice - pred_price) / greatest(abs(o_totalprice), 2.220446049250313e-16)) AS mape,
  1 - avg(pow(o_totalprice - pred_price, 2)) / var_pop(o_totalprice) AS r2,
  1 - var_pop(o_totalprice - pred_price) / var_pop(o_totalprice) AS explained_variance FROM scored""",
          ["rmse", "mae", "mape", "r2", "explained_variance"], digits=4, ops=("M13", "M6"))
def q_regression(spark, d):
    return scores.regression_report(fx.view(spark, d, "scored"), "o_totalprice", "pred_price")


@register("scores_to_labels", SC + """SELECT o_orderkey, CAST(round(1.0 / (1.0 + exp(-((score - 0.5) * 10.0)))) AS INTEGER) AS y_sig,
  CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS y_arg FROM (
  SELECT o_orderkey, score, [score, 1.0 - score, 0.5] AS l FROM scored)""", ops=("M14",))
def q_scores_to_labels(spark, d):
    v = fx.view(spark, d, "scored").select("o_orderkey", "score", ((F.col("score") - 0.5) * 10.0).alias("logit"),
                                           F.array(F.col("score"), 1.0 - F.col("score"), F.lit(0.5)).alias("l"))
    return v.select("o_orderkey", scores.sigmoid_labels("logit").alias("y_sig"), scores.softmax_argmax("l").alias("y_arg"))


@register("top_k_flag", SC + """SELECT o_orderkey, score, CASE WHEN score >= (SELECT score FROM scored ORDER BY score DESC
  LIMIT 1 OFFSET 749) THEN 1 ELSE 0 END AS flag FROM scored""", ["score"], ops=("T2", "M16"))
def q_topk(spark, d):
    return scores.top_k_flag(fx.view(spark, d, "scored").select("o_orderkey", "score"), "score", 750)


GRID_SQL = SC + """, grid AS (SELECT mlabel AS criterion, CAST(o_orderkey % 7 AS INTEGER) AS param, avg(score) AS score
  FROM scored GROUP BY ALL)
"""


def _grid(spark, d):
    v = fx.view(spark, d, "scored")
    return v.groupBy(F.col("mlabel").alias("criterion"), (F.col("o_orderkey") % 7).cast("int").alias("param")).agg(
        F.avg("score").alias("score"))


@register("best_by", GRID_SQL + "SELECT criterion, arg_max(param, score) AS best_param, max(score) AS best_score "
          "FROM grid GROUP BY criterion", ["best_score"], ops=("T4",))
def q_best_by(spark, d):
    return scores.best_by(_grid(spark, d), "criterion", "param", "score")


@register("signed_score", SC + f"""SELECT task, CASE WHEN task = 'regression' THEN -rmse ELSE accuracy END AS signed_score FROM (
  SELECT 'regression' AS task, CAST(NULL AS DOUBLE) AS accuracy, sqrt(avg(pow(o_totalprice - pred_price, 2))) AS rmse FROM scored
  UNION ALL SELECT 'binclass', avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), CAST(NULL AS DOUBLE) FROM scored)""",
          ["signed_score"], digits=4, ops=("M17",))
def q_signed(spark, d):
    v = fx.view(spark, d, "scored")
    reg = v.agg(F.lit("regression").alias("task"), F.lit(None).cast("double").alias("accuracy"),
                F.sqrt(F.avg(F.pow(F.col("o_totalprice") - F.col("pred_price"), 2))).alias("rmse"))
    cls = v.agg(F.lit("binclass").alias("task"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
                F.lit(None).cast("double").alias("rmse"))
    return scores.signed_score(reg.unionByName(cls)).select("task", "signed_score")
