"""Registered queries: preparation, set operations, splits, profiles, run roll-ups, the summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidspark.functions import hash_uniform, null_markers, portable_hash_sql
from fidspark.operators import prep, stats
from fidspark.plans import compare
from fidspark.plans import fixtures as fx
from fidspark.plans.catalog import register
from fidspark.plans.sqltext import long_sql
from fidspark.plans.similarity_queries import SPEAR_CTE, spearman_pairs_sql
from fidspark.plans.stats_queries import FEAT, NUM, binary_sql, class_sql, iqr_sql, ks_sql, range_sql, tail_sql

H = portable_hash_sql


# ----------------------------------------------------------------- flagship summary

SUMMARY_SQL = SPEAR_CTE + f""", long AS ({long_sql('imp', NUM)})
SELECT
 (SELECT avg(abs_prop_diff) FROM ({class_sql('feat', 'l_linestatus')})) AS class_abs_prop_diff_mean,
 (SELECT max(abs_prop_diff) FROM ({class_sql('feat', 'l_linestatus')})) AS class_abs_prop_diff_max,
 (SELECT avg((abs_diff_q01 + abs_diff_q05 + abs_diff_q95 + abs_diff_q99) / 4.0) FROM ({tail_sql()})) AS tail_abs_diff_mean,
 (SELECT avg(abs_rate_diff) FROM ({iqr_sql()})) AS univariate_outlier_rate_gap_mean,
 (SELECT max(abs_rate_diff) FROM ({iqr_sql()})) AS univariate_outlier_rate_gap_max,
 (SELECT coalesce(avg(abs(real_corr - synthetic_corr)), 0.0) FROM ({spearman_pairs_sql()})) AS mean_abs_spearman_corr_diff,
 (SELECT avg(ks_statistic) FROM ({ks_sql()})) AS ks_stat_mean,
 (SELECT max(ks_statistic) FROM ({ks_sql()})) AS ks_stat_max,
 (SELECT avg(CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0.0 END) FROM ({ks_sql()})) AS ks_sig_feature_rate,
 (SELECT avg(below_min_rate) FROM ({range_sql()})) AS range_violation_rate_below_min,
 (SELECT avg(above_max_rate) FROM ({range_sql()})) AS range_violation_rate_above_max,
 (SELECT coalesce(avg(invalid_rate), 0.0) FROM ({binary_sql()})) AS binary_constraint_violation_rate"""

SUMMARY_COLS = ["class_abs_prop_diff_mean", "class_abs_prop_diff_max", "tail_abs_diff_mean",
                "univariate_outlier_rate_gap_mean", "univariate_outlier_rate_gap_max", "mean_abs_spearman_corr_diff",
                "ks_stat_mean", "ks_stat_max", "ks_sig_feature_rate", "range_violation_rate_below_min",
                "range_violation_rate_above_max", "binary_constraint_violation_rate"]


@register("compare_summary", SUMMARY_SQL, SUMMARY_COLS, ops=("A11", "A6", "P2", "P3", "P4", "P5", "A8"))
def q_summary(spark, d):
    r, s = fx.pair(spark, d)
    cols = NUM + [fx.FEAT_LABEL]
    return compare.compare_summary(r.select(cols), s.select(cols), label="L_LINESTATUS ", num=NUM)


# ----------------------------------------------------------------- columns and cleaning

MARKED = ("CASE WHEN trim(CAST(l_returnflag AS VARCHAR)) IN ('?', '', '') THEN NULL ELSE l_returnflag END")


@register("to_numeric", FEAT + "SELECT side, TRY_CAST(l_quantity AS DOUBLE) AS l_quantity, "
          "TRY_CAST(l_returnflag AS DOUBLE) AS l_returnflag, TRY_CAST(is_big AS DOUBLE) AS is_big FROM feat",
          ["l_quantity", "l_returnflag", "is_big"], ops=("P5",))
def q_to_numeric(spark, d):
    v = fx.view(spark, d, "feat").select("side", "l_quantity", "l_returnflag", "is_big")
    return prep.to_numeric(v, ["l_quantity", "l_returnflag", "is_big"])


@register("drop_incomplete", FEAT + f"""SELECT * FROM (SELECT side, l_quantity, l_tax, {MARKED} AS l_returnflag,
  l_linestatus FROM feat) WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL AND l_returnflag IS NOT NULL
  AND l_linestatus IS NOT NULL""", ["l_quantity", "l_tax"], ops=("P6", "P8"))
def q_drop_incomplete(spark, d):
    v = fx.view(spark, d, "feat").select("side", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")
    return prep.drop_incomplete(prep.null_marker_columns(v, ["l_returnflag"]))


@register("missing_policy", FEAT + f"""SELECT side, l_tax, coalesce(CAST({MARKED} AS VARCHAR), 'empty') AS l_returnflag,
  l_linestatus FROM feat WHERE l_linestatus IS NOT NULL AND l_tax IS NOT NULL""", ["l_tax"], ops=("P7", "P9"))
def q_missing_policy(spark, d):
    v = fx.view(spark, d, "feat").select("side", "l_tax", "l_returnflag", "l_linestatus")
    v = prep.null_marker_columns(v, ["l_returnflag"])
    return prep.apply_missing_policy(v, ["l_tax"], ["l_returnflag"], "l_linestatus")


@register("cap_rows", f"SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {H('o_orderkey', 42)}, o_orderkey LIMIT 1000",
          ops=("P10", "T5"))
def q_cap_rows(spark, d):
    return prep.cap_rows(fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 1000, "o_orderkey", 42)


@register("sample_pct", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {H('o_orderkey', 7)} / 1099511627776e0 < 0.15",
          ["o_totalprice"], ops=("P11",))
def q_sample_pct(spark, d):
    return prep.sample_pct(fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 15, "o_orderkey", 7)


@register("binarize_label", """SELECT l_orderkey, l_linenumber,
  CASE WHEN TRY_CAST(l_linenumber AS DOUBLE) = 1.0 THEN 0 ELSE 1 END AS y,
  CASE WHEN trim(CAST(l_returnflag AS VARCHAR)) = 'N' THEN 0 ELSE 1 END AS y_flag FROM lineitem""", ops=("P13", "P14", "F1"))
def q_binarize(spark, d):
    li = fx.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", prep.binarize("l_linenumber", 1).alias("y"),
                     prep.binarize("l_returnflag", "N").alias("y_flag"))


ONEHOT = ["is_view", "is_click", "is_signup", "is_error", "is_purchase"]


@register("argmax_columns", fx.cte("ev") + f"""SELECT event_id, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS event_idx
  FROM (SELECT event_id, [{', '.join(f'CAST({c} AS DOUBLE)' for c in ONEHOT)}] AS l FROM ev)""", ops=("P15", "E22"))
def q_argmax(spark, d):
    v = fx.view(spark, d, "ev").select("event_id", *ONEHOT)
    return prep.argmax_columns(v, ONEHOT, "event_idx")


@register("clip_to_reference", FEAT + """SELECT least(greatest(l_quantity, mn), mx) AS l_quantity, l_discount
  FROM feat, (SELECT min(l_quantity) AS mn, max(l_quantity) AS mx FROM feat WHERE side = 'real') m
  WHERE side = 'synthetic'""", ["l_quantity", "l_discount"], ops=("P22", "J2"))
def q_clip(spark, d):
    r, s = fx.pair(spark, d)
    return prep.clip_to_reference(s.select("l_quantity", "l_discount"), r, ["l_quantity"])


@register("snap_to_reference", fx.cte("near") + """, rv AS (SELECT DISTINCT p_size * 1.5 AS v FROM near WHERE side = 'real'),
sv AS (SELECT p_partkey, p_retailprice / 40.0 AS v FROM near WHERE side = 'synthetic')
SELECT p_partkey, v AS value, CASE WHEN hi IS NULL THEN lo WHEN lo IS NULL THEN hi WHEN v - lo <= hi - v THEN lo ELSE hi END AS snapped
FROM (SELECT p_partkey, v, (SELECT max(rv.v) FROM rv WHERE rv.v <= sv.v) AS lo,
             (SELECT min(rv.v) FROM rv WHERE rv.v >= sv.v) AS hi FROM sv)""", ["value", "snapped"], ops=("P23",))
def q_snap(spark, d):
    r, s = fx.pair(spark, d, "near")
    r = r.select((F.col("p_size") * 1.5).alias("x"))
    s = s.select("p_partkey", (F.col("p_retailprice") / 40.0).alias("x"))
    return prep.snap_to_reference(s, r, "x", "p_partkey")


@register("normalize_space", "SELECT p_partkey, concat(' ', trim(CAST(p_type AS VARCHAR))) AS p_type FROM part", ops=("P25",))
def q_norm_space(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", prep.normalize_space("p_type").alias("p_type"))


TEXT_COLS = ["l_quantity", "l_returnflag", "l_linestatus"]
TEXT_SQL = ("SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 11 = 0 THEN "
            "concat('l_quantity ', CAST(l_quantity AS VARCHAR), ', l_returnflag is ', l_returnflag) ELSE "
            "concat('l_quantity is ', CAST(l_quantity AS VARCHAR), ', l_returnflag is ', l_returnflag, "
            "', l_linestatus is ', l_linestatus) END AS text FROM lineitem")


def _text_view(spark, d):
    li = fx.table(spark, d, "lineitem")
    good = prep.row_to_text(li, TEXT_COLS).select("l_orderkey", "l_partkey", "text", "l_quantity", "l_returnflag")
    bad = F.concat(F.lit("l_quantity "), F.col("l_quantity").cast("string"), F.lit(", l_returnflag is "), F.col("l_returnflag"))
    return good.select("l_orderkey", "l_partkey",
                       F.when(F.col("l_partkey") % 11 == 0, bad).otherwise(F.col("text")).alias("text"))


@register("row_to_text", "SELECT l_orderkey, concat_ws(', ', concat('l_quantity is ', CAST(l_quantity AS VARCHAR)), "
          "concat('l_returnflag is ', l_returnflag), concat('l_linestatus is ', l_linestatus)) AS text FROM lineitem",
          ops=("P26",))
def q_row_to_text(spark, d):
    return prep.row_to_text(fx.table(spark, d, "lineitem"), TEXT_COLS).select("l_orderkey", "text")


def _parse_sql(src: str) -> str:
    good = ("list_filter(list_transform(string_split(text, ','), lambda p: string_split(trim(p), ' is ')), "
            "lambda kv: len(kv) = 2)")
    cols = ", ".join(
        f"CASE WHEN len(list_filter(g, lambda kv: trim(kv[1]) = '{c}')) > 0 "
        f"THEN trim(list_filter(g, lambda kv: trim(kv[1]) = '{c}')[1][2]) END AS {c}" for c in TEXT_COLS)
    return f"SELECT l_orderkey, l_partkey, text, {cols} FROM (SELECT *, {good} AS g FROM ({src}))"


@register("text_to_row", _parse_sql(TEXT_SQL), ops=("P27",))
def q_text_to_row(spark, d):
    return prep.text_to_row(_text_view(spark, d), "text", TEXT_COLS)


@register("valid_rows", f"SELECT * FROM ({_parse_sql(TEXT_SQL)}) WHERE TRY_CAST(l_quantity AS DOUBLE) IS NOT NULL "
          "AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL", ops=("P28",))
def q_valid_rows(spark, d):
    return prep.valid_rows(prep.text_to_row(_text_view(spark, d), "text", TEXT_COLS), ["l_quantity"])


@register("handle_nan_rows", FEAT + """SELECT side, CASE WHEN l_tax IS NULL OR isnan(l_tax) THEN 0.0 ELSE l_quantity END AS l_quantity,
  CASE WHEN l_tax IS NULL OR isnan(l_tax) THEN 0.0 ELSE l_tax END AS l_tax FROM feat""", ["l_quantity", "l_tax"],
          ops=("P30",))
def q_nan_rows(spark, d):
    v = fx.view(spark, d, "feat").select("side", "l_quantity", "l_tax")
    return prep.handle_nan_rows(v, ["l_quantity", "l_tax"], keep=True)


@register("integer_columns", FEAT + """SELECT coalesce(bool_and(l_quantity % 1 = 0), true) AS l_quantity,
  coalesce(bool_and(l_discount % 1 = 0), true) AS l_discount, coalesce(bool_and(CAST(is_big AS DOUBLE) % 1 = 0), true) AS is_big
  FROM feat""", ops=("P17",))
def q_int_cols(spark, d):
    return stats.integer_columns(fx.view(spark, d, "feat"), ["l_quantity", "l_discount", "is_big"])


@register("category_sizes", """SELECT feature, count(DISTINCT value) AS n_categories FROM (
  SELECT 'p_type' AS feature, CAST(p_type AS VARCHAR) AS value FROM part UNION ALL
  SELECT 'p_brand', CAST(p_brand AS VARCHAR) FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part)
  WHERE value IS NOT NULL GROUP BY feature""", ops=("E23",))
def q_cat_sizes(spark, d):
    return stats.category_sizes(fx.table(spark, d, "part"), ["p_type", "p_brand", "p_size"])


@register("profile_numeric", FEAT + f"""SELECT feature, min(value) AS min, max(value) AS max,
  coalesce(bool_and(value % 1 = 0), true) AS is_int, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_null
  FROM ({long_sql('feat', NUM, keep=())}) GROUP BY feature""", ["min", "max"], ops=("E16",))
def q_profile(spark, d):
    nump, _ = stats.profile(fx.view(spark, d, "feat"), NUM, ["l_returnflag"])
    return nump


@register("profile_categories", FEAT + """SELECT feature, value, n,
  row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC NULLS LAST) AS freq_rank FROM (
  SELECT 'l_returnflag' AS feature, CAST(l_returnflag AS VARCHAR) AS value, count(*) AS n FROM feat GROUP BY 2)""",
          ops=("E16", "W6"))
def q_profile_cats(spark, d):
    _, cats = stats.profile(fx.view(spark, d, "feat"), NUM, ["l_returnflag"])
    return cats.withColumn("freq_rank", F.col("freq_rank").cast("long"))


# ----------------------------------------------------------------- set operations

@register("missing_categories", FEAT + """SELECT feature, value FROM (
  SELECT DISTINCT 'l_returnflag' AS feature, CAST(l_returnflag AS VARCHAR) AS value FROM feat WHERE side = 'synthetic')
  EXCEPT SELECT 'l_returnflag', CAST(l_returnflag AS VARCHAR) FROM feat WHERE side = 'real'""", ops=("U4", "U3"))
def q_missing_cats(spark, d):
    r, s = fx.pair(spark, d)
    return prep.missing_categories(s, r, ["l_returnflag"])


@register("drop_all_duplicates", """SELECT l_suppkey, l_quantity, l_discount, l_returnflag FROM lineitem
  GROUP BY ALL HAVING count(*) = 1""", ["l_quantity", "l_discount"], ops=("A28", "U5"))
def q_dedup(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    return prep.drop_all_duplicates(li)


@register("stack_sources", FEAT + """SELECT is_real, count(*) AS n, sum(l_quantity) AS sum_qty FROM (
  SELECT 1 AS is_real, l_quantity FROM feat WHERE side = 'real' UNION ALL
  SELECT 0, l_quantity FROM feat WHERE side = 'synthetic') GROUP BY is_real""", ["sum_qty"], digits=4, ops=("U1", "U2"))
def q_stack(spark, d):
    r, s = fx.pair(spark, d)
    st = prep.stack_sources(r.select("l_quantity"), s.select("l_quantity"))
    return st.groupBy("is_real").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"))


# ----------------------------------------------------------------- splits

@register("random_split", f"""SELECT o_orderkey, CASE WHEN {H('o_orderkey', 1234)} / 1099511627776e0 < 0.6 THEN 'train'
  WHEN {H('o_orderkey', 1234)} / 1099511627776e0 < 0.8 THEN 'test' ELSE 'val' END AS split FROM orders""", ops=("X1", "X4"))
def q_random_split(spark, d):
    return prep.random_split(fx.table(spark, d, "orders").select("o_orderkey"), [0.6, 0.2, 0.2], "o_orderkey", 1234)


@register("stratified_split", f"""SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY {H('o_orderkey', 42)}, o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2)
  THEN 'test' ELSE 'train' END AS split FROM orders""", ops=("X3",))
def q_strat_split(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return prep.stratified_split(o, "o_orderstatus", 0.2, "o_orderkey", 42)


@register("stratified_fold", f"""SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY {H('o_orderkey', 42)}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""", ops=("W4",))
def q_strat_fold(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return prep.stratified_fold(o, "o_orderstatus", 5, "o_orderkey", 42)


@register("covering_split_check", f"""WITH s AS (SELECT p_brand, p_type, CASE WHEN {H('p_partkey', 1234)} / 1099511627776e0 < 0.01
  THEN 'train' ELSE 'test' END AS split FROM part),
  l AS (SELECT split, 'p_brand' AS feature, CAST(p_brand AS VARCHAR) AS value FROM s UNION ALL
        SELECT split, 'p_type', CAST(p_type AS VARCHAR) FROM s)
SELECT DISTINCT feature, value FROM l EXCEPT SELECT feature, value FROM l WHERE split = 'train'""", ops=("X2",))
def q_covering(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return prep.covering_split_check(prep.random_split(p, [0.01, 0.99], "p_partkey", 1234, ("train", "test")),
                                     ["p_brand", "p_type"])


@register("covering_split", f"""WITH s AS (SELECT p_partkey, CAST(p_brand AS VARCHAR) AS b, CAST(p_type AS VARCHAR) AS t,
  {H('p_partkey', 1234)} / 1099511627776e0 < 0.01 AS held, {H('p_partkey', 1235)} AS h FROM part),
l AS (SELECT p_partkey, held, h, 'b' AS f, b AS v FROM s UNION ALL SELECT p_partkey, held, h, 't', t FROM s),
m AS (SELECT arg_min(p_partkey, (h, p_partkey)) AS k FROM l WHERE v IS NOT NULL GROUP BY f, v HAVING NOT bool_or(held))
SELECT p_partkey, CASE WHEN held OR p_partkey IN (SELECT k FROM m) THEN 'train' ELSE 'test' END AS split FROM s""", ops=("X2",))
def q_covering_split(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return prep.covering_split(p, ["p_brand", "p_type"], [0.01, 0.99], "p_partkey").select("p_partkey", "split")


# ----------------------------------------------------------------- over runs

RUN_REPORT_SQL = fx.cte("runs") + """, rep AS (
  SELECT run_id, 'share_f' AS metric, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS value
  FROM runs WHERE side = 'synthetic' GROUP BY run_id
  UNION ALL SELECT run_id, 'qty_ratio', avg(l_quantity) / (SELECT avg(l_quantity) FROM runs WHERE side = 'real')
  FROM runs WHERE side = 'synthetic' GROUP BY run_id
  UNION ALL SELECT run_id, 'nan_metric', CASE WHEN run_id = 1 THEN 'NaN'::DOUBLE ELSE avg(l_discount) END
  FROM runs WHERE side = 'synthetic' GROUP BY run_id)
"""


def _run_reports(spark, d):
    v = fx.view(spark, d, "runs")
    real_mean = v.where("side = 'real'").agg(F.avg("l_quantity").alias("m")).withColumn("_k", F.lit(1))
    syn = v.where("side = 'synthetic'")
    a = syn.groupBy("run_id").agg(F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)).alias("value")) \
        .select("run_id", F.lit("share_f").alias("metric"), "value")
    b = syn.groupBy("run_id").agg(F.avg("l_quantity").alias("mq")).withColumn("_k", F.lit(1)).join(
        F.broadcast(real_mean), "_k").select("run_id", F.lit("qty_ratio").alias("metric"), (F.col("mq") / F.col("m")).alias("value"))
    c = syn.groupBy("run_id").agg(F.avg("l_discount").alias("v")).select(
        "run_id", F.lit("nan_metric").alias("metric"),
        F.when(F.col("run_id") == 1, F.lit(float("nan"))).otherwise(F.col("v")).alias("value"))
    return a.unionByName(b).unionByName(c)


@register("average_runs", RUN_REPORT_SQL + "SELECT metric, avg(CASE WHEN isnan(value) THEN NULL ELSE value END) AS value "
          "FROM rep GROUP BY metric", ["value"], ops=("A12", "U7"))
def q_avg_runs(spark, d):
    return stats.average_runs(_run_reports(spark, d))


@register("report_runs", RUN_REPORT_SQL + "SELECT metric, round(avg((1.0 - value) * 100.0), 3) AS error_mean, "
          "round(stddev_samp((1.0 - value) * 100.0), 3) AS error_std FROM rep WHERE metric <> 'nan_metric' GROUP BY metric",
          ["error_mean", "error_std"], ops=("A13",))
def q_report_runs(spark, d):
    return stats.report_runs(_run_reports(spark, d).where("metric <> 'nan_metric'"))


@register("seed_summary", RUN_REPORT_SQL + "SELECT 'test' AS split, metric, count(*) AS n, avg(value) AS mean, "
          "stddev_pop(value) AS std FROM rep WHERE metric <> 'nan_metric' GROUP BY metric", ["mean", "std"], ops=("A14",))
def q_seed_summary(spark, d):
    return stats.seed_summary(_run_reports(spark, d).where("metric <> 'nan_metric'").withColumn("split", F.lit("test")))
