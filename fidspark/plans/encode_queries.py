"""Registered queries: encoders and inverses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fidspark.functions import portable_hash_sql
from fidspark.operators import cdf, encode, prep
from fidspark.plans import fixtures as fx
from fidspark.plans.catalog import register

FEAT = fx.cte("feat")
H = portable_hash_sql


def _pair(spark, d):
    return fx.pair(spark, d)


STATS_SQL = """(SELECT avg(l_quantity) AS mq, coalesce(nullif(stddev_pop(l_quantity), 0), 1) AS sq,
  avg(l_discount) AS md, coalesce(nullif(stddev_pop(l_discount), 0), 1) AS sd,
  min(l_discount) AS lod, max(l_discount) AS hid FROM feat WHERE side = 'real') st"""


@register("standard_scale", FEAT + f"""SELECT side, (l_quantity - mq) / sq AS l_quantity, (l_discount - md) / sd AS l_discount,
  ((l_quantity - mq) / sq) * sq + mq AS l_quantity_back FROM feat, {STATS_SQL}""",
          ["l_quantity", "l_discount", "l_quantity_back"], ops=("E1", "E4"))
def q_std(spark, d):
    v = fx.view(spark, d, "feat").select("side", "l_quantity", "l_discount")
    st = encode.fit_scale(v.where("side = 'real'"), ["l_quantity", "l_discount"])
    sc = encode.standard_scale(v, st).withColumn("l_quantity_back", F.col("l_quantity"))
    return encode.standard_scale(sc, {"l_quantity_back": st["l_quantity"]}, inverse=True)


@register("minmax_scale", FEAT + f"""SELECT side, ((l_discount - lod) / (hid - lod)) * 2 - 1 AS l_discount,
  greatest(least(((((l_discount - lod) / (hid - lod)) * 2 - 1) + 1) / 2 * (hid - lod) + lod, hid), lod) AS l_discount_back
  FROM feat, {STATS_SQL}""", ["l_discount", "l_discount_back"], ops=("E2", "E20"))
def q_minmax(spark, d):
    v = fx.view(spark, d, "feat").select("side", "l_discount")
    st = encode.fit_scale(v.where("side = 'real'"), ["l_discount"])
    sc = encode.minmax_scale(v, st, centered=True).withColumn("l_discount_back", F.col("l_discount"))
    return encode.minmax_scale(sc, {"l_discount_back": st["l_discount"]}, centered=True, inverse=True)


@register("log_clip", "SELECT o_orderkey, ln(greatest(least(o_totalprice / 10.0, 20000.0), 1.0)) AS y FROM orders",
          ["y"], ops=("E5",))
def q_log_clip(spark, d):
    o = fx.table(spark, d, "orders").withColumn("x", F.col("o_totalprice") / 10.0)
    return o.select("o_orderkey", encode.log_clip("x").alias("y"))


@register("log_encode", FEAT + """SELECT side, ln(l_quantity) AS l_quantity, ln(l_discount + 1.0) AS l_discount,
  exp(ln(l_discount + 1.0)) - 1.0 AS l_discount_back FROM feat""", ["l_quantity", "l_discount", "l_discount_back"],
          ops=("E6",))
def q_log_encode(spark, d):
    v = fx.view(spark, d, "feat").select("side", "l_quantity", "l_discount")
    enc, lower = encode.log_encode(v, ["l_quantity", "l_discount"])
    both = enc.withColumn("l_discount_back", F.col("l_discount"))
    back, _ = encode.log_encode(both, ["l_discount_back"], inverse=True, lower={"l_discount_back": lower["l_discount"]})
    return back


TRAIN_PART = f"({H('p_partkey', 3)} / 1099511627776e0 < 0.05)"


@register("ordinal_encode", f"""WITH tr AS (SELECT * FROM part WHERE {TRAIN_PART}),
dt AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT CAST(p_type AS VARCHAR) AS value FROM tr)),
db AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT CAST(p_brand AS VARCHAR) AS value FROM tr))
SELECT p_partkey, CAST(coalesce(dt.idx, (SELECT count(*) FROM dt)) AS INTEGER) AS p_type,
       CAST(coalesce(db.idx, (SELECT count(*) FROM db)) AS INTEGER) AS p_brand
FROM part LEFT JOIN dt ON CAST(part.p_type AS VARCHAR) = dt.value LEFT JOIN db ON CAST(part.p_brand AS VARCHAR) = db.value""",
          ops=("E7", "J8"))
def q_ordinal(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    tr = prep.sample_pct(p, 5, "p_partkey", 3)
    dic = encode.fit_dictionary(tr, ["p_type", "p_brand"])
    return encode.ordinal(p, ["p_type", "p_brand"], dic)


@register("ordinal_roundtrip", """WITH db AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT CAST(p_brand AS VARCHAR) AS value FROM part))
SELECT p_partkey, db.idx AS p_brand_idx, db.value AS p_brand FROM part LEFT JOIN db ON CAST(part.p_brand AS VARCHAR) = db.value""",
          ops=("E14",))
def q_ordinal_rt(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_brand")
    dic = encode.fit_dictionary(p, ["p_brand"])
    enc = encode.ordinal(p, ["p_brand"], dic).withColumnRenamed("p_brand", "p_brand_idx")
    back = encode.ordinal_inverse(enc.withColumn("p_brand", F.col("p_brand_idx")), ["p_brand"], dic)
    return back.select("p_partkey", "p_brand_idx", "p_brand")


EV_TYPES = fx.EVENT_TYPES


@register("one_hot", "SELECT event_id, " + ", ".join(
    f"CASE WHEN CAST(event_type AS VARCHAR) = '{v}' THEN 1.0 ELSE 0.0 END AS oh_{i}" for i, v in enumerate(EV_TYPES))
          + " FROM events", [f"oh_{i}" for i in range(len(EV_TYPES))], ops=("E8",))
def q_one_hot(spark, d):
    ev = fx.table(spark, d, "events").select("event_id", "event_type")
    dic = encode.fit_dictionary(ev, ["event_type"])
    cats = encode.categories_of(dic, "event_type")
    oh = encode.one_hot(ev, "event_type", cats, "oh")
    return oh.select("event_id", *[F.col("oh")[i].alias(f"oh_{i}") for i in range(len(cats))])


@register("decode_one_hot", "SELECT event_id, CAST(event_type AS VARCHAR) AS event_type FROM events", ops=("E22",))
def q_decode_oh(spark, d):
    ev = fx.table(spark, d, "events").select("event_id", "event_type")
    cats = EV_TYPES
    oh = encode.one_hot(ev, "event_type", cats, "oh")
    return encode.decode_one_hot(oh.select("event_id", "oh"), "oh", cats, "event_type").select("event_id", "event_type")


@register("collapse_rare", """SELECT p_partkey, CASE WHEN c.n >= round(t.n * 0.041) THEN CAST(p.p_brand AS VARCHAR) ELSE '__rare__' END AS p_brand
FROM part p JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) c ON p.p_brand = c.p_brand,
     (SELECT count(*) AS n FROM part) t""", ops=("E9",))
def q_rare(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_brand")
    return encode.collapse_rare(p, ["p_brand"], 0.041)


@register("numeric_nulls_mean", FEAT + """SELECT side, coalesce(l_tax, (SELECT avg(l_tax) FROM feat WHERE side = 'real')) AS l_tax
  FROM feat""", ["l_tax"], ops=("E11",))
def q_num_nulls(spark, d):
    v = fx.view(spark, d, "feat").select("side", "l_tax")
    return encode.numeric_nulls(v, ["l_tax"], train=v.where("side = 'real'"))


@register("categorical_nulls_mode", FEAT + """, m AS (SELECT CASE WHEN l_returnflag = '?' THEN NULL ELSE l_returnflag END AS f FROM feat),
mode AS (SELECT f FROM m WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)
SELECT coalesce(f, (SELECT f FROM mode)) AS l_returnflag FROM m""", ops=("E12",))
def q_cat_nulls(spark, d):
    v = prep.null_marker_columns(fx.view(spark, d, "feat").select("l_returnflag"), ["l_returnflag"])
    return encode.categorical_nulls(v, ["l_returnflag"])


@register("round_integers", "SELECT l_orderkey, CAST(round_even(l_extendedprice / 8.0, 0) AS BIGINT) AS v FROM lineitem",
          ops=("E15",))
def q_round(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 8.0).alias("v"))
    return encode.round_integers(li, ["v"])


@register("dequantize_roundtrip", f"""SELECT l_orderkey, l_linenumber,
  CAST(floor(CAST(l_linenumber AS DOUBLE) + {H('l_orderkey', 0)} / 1099511627776e0 * 1.0) AS BIGINT) AS l_linenumber_back
  FROM lineitem""", ops=("E13",))
def q_dequant(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("x"))
    dq = encode.dequantize(li, ["x"], "l_orderkey", 1.0, seed=0)
    return dq.select("l_orderkey", "l_linenumber", encode.dequantize_inverse("x").alias("l_linenumber_back"))


@register("dequantize_beta", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS l_linenumber_back, true AS within FROM lineitem",
          ops=("E13", "F4"))
def q_dequant_beta(spark, d):
    """Beta(2, 2) noise stays within half a unit, so rounding gives the integers back."""
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("x"))
    dq = encode.dequantize(li, ["x"], "l_orderkey", 2.0, seed=0, dist="beta")
    return dq.select("l_orderkey", "l_linenumber", encode.dequantize_inverse("x", "beta").alias("l_linenumber_back"),
                     (F.abs(F.col("x") - F.col("l_linenumber")) < 0.5).alias("within"))


@register("ordinal_ratio", """WITH dic AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS idx, count(*) OVER () AS k
  FROM (SELECT CAST(p_type AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 1))
SELECT p_partkey, idx / CAST(k AS DOUBLE) AS p_type FROM part JOIN dic ON CAST(part.p_type AS VARCHAR) = dic.value""",
          ["p_type"], ops=("E21", "W6"))
def q_ord_ratio(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_type")
    dic = encode.fit_dictionary(p, ["p_type"], order="freq")
    return encode.ordinal_ratio(p, ["p_type"], dic)


@register("leave_one_out", """SELECT o_orderkey, CASE WHEN count(*) OVER w > 1
  THEN (sum(y) OVER w - y) / (count(*) OVER w - 1) ELSE avg(y) OVER () END AS o_orderpriority_loo
  FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders)
  WINDOW w AS (PARTITION BY o_orderpriority)""", ["o_orderpriority_loo"], ops=("E10", "W7"))
def q_loo(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderpriority",
                                            F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"))
    return encode.leave_one_out(o, "o_orderpriority", "y").select("o_orderkey", "o_orderpriority_loo")


def _qgrid_probs(n: int) -> list[float]:
    nq = max(min(n // 30, 1000), 10)
    return [i / (nq - 1.0) for i in range(nq)]


@register("quantile_grid", FEAT + """, r AS (SELECT l_discount AS v, row_number() OVER (ORDER BY l_discount) - 1 AS ix
  FROM feat WHERE side = 'real'),
c AS (SELECT count(*) AS n, greatest(least(count(*) // 30, 1000), 10) AS nq FROM r),
g AS (SELECT i, (n - 1) * (i / (nq - 1.0)) AS h, n FROM (SELECT unnest(range(0, nq)) AS i, nq, n FROM c))
SELECT g.i AS grid_index, lo.v + (g.h - floor(g.h)) * (hi.v - lo.v) AS q
FROM g JOIN r lo ON lo.ix = CAST(floor(g.h) AS BIGINT) JOIN r hi ON hi.ix = least(CAST(floor(g.h) AS BIGINT) + 1, g.n - 1)""",
          ["q"], ops=("E3",))
def q_qgrid(spark, d):
    r, _ = fx.pair(spark, d)
    r = r.select("l_discount")
    n = r.count()
    probs = _qgrid_probs(n)
    counts = cdf.long_form(r, ["l_discount"]).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_r"))
    pre = cdf.prefix_sums(counts, ["feature"], "value", ["n_r"])
    q = cdf.quantiles(pre, probs, sides=["n_r"])
    idx = spark.createDataFrame([(float(p), i) for i, p in enumerate(probs)], "p double, grid_index long")
    return q.join(F.broadcast(idx), "p").select("grid_index", "q")
