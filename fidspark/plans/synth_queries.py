"""Registered queries: synthesis on tables and imputation pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidspark.functions import portable_hash_sql
from fidspark.operators import nn, synth
from fidspark.plans import fixtures as fx
from fidspark.plans.catalog import register
from fidspark.plans.sqltext import long_sql
from fidspark.plans.stats_queries import FEAT, NUM

H = portable_hash_sql
PCATS = ["p_type", "p_brand"]


def prob_sql(log: bool = True) -> str:
    wgt = "ln(n + 1.0)" if log else "CAST(n AS DOUBLE)"
    lng = " UNION ALL ".join(f"SELECT {i} AS column_idx, '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM part"
                             for i, c in enumerate(PCATS))
    return f"""SELECT column_idx, feature, value, prob, sum(prob) OVER w - prob AS cum_lo, sum(prob) OVER w AS cum_hi FROM (
  SELECT column_idx, feature, value, {wgt} / sum({wgt}) OVER (PARTITION BY feature) AS prob
  FROM (SELECT column_idx, feature, value, count(*) AS n FROM ({lng}) GROUP BY ALL))
  WINDOW w AS (PARTITION BY feature ORDER BY value NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@register("condition_probabilities", prob_sql(), ["prob", "cum_lo", "cum_hi"], ops=("X5",))
def q_cond_probs(spark, d):
    return synth.condition_probabilities(fx.table(spark, d, "part"), PCATS)


COND_SQL = f"""WITH p AS ({prob_sql()}),
d AS (SELECT p_partkey, CAST(floor({H('p_partkey', 0)} / 1099511627776e0 * 2) AS INTEGER) AS column_idx,
             {H('p_partkey', 1)} / 1099511627776e0 AS u FROM part),
c AS (SELECT d.p_partkey, p.column_idx, p.feature, p.value FROM d JOIN p ON d.column_idx = p.column_idx
      AND d.u >= p.cum_lo AND d.u < p.cum_hi)
"""


def _conditions(spark, d):
    part = fx.table(spark, d, "part")
    probs = synth.condition_probabilities(part, PCATS)
    return synth.sample_conditions(part.select("p_partkey"), "p_partkey", probs, len(PCATS), seed=0)


@register("sample_conditions", COND_SQL + "SELECT * FROM c", ops=("X5",))
def q_sample_conditions(spark, d):
    return _conditions(spark, d)


@register("sample_matching", COND_SQL + f""", lng AS (SELECT p_partkey AS rk, 'p_type' AS feature, CAST(p_type AS VARCHAR) AS value FROM part
  UNION ALL SELECT p_partkey, 'p_brand', CAST(p_brand AS VARCHAR) FROM part),
rk AS (SELECT *, row_number() OVER (PARTITION BY feature, value ORDER BY rk) AS rn,
              count(*) OVER (PARTITION BY feature, value) AS n_cv FROM lng)
SELECT c.p_partkey, c.feature, c.value, rk.rk AS real_key FROM c JOIN (SELECT DISTINCT feature, value, n_cv FROM rk) s
  ON c.feature = s.feature AND c.value = s.value
  JOIN rk ON rk.feature = c.feature AND rk.value = c.value
  AND rk.rn = CAST(floor({H('c.p_partkey', 2)} / 1099511627776e0 * s.n_cv) + 1 AS INTEGER)""", ops=("X6",))
def q_sample_matching(spark, d):
    cond = _conditions(spark, d).select("p_partkey", "feature", "value")
    real = fx.table(spark, d, "part").select(F.col("p_partkey").alias("real_key"), *PCATS)
    return synth.sample_matching(cond, "p_partkey", real, "real_key", PCATS, seed=0)


@register("tail_band_penalty", FEAT + f""", long AS ({long_sql('feat', NUM)})
SELECT l.feature, sum(greatest(lo - value, 0.0) + greatest(value - hi, 0.0)) / count(*) AS tail_penalty
FROM long l JOIN (SELECT feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM long
                  WHERE side = 'real' GROUP BY feature) b ON l.feature = b.feature
WHERE side = 'synthetic' AND value IS NOT NULL GROUP BY l.feature""", ["tail_penalty"], ops=("X9",))
def q_tail_band(spark, d):
    r, s = fx.pair(spark, d)
    return synth.tail_band_penalty(r, s, NUM)


@register("smote", ops=("X8", "J5"))
def q_smote(spark, d):
    p = fx.view(spark, d, "near").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return synth.smote(p, "p_partkey", "p_type", ["p_size", "p_retailprice"], k=5, seed=0)


@register("smote_encoded", ops=("X8", "J5", "E3", "E22"))
def q_smote_encoded(spark, d):
    p = fx.view(spark, d, "near").select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice")
    return synth.smote_encoded(p, "p_partkey", "p_type", ["p_size", "p_retailprice"], ["p_brand"], k=5, seed=0)


TRAIN_EV = f"{H('event_id', 5)} / 1099511627776e0 < 0.8"


@register("impute_baseline_num", f"""SELECT event_id, 0 AS trial, (SELECT avg(value) FROM events WHERE {TRAIN_EV}) AS value
  FROM events WHERE NOT ({TRAIN_EV})""", ["value"], ops=("I1",))
def q_impute_num(spark, d):
    ev = fx.table(spark, d, "events")
    u = F.expr(TRAIN_EV)
    return synth.impute_baseline(ev.where(u), ev.where(~u), "value", "num", "event_id")


@register("impute_baseline_cat", f"""WITH p AS (SELECT value, sum(prob) OVER w - prob AS cum_lo, sum(prob) OVER w AS cum_hi FROM (
    SELECT value, CAST(n AS DOUBLE) / sum(n) OVER () AS prob FROM (
      SELECT CAST(event_type AS VARCHAR) AS value, count(*) AS n FROM events WHERE {TRAIN_EV} GROUP BY 1))
    WINDOW w AS (ORDER BY value NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT event_id, unnest(range(0, 3)) AS trial FROM events WHERE NOT ({TRAIN_EV}))
SELECT event_id, CAST(trial AS INTEGER) AS trial, p.value AS event_type FROM t JOIN p
  ON {H('event_id * 3 + trial', 0)} / 1099511627776e0 >= cum_lo AND {H('event_id * 3 + trial', 0)} / 1099511627776e0 < cum_hi""",
          ops=("I1", "X7"))
def q_impute_cat(spark, d):
    ev = fx.table(spark, d, "events")
    u = F.expr(TRAIN_EV)
    return synth.impute_baseline(ev.where(u), ev.where(~u), "event_type", "cat", "event_id", trials=3)


@register("mask_column", "SELECT event_id, 5 AS event_type FROM events", ops=("I2",))
def q_mask(spark, d):
    return synth.mask_column(fx.table(spark, d, "events").select("event_id", "event_type"), "event_type", 5)


CATS = fx.EVENT_TYPES
TRIAL_SQL = ("SELECT event_id, m AS trial, ['" + "', '".join(CATS) + "'][CAST((event_id * event_id + m * event_id + m) % 5 AS INTEGER) + 1] "
             "AS event_type FROM events, range(0, 5) r(m)")


def _trials(spark, d):
    ev = fx.table(spark, d, "events").select("event_id")
    t = ev.select("event_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("trial"))
    arr = F.array(*[F.lit(c) for c in CATS])
    pos = ((F.col("event_id") * F.col("event_id") + F.col("trial") * F.col("event_id") + F.col("trial")) % 5).cast("int")
    return t.select("event_id", "trial", F.element_at(arr, pos + 1).alias("event_type"))


@register("pool_imputations", f"""WITH tr AS ({TRIAL_SQL}),
votes AS (SELECT event_id, event_type, count(*) / 5.0 AS share FROM tr GROUP BY ALL),
best AS (SELECT event_id, arg_min(event_type, (-share, list_position(['{"', '".join(CATS)}'], event_type))) AS pred FROM votes GROUP BY event_id),
acc AS (SELECT avg(CASE WHEN pred = CAST(e.event_type AS VARCHAR) THEN 1.0 ELSE 0.0 END) AS f1_micro FROM best JOIN events e USING (event_id)),
pairs AS (SELECT CASE WHEN g.c = CAST(e.event_type AS VARCHAR) THEN 1 ELSE 0 END AS y, coalesce(v.share, 0.0) AS s
          FROM events e CROSS JOIN (SELECT unnest(['{"', '".join(CATS)}']) AS c) g
          LEFT JOIN votes v ON v.event_id = e.event_id AND v.event_type = g.c),
auc AS (SELECT (sum(r) FILTER (WHERE y = 1) - p * (p + 1) / 2.0) / (p * (n - p)) AS auroc_micro FROM (
  SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r,
         CAST(count(*) FILTER (WHERE y = 1) OVER () AS DOUBLE) AS p, CAST(count(*) OVER () AS DOUBLE) AS n FROM pairs)
  GROUP BY p, n)
SELECT f1_micro, auroc_micro FROM acc, auc""", ["f1_micro", "auroc_micro"], ops=("I3", "J7", "T4"))
def q_pool(spark, d):
    truth = fx.table(spark, d, "events").select("event_id", "event_type")
    return synth.pool_imputations(_trials(spark, d), truth, "event_id", "event_type", CATS)


U = f"{H('event_id', 9)} / 1099511627776e0"


@register("sample_start_cat", f"""WITH c AS (SELECT CAST(p_brand AS VARCHAR) AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
p AS (SELECT value, sum(prob) OVER w - prob AS cum_lo, CASE WHEN lead(prob) OVER (ORDER BY value) IS NULL THEN 1.0 ELSE sum(prob) OVER w END AS cum_hi
  FROM (SELECT value, n / sum(n) OVER () AS prob FROM c) WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT event_id, 'p_brand is ' || p.value AS start FROM events JOIN p ON {U} >= cum_lo AND {U} < cum_hi""", ops=("X7",))
def q_sample_start_cat(spark, d):
    return synth.sample_start(fx.table(spark, d, "part"), "p_brand", fx.table(spark, d, "events"), "event_id", seed=9)


@register("sample_start_num", f"""WITH c AS (SELECT printf('%.5f', p_retailprice) AS value, count(*) AS n FROM part GROUP BY 1),
p AS (SELECT value, sum(prob) OVER w - prob AS cum_lo, CASE WHEN lead(prob) OVER (ORDER BY value) IS NULL THEN 1.0 ELSE sum(prob) OVER w END AS cum_hi
  FROM (SELECT value, n / sum(n) OVER () AS prob FROM c) WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT event_id, 'p_retailprice is ' || p.value AS start FROM events JOIN p ON {U} >= cum_lo AND {U} < cum_hi""", ops=("X7",))
def q_sample_start_num(spark, d):
    return synth.sample_start(fx.table(spark, d, "part"), "p_retailprice", fx.table(spark, d, "events"), "event_id", "num", seed=9)


@register("sample_start_name", f"""SELECT event_id, ['p_brand', 'p_type', 'p_size'][CAST(floor(({U}) * 3) AS BIGINT) + 1] || ' is ' AS start
FROM events""", ops=("X7",))
def q_sample_start_name(spark, d):
    return synth.sample_start_name(fx.table(spark, d, "events"), "event_id", ["p_brand", "p_type", "p_size"], seed=9)


@register("pool_numeric", """WITH t AS (SELECT event_id, avg(ln(greatest(least(value * (1 + m * 0.1), 20000.0), 1.0))) AS p
  FROM events, range(0, 5) r(m) GROUP BY event_id)
SELECT sqrt(avg((p - ln(greatest(least(value, 20000.0), 1.0))) ** 2)) AS rmse FROM t JOIN events USING (event_id)""", ["rmse"], ops=("I3",))
def q_pool_numeric(spark, d):
    ev = fx.table(spark, d, "events").select("event_id", "value")
    trials = ev.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return synth.pool_numeric(trials.select("event_id", (F.col("value") * (1 + F.col("trial") * 0.1)).alias("value")), ev, "event_id", "value")


@register("smote_neighbours", """WITH n AS (SELECT a.p_partkey AS q_key, b.p_partkey AS b_key,
    sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2) AS dist
  FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey)
SELECT q_key, CAST(rank AS INTEGER) AS rank, dist, b_key FROM (
  SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY dist, b_key) AS rank FROM n) WHERE rank <= 5""", ["dist"], ops=("X8", "J5"))
def q_smote_neighbours(spark, d):
    p = fx.view(spark, d, "near").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return nn.knn_within(p, "p_partkey", "p_type", nn.Space(num=["p_size", "p_retailprice"]), 5)
