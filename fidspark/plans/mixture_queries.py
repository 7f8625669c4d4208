"""Registered queries: modes of a column, mixed columns, the encoder chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidspark.functions.exprs import hash_uniform_sql
from fidspark.operators import mixture
from fidspark.plans import fixtures as fx
from fidspark.plans.catalog import register
from fidspark.spec import TableSpec

# Modes of o_totalprice for the queries with SQL (mean, deviation, weight).
MODES = mixture.Modes((100000.0, 400000.0, 250000.0), (50000.0, 60000.0, 20000.0), (0.5, 0.3, 0.2))
ZERO = mixture.Modes(MODES.mean, MODES.std, MODES.weight, (0.0,))


def _log(i: int) -> str:
    m, s, w = MODES.mean[i], MODES.std[i], MODES.weight[i]
    return f"ln({w}::DOUBLE) - ln({s}::DOUBLE) - ((x - {m}) / {s}) ** 2 / 2"


L = f"SELECT *, {_log(0)} AS l0, {_log(1)} AS l1, {_log(2)} AS l2 FROM t"
PICK = {f: "[" + ", ".join(str(v) for v in getattr(MODES, f)) + "]" for f in ("mean", "std")}
SCALED = f"greatest(least((x - {PICK['mean']}[m + 1]) / (4.0 * {PICK['std']}[m + 1]), 0.99), -0.99)"


@register("mode_normalize", f"""WITH t AS (SELECT o_orderkey, o_totalprice AS x FROM orders), l AS ({L}),
e AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS a, exp(l1 - greatest(l0, l1, l2)) AS b, exp(l2 - greatest(l0, l1, l2)) AS c,
  {hash_uniform_sql('o_orderkey', 3)} AS u FROM l),
d AS (SELECT *, CASE WHEN u * (a + b + c) < a THEN 0 WHEN u * (a + b + c) < a + b THEN 1 ELSE 2 END AS m FROM e)
SELECT o_orderkey, {SCALED} AS o_totalprice_u, CAST(m AS INTEGER) AS o_totalprice_mode FROM d""", ["o_totalprice_u"], digits=9, ops=("E17",))
def q_mode_normalize(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return mixture.encode_modes(o, "o_totalprice", MODES, "o_orderkey", 3).drop("o_totalprice")


@register("mixed_column", f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 0.0 WHEN o_custkey % 10 = 1 THEN NULL ELSE o_totalprice END AS x FROM orders),
l AS ({L}), d AS (SELECT *, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS m FROM l)
SELECT o_orderkey, CASE WHEN x = 0 THEN {abs(0.0 - MODES.mean[0]) / (4 * MODES.std[0])} ELSE {SCALED} END
  + CASE WHEN x IS NULL THEN NULL ELSE 0.0 END AS x_u,
  CAST(CASE WHEN x IS NULL THEN NULL WHEN x = 0 THEN 0 ELSE m + 1 END AS INTEGER) AS x_mode FROM d""", ["x_u"], digits=9, ops=("E19",))
def q_mixed_column(spark, d):
    return mixture.encode_modes(_mixed(spark, d), "x", ZERO).drop("x")


def _mixed(spark, d):
    return fx.table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_custkey % 10 = 0 THEN 0.0D WHEN o_custkey % 10 = 1 THEN NULL ELSE o_totalprice END AS x")


@register("mixed_column_back", f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 0.0 WHEN o_custkey % 10 = 1 THEN NULL ELSE o_totalprice END AS x FROM orders),
l AS ({L}), d AS (SELECT *, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS m FROM l)
SELECT o_orderkey, CASE WHEN x IS NULL THEN NULL WHEN x = 0 THEN 0.0 ELSE {SCALED} * 4.0 * {PICK['std']}[m + 1] + {PICK['mean']}[m + 1] END AS x FROM d""",
          ["x"], ops=("E18", "E19"))
def q_mixed_back(spark, d):
    return mixture.decode_modes(mixture.encode_modes(_mixed(spark, d), "x", ZERO), "x", ZERO)


@register("mode_fit_round_trip", ops=("E17", "E18"))
def q_mode_fit(spark, d):
    """Modes fitted on all orders; per mode its rows and the largest error of encode and decode within the clip."""
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    modes = mixture.fit_modes(o, "o_totalprice")
    e = mixture.encode_modes(o.withColumn("x", F.col("o_totalprice")), "o_totalprice", modes, "o_orderkey")
    inside = F.abs("o_totalprice_u") < mixture.CLIP
    back = mixture.decode_modes(e.withColumn("mode", F.col("o_totalprice_mode")).withColumn("inside", inside), "o_totalprice", modes)
    return back.groupBy("mode").agg(F.count("*").alias("n"), F.max(F.when(F.col("inside"), F.abs(F.col("x") - F.col("o_totalprice")))).alias("error"))


SPEC = TableSpec(num=("p_size", "p_retailprice"), cat=("p_type", "p_brand"), target="p_name", task="multiclass")


def _encoder(spark, d, **kw):
    p = fx.table(spark, d, "part").withColumn("p_size", F.when(F.col("p_partkey") % 20 != 0, F.col("p_size").cast("double"))).withColumn(
        "p_brand", F.when(F.col("p_partkey") % 30 != 0, F.col("p_brand")))
    return p, mixture.Encoder(SPEC, "p_partkey", **kw).fit(p)


ENC = """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 20 <> 0 THEN CAST(p_size AS DOUBLE) END AS s, p_retailprice AS r, CAST(p_type AS VARCHAR) AS ty,
  CASE WHEN p_partkey % 30 <> 0 THEN CAST(p_brand AS VARCHAR) END AS br, CAST(p_name AS VARCHAR) AS nm FROM part),
top AS (SELECT br FROM t WHERE br IS NOT NULL GROUP BY br ORDER BY count(*) DESC, br LIMIT 1),
f AS (SELECT p_partkey, coalesce(s, (SELECT avg(s) FROM t)) AS s, r, ty, coalesce(br, (SELECT br FROM top)) AS br, nm FROM t),
k AS (SELECT avg(s) AS ms, stddev_pop(s) AS ss, avg(r) AS mr, stddev_pop(r) AS sr FROM f),
dt AS (SELECT ty, row_number() OVER (ORDER BY ty) - 1 AS i FROM (SELECT DISTINCT ty FROM f)),
db AS (SELECT br, row_number() OVER (ORDER BY br) - 1 AS i FROM (SELECT DISTINCT br FROM f)),
dn AS (SELECT nm, row_number() OVER (ORDER BY nm) - 1 AS i FROM (SELECT DISTINCT nm FROM f))
"""


@register("encoder_blocks", ENC + """SELECT p_partkey, (s - ms) / ss AS p_size, (r - mr) / sr AS p_retailprice, CAST(dn.i AS INTEGER) AS p_name,
  CAST(dt.i AS INTEGER) AS p_type, CAST(db.i AS INTEGER) AS p_brand FROM f JOIN dt USING (ty) JOIN db USING (br) JOIN dn USING (nm), k""",
          ["p_size", "p_retailprice"], ops=("E24", "E25", "P21"))
def q_encoder(spark, d):
    p, enc = _encoder(spark, d, concat_target=True)
    return enc.split(enc.transform(p))


@register("encoder_round_trip", ENC + "SELECT p_partkey, nm AS p_name, s AS p_size, r AS p_retailprice, ty AS p_type, br AS p_brand FROM f",
          ["p_size", "p_retailprice"], ops=("E24", "P21"))
def q_encoder_back(spark, d):
    p, enc = _encoder(spark, d)
    return enc.inverse(enc.transform(p))
