"""Registered queries: nearest-neighbour privacy metrics over ``near`` (part) and ``vec`` (embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidspark.operators import nn
from fidspark.plans import fixtures as fx
from fidspark.plans.catalog import register

NEAR = fx.cte("near")
NCOLS = ["p_size", "p_retailprice"]
EMB_DIM = 64
ECOLS = [f"e{i}" for i in range(EMB_DIM)]


def _near_pair(spark, d):
    """real = even keys; synthetic = odd keys plus exact copies of every 30th real row."""
    r, s = fx.pair(spark, d, "near")
    cols = ["p_partkey", *NCOLS, "p_type", "p_brand"]
    copies = r.where(F.col("p_partkey") % 30 == 0).withColumn("p_partkey", F.col("p_partkey") + 1000000)
    return r.select(cols), s.select(cols).unionByName(copies.select(cols))


NEAR_PAIR = NEAR + """, r AS (SELECT p_partkey, p_size, p_retailprice FROM near WHERE side = 'real'),
s AS (SELECT p_partkey, p_size, p_retailprice FROM near WHERE side = 'synthetic'
      UNION ALL SELECT p_partkey + 1000000, p_size, p_retailprice FROM near WHERE side = 'real' AND p_partkey % 30 = 0),
st AS (SELECT avg(p_size) AS m1, coalesce(nullif(stddev_pop(p_size), 0), 1) AS s1,
              avg(p_retailprice) AS m2, coalesce(nullif(stddev_pop(p_retailprice), 0), 1) AS s2 FROM r),
d AS (SELECT s.p_partkey, min(sqrt(pow((s.p_size - m1) / s1 - (r.p_size - m1) / s1, 2)
          + pow((s.p_retailprice - m2) / s2 - (r.p_retailprice - m2) / s2, 2))) AS nn_distance
      FROM s, r, st GROUP BY s.p_partkey)
"""


@register("nn_distance", NEAR_PAIR + "SELECT p_partkey, nn_distance FROM d", ["nn_distance"], ops=("A25", "J3", "F2"))
def q_nn_rows(spark, d):
    r, s = _near_pair(spark, d)
    rows, _ = nn.nn_distance(r, s, NCOLS, "p_partkey", "p_partkey")
    return rows


@register("nn_distance_summary", NEAR_PAIR + """SELECT avg(nn_distance) AS nn_distance_mean,
  quantile_cont(nn_distance, 0.5) AS nn_distance_median, quantile_cont(nn_distance, 0.95) AS nn_distance_p95,
  avg(CASE WHEN nn_distance < 1e-6 THEN 1.0 ELSE 0.0 END) AS nn_near_duplicate_rate FROM d""",
          ["nn_distance_mean", "nn_distance_median", "nn_distance_p95", "nn_near_duplicate_rate"], ops=("A25", "A26"))
def q_nn_summary(spark, d):
    r, s = _near_pair(spark, d)
    _, summ = nn.nn_distance(r, s, NCOLS, "p_partkey", "p_partkey")
    return summ


DCR_SQL = NEAR + """, t AS (SELECT * FROM near WHERE split = 'real'), s AS (SELECT * FROM near WHERE split = 'synthetic'),
h AS (SELECT * FROM near WHERE split = 'holdout'),
rg AS (SELECT coalesce(nullif(max(p_size) - min(p_size), 0), 1) AS w1,
              coalesce(nullif(max(p_retailprice) - min(p_retailprice), 0), 1) AS w2 FROM t),
dd AS (SELECT s.p_partkey,
  (SELECT min(abs(s.p_size / w1 - t.p_size / w1) + abs(s.p_retailprice / w2 - t.p_retailprice / w2)
     + CASE WHEN s.p_type <> t.p_type THEN 2.0 ELSE 0.0 END + CASE WHEN s.p_brand <> t.p_brand THEN 2.0 ELSE 0.0 END)
   FROM t) AS dcr_real,
  (SELECT min(abs(s.p_size / w1 - h.p_size / w1) + abs(s.p_retailprice / w2 - h.p_retailprice / w2)
     + CASE WHEN s.p_type <> h.p_type THEN 2.0 ELSE 0.0 END + CASE WHEN s.p_brand <> h.p_brand THEN 2.0 ELSE 0.0 END)
   FROM h) AS dcr_test
  FROM s, rg)
"""


def _dcr(spark, d):
    r, s, h = fx.triple(spark, d, "near")
    return nn.dcr(s, "p_partkey", r, "p_partkey", h, "p_partkey", NCOLS, ["p_type", "p_brand"])


@register("dcr_rows", DCR_SQL + "SELECT p_partkey, dcr_real, dcr_test FROM dd", ["dcr_real", "dcr_test"], ops=("A27", "J3", "E8"))
def q_dcr_rows(spark, d):
    rows, _ = _dcr(spark, d)
    return rows


@register("dcr_score", DCR_SQL + "SELECT avg(CASE WHEN dcr_real < dcr_test THEN 1.0 ELSE 0.0 END) AS dcr_score FROM dd",
          ["dcr_score"], ops=("A27",))
def q_dcr_score(spark, d):
    _, score = _dcr(spark, d)
    return score


def _z(tab: str, alias: str) -> str:
    return (f"{alias} AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / coalesce(nullif(stddev_pop(p_size) OVER (), 0), 1) AS z1, "
            f"(p_retailprice - avg(p_retailprice) OVER ()) / coalesce(nullif(stddev_pop(p_retailprice) OVER (), 0), 1) AS z2 "
            f"FROM {tab} WHERE (p_size, p_retailprice) IN (SELECT (p_size, p_retailprice) FROM {tab} "
            f"GROUP BY p_size, p_retailprice HAVING count(*) = 1))")


def _top2(a: str, b: str, self_: bool) -> str:
    excl = "WHERE a.p_partkey <> b.p_partkey" if self_ else ""
    return f"""(SELECT q, max(d) FILTER (WHERE rn = 1) AS d1, max(d) FILTER (WHERE rn = 2) AS d2 FROM (
  SELECT a.p_partkey AS q, sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)) AS d,
         row_number() OVER (PARTITION BY a.p_partkey ORDER BY sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)), b.p_partkey) AS rn
  FROM {a} a, {b} b {excl}) WHERE rn <= 2 GROUP BY q)"""


PRIV_SQL = NEAR + f""", rt AS (SELECT p_partkey, p_size, p_retailprice FROM near WHERE side = 'real'),
ft AS (SELECT p_partkey, p_size, p_retailprice FROM near WHERE side = 'synthetic'),
{_z('rt', 'zr')}, {_z('ft', 'zf')}
SELECT
 (SELECT quantile_cont(d1, 0.05) FROM {_top2('zr', 'zf', False)}) AS dcr_real_fake,
 (SELECT quantile_cont(d1, 0.05) FROM {_top2('zr', 'zr', True)}) AS dcr_real_real,
 (SELECT quantile_cont(d1, 0.05) FROM {_top2('zf', 'zf', True)}) AS dcr_fake_fake,
 (SELECT quantile_cont(CASE WHEN d2 = 0 THEN NULL ELSE d1 / d2 END, 0.05) FROM {_top2('zr', 'zf', False)}) AS nndr_real_fake,
 (SELECT quantile_cont(CASE WHEN d2 = 0 THEN NULL ELSE d1 / d2 END, 0.05) FROM {_top2('zr', 'zr', True)}) AS nndr_real_real,
 (SELECT quantile_cont(CASE WHEN d2 = 0 THEN NULL ELSE d1 / d2 END, 0.05) FROM {_top2('zf', 'zf', True)}) AS nndr_fake_fake"""

PRIV_COLS = ["dcr_real_fake", "dcr_real_real", "dcr_fake_fake", "nndr_real_fake", "nndr_real_real", "nndr_fake_fake"]


@register("dcr_percentiles", PRIV_SQL, PRIV_COLS, ops=("A29", "A30", "A28", "J5", "T3", "E1"))
def q_privacy(spark, d):
    r, s = fx.pair(spark, d, "near")
    return nn.dcr_percentiles(r, s, NCOLS, "p_partkey", "p_partkey")


def _vec_pair(spark, d):
    v = fx.view(spark, d, "vec").select("vec_id", "side", *[F.col("embedding")[i].cast("double").alias(c)
                                                            for i, c in enumerate(ECOLS)])
    return v.where("side = 'real'").drop("side"), v.where("side = 'synthetic'").drop("side")


PRDC_SQL = fx.cte("vec") + """, r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM vec WHERE side = 'real'),
s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM vec WHERE side = 'synthetic'),
rs AS (SELECT r.vec_id AS rid, s.vec_id AS sid, list_distance(r.e, s.e) AS d FROM r, s),
radr AS (SELECT rid, d AS radius FROM (SELECT a.vec_id AS rid, list_distance(a.e, b.e) AS d,
   row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rn
   FROM r a, r b WHERE a.vec_id <> b.vec_id) WHERE rn = 5),
rads AS (SELECT sid, d AS radius FROM (SELECT a.vec_id AS sid, list_distance(a.e, b.e) AS d,
   row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rn
   FROM s a, s b WHERE a.vec_id <> b.vec_id) WHERE rn = 5),
ins AS (SELECT rs.sid, count(*) FILTER (WHERE rs.d < radr.radius) AS c FROM rs JOIN radr ON rs.rid = radr.rid GROUP BY rs.sid),
inr AS (SELECT rs.rid, count(*) FILTER (WHERE rs.d < rads.radius) AS c FROM rs JOIN rads ON rs.sid = rads.sid GROUP BY rs.rid),
cov AS (SELECT rs.rid, min(rs.d) AS d FROM rs GROUP BY rs.rid)
SELECT (SELECT avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END) FROM ins) AS precision,
       (SELECT avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END) FROM inr) AS recall,
       (SELECT avg(c) / 5.0 FROM ins) AS density,
       (SELECT avg(CASE WHEN cov.d < radr.radius THEN 1.0 ELSE 0.0 END) FROM cov JOIN radr ON cov.rid = radr.rid) AS coverage"""


@register("prdc", PRDC_SQL, ["precision", "recall", "density", "coverage"], ops=("A31", "J5", "T3"))
def q_prdc(spark, d):
    r, s = _vec_pair(spark, d)
    return nn.prdc(r, s, ECOLS, "vec_id", "vec_id", k=5)


def _alpha_sql() -> str:
    def off(t: str, m: str) -> str:
        return f"sqrt(({t}.p_size - {m}.a) ** 2 + ({t}.p_retailprice - {m}.b) ** 2)"

    gap = "sqrt((x.p_size - y.p_size) ** 2 + (x.p_retailprice - y.p_retailprice) ** 2)"
    return fx.cte("near") + f""", r AS (SELECT * FROM near WHERE side = 'real'), s AS (SELECT * FROM near WHERE side = 'synthetic'),
mr AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b FROM r), ms AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b FROM s),
lv AS (SELECT i, i / 29.0 AS alpha FROM range(0, 30) g(i)),
dr AS (SELECT {off('r', 'mr')} AS d FROM r, mr), ds AS (SELECT {off('s', 'mr')} AS d FROM s, mr),
balls AS (SELECT i, alpha, (SELECT quantile_cont(d, [x / 29.0 for x in range(0, 30)]) FROM dr)[i + 1] AS q FROM lv),
prec AS (SELECT i, alpha, avg(CASE WHEN d <= q THEN 1.0 ELSE 0.0 END) AS p FROM balls, ds GROUP BY ALL),
own AS (SELECT x.p_partkey AS k, min({gap}) AS d FROM r x JOIN r y ON x.p_partkey <> y.p_partkey GROUP BY 1),
syn AS (SELECT x.p_partkey AS k, arg_min(struct_pack(sk := y.p_partkey, d := {gap}, size := y.p_size, price := y.p_retailprice),
        ({gap}, y.p_partkey)) AS n FROM r x, s y GROUP BY 1),
near2 AS (SELECT syn.n.d <= own.d AS covered, sqrt((syn.n.size - ms.a) ** 2 + (syn.n.price - ms.b) ** 2) AS dc FROM syn JOIN own USING (k), ms),
shells AS (SELECT i, alpha, (SELECT quantile_cont(dc, [x / 29.0 for x in range(0, 30)]) FROM near2)[i + 1] AS q FROM lv),
cov AS (SELECT i, alpha, avg(CASE WHEN covered AND dc <= q THEN 1.0 ELSE 0.0 END) AS p FROM shells, near2 GROUP BY ALL)
SELECT 1 - (SELECT sum(abs(alpha - p)) / sum(alpha) FROM prec) AS delta_precision_alpha,
       1 - (SELECT sum(abs(alpha - p)) / sum(alpha) FROM cov) AS delta_coverage_beta"""


@register("alpha_beta", _alpha_sql(), ["delta_precision_alpha", "delta_coverage_beta"], ops=("A32",))
def q_alpha_beta(spark, d):
    r, s = fx.pair(spark, d, "near")
    return nn.alpha_beta(r, s, ["p_size", "p_retailprice"], "p_partkey", "p_partkey")


@register("nn_approximate", ops=("J4",))
def q_nn_approximate(spark, d):
    """Three near real parts of each synthetic one by bucketed projections, with their true distances."""
    r, s = _near_pair(spark, d)
    zs = nn.zscore_stats(r, NCOLS)
    return nn.knn_approximate(s, "p_partkey", r, "p_partkey", nn.Space(num=NCOLS), 3, q_stats=zs, b_stats=zs)
