"""Registered queries: column reshaping, range rejection, preview, the quantile-to-normal map."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidspark.functions import portable_hash_sql
from fidspark.operators import encode, prep
from fidspark.plans import fixtures as fx
from fidspark.plans.catalog import register
from fidspark.spec import TableSpec

SPEC = TableSpec(num=("p_size", "p_retailprice"), cat=("p_type", "p_brand"), target="p_name")


@register("label_last_reorder", "SELECT p_size, p_retailprice, CAST(p_type AS VARCHAR) AS p_type, "
          "CAST(p_brand AS VARCHAR) AS p_brand, p_name, 'p_brand,p_type,p_size,p_retailprice,p_name' AS label_last, "
          "'p_size,p_retailprice,p_type,p_brand,p_name' AS reordered FROM part", ops=("P1", "P12", "P16", "P18", "P19", "P31"))
def q_reorder(spark, d):
    p = fx.table(spark, d, "part").drop("p_partkey")  # P16: drop the id column
    last = prep.label_last(p.select("p_name", *[c for c in p.columns if c != "p_name"]), "p_name")
    out = prep.reorder(prep.cast_roles(last, list(SPEC.cat)), SPEC.num, SPEC.cat, SPEC.target)
    return out.withColumns({"label_last": F.lit(",".join(last.columns)), "reordered": F.lit(",".join(out.columns))})


@register("restore_order", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part", ops=("P20",))
def q_restore(spark, d):
    p = fx.table(spark, d, "part")
    original = p.columns
    return prep.restore(prep.reorder(p, ["p_size", "p_retailprice"], ["p_type", "p_brand", "p_name"], "p_partkey"),
                        original)


@register("complete_target_only", fx.cte("near") + """SELECT r.p_partkey, r.p_size, r.p_retailprice, r.p_type, s.p_brand
FROM (SELECT * FROM near) r JOIN (SELECT p_partkey, p_brand FROM near WHERE side = 'synthetic') s ON r.p_partkey = s.p_partkey""",
          ["p_size", "p_retailprice"], ops=("P24",))
def q_target_only(spark, d):
    v = fx.view(spark, d, "near").select("p_partkey", "side", "p_size", "p_retailprice", "p_type", "p_brand")
    return prep.complete_target_only(v.where("side = 'synthetic'").select("p_partkey", "p_brand"),
                                     v.select("p_partkey", "p_size", "p_retailprice", "p_type", "p_brand"),
                                     "p_brand", "p_partkey").select("p_partkey", "p_size", "p_retailprice", "p_type", "p_brand")


@register("reject_out_of_range", fx.cte("feat") + """SELECT l_quantity, l_discount FROM feat, (SELECT min(l_quantity) AS a, max(l_quantity) AS b,
  min(l_discount) AS c, max(l_discount) AS e FROM feat WHERE side = 'real') m
WHERE side = 'synthetic' AND l_quantity BETWEEN a AND b AND l_discount BETWEEN c AND e""",
          ["l_quantity", "l_discount"], ops=("P29",))
def q_reject(spark, d):
    r, s = fx.pair(spark, d)
    row = r.agg(F.min("l_quantity"), F.max("l_quantity"), F.min("l_discount"), F.max("l_discount")).first()
    stats = {"l_quantity": (row[0], row[1]), "l_discount": (row[2], row[3])}
    return prep.reject_out_of_range(s.select("l_quantity", "l_discount"), stats)


RANGE = {"l_quantity": (5.0, 30.0), "l_discount": (0.02, 0.08)}


@register("reject_first_n", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 ORDER BY o_orderkey LIMIT 100""",
          ["o_totalprice"], ops=("P29", "T5"))
def q_reject_first(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return prep.reject_out_of_range(o, {"o_totalprice": (1000.0, 200000.0)}, 100, "o_orderkey")


@register("range_counts", fx.cte("feat") + """, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 30
  AND l_discount BETWEEN 0.02 AND 0.08) AS k FROM feat) SELECT k AS n_kept, n - k AS n_rejected FROM c""", ops=("P29",))
def q_range_counts(spark, d):
    return prep.range_counts(fx.view(spark, d, "feat"), RANGE)


@register("valid_rows_first_n", """SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part ORDER BY p_partkey LIMIT 50""", ops=("P28",))
def q_valid_first(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"))
    return prep.valid_rows(p, ["p_size"], 50, "p_partkey")


def _piece(i: int, col: str) -> str:
    return f"{{'h': {portable_hash_sql('p_partkey', 11 + i)}, 'i': {i}, 'piece': '{col} is ' || CAST({col} AS VARCHAR)}}"


@register("row_to_text_shuffled", "SELECT p_partkey, array_to_string(list_transform(list_sort(["
          + ", ".join(_piece(i, c) for i, c in enumerate(["p_brand", "p_type", "p_size"]))
          + "]), lambda x: x.piece), ', ') AS text FROM part", ops=("P26",))
def q_text_shuffled(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return prep.row_to_text(p, ["p_brand", "p_type", "p_size"], shuffle_seed=11, key="p_partkey").select("p_partkey", "text")


@register("resplit", f"""WITH t AS (SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {portable_hash_sql('o_orderkey', 7)}, o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM t WHERE split <> 'test')
SELECT o_orderkey, CASE WHEN rn <= round(n * 0.25) THEN 'val' ELSE 'train' END AS split FROM k
UNION ALL SELECT o_orderkey, split FROM t WHERE split = 'test'""", ops=("X4",))
def q_resplit(spark, d):
    o = fx.table(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority", "CASE o_orderkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split")
    return prep.resplit(o, 0.25, "o_orderkey", "o_orderpriority", 7).select("o_orderkey", "split")


@register("union_splits", """SELECT split, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS custkeys FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, o_custkey FROM orders) GROUP BY split""", ops=("U2",))
def q_union_splits(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    train, test = (o.where(cond).withColumn("split", F.lit(name)) for name, cond in (("train", "o_orderkey % 3 <> 0"), ("test", "o_orderkey % 3 = 0")))
    return prep.union_splits(train, test).groupBy("split").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custkeys"))


@register("stack_runs", """SELECT CAST(l_suppkey % 3 AS INTEGER) AS run_id, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY 1""", ["top"], ops=("U7",))
def q_stack_runs(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    runs = [li.where(F.col("l_suppkey") % 3 == i) for i in range(3)]
    return prep.stack_runs(runs).groupBy("run_id").agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"))


@register("split_label", """SELECT count(o_orderpriority) AS n_labels, count(DISTINCT o_orderpriority) AS n_classes, 5 AS n_features FROM orders""", ops=("P4",))
def q_split_label(spark, d):
    x, y = prep.split_label(fx.table(spark, d, "orders"), " O_ORDERPRIORITY ")
    return y.agg(F.count("o_orderpriority").alias("n_labels"), F.countDistinct("o_orderpriority").alias("n_classes")).withColumn(
        "n_features", F.lit(len(x.columns)))


@register("describe_shape", "SELECT count(*) AS n_rows, 6 AS n_columns FROM part", ops=("T6",))
def q_describe(spark, d):
    p = fx.table(spark, d, "part")
    return p.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(p.columns)))


@register("quantile_normal", ops=("E3", "F4"))
def q_qnormal(spark, d):
    r, s = fx.pair(spark, d)
    grid = encode.quantile_grid(r.select("l_extendedprice"), ["l_extendedprice"])
    return encode.quantile_normal(s.select("l_extendedprice"), grid)
