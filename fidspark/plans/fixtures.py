"""Fixture views over the driver tables (see FIXTURES.md, section B).

Each view is a list of SQL expressions over one base table.  Spark evaluates
them with ``selectExpr`` on the parquet scan (so Catalyst prunes columns and
pushes filters); the oracle uses the very same text as a DuckDB CTE.  Views
never drop rows: a side/split column assigns *every* row of the base table to
real, synthetic or holdout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# view name -> (base table, [(column, SQL expression)])
VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    # B1: numeric/categorical pair from lineitem (2-way split, synthetic perturbed)
    "feat": ("lineitem", [
        ("side", "CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'synthetic' END"),
        ("l_quantity", "CASE WHEN l_orderkey % 2 = 1 THEN l_quantity * 1.1 ELSE l_quantity END"),
        ("l_extendedprice", "l_extendedprice"),
        ("l_discount", "CASE WHEN l_orderkey % 2 = 1 THEN l_discount + 0.01 ELSE l_discount END"),
        ("l_tax", "CASE WHEN l_partkey % 20 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_tax END"),
        ("l_returnflag", "CASE WHEN l_partkey % 40 = 1 THEN '?' "
                         "WHEN l_orderkey % 2 = 1 AND l_partkey % 97 = 0 THEN 'X' ELSE l_returnflag END"),
        ("is_big", "CASE WHEN l_orderkey % 2 = 1 AND l_partkey % 50 = 0 THEN 2 "
                   "WHEN l_quantity > 25 THEN 1 ELSE 0 END"),
        ("l_linestatus", "l_linestatus"),
    ]),
    # B1 with a holdout (3-way split) for DCR-style metrics
    "feat3": ("lineitem", [
        ("split", "CASE l_orderkey % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'synthetic' ELSE 'holdout' END"),
        ("l_quantity", "CASE WHEN l_orderkey % 3 = 1 THEN l_quantity * 1.1 ELSE l_quantity END"),
        ("l_extendedprice", "l_extendedprice"),
        ("l_discount", "CASE WHEN l_orderkey % 3 = 1 THEN l_discount + 0.01 ELSE l_discount END"),
        ("l_tax", "l_tax"),
        ("l_returnflag", "l_returnflag"),
        ("l_linestatus", "l_linestatus"),
    ]),
    # B2: nearest-neighbour pair/triple over part (key unique)
    "near": ("part", [
        ("p_partkey", "p_partkey"),
        ("side", "CASE WHEN p_partkey % 2 = 0 THEN 'real' ELSE 'synthetic' END"),
        ("split", "CASE p_partkey % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'synthetic' ELSE 'holdout' END"),
        ("p_size", "CAST(p_size AS DOUBLE)"),
        ("p_retailprice", "p_retailprice"),
        ("p_type", "p_type"),
        ("p_brand", "p_brand"),
    ]),
    # vectors
    "vec": ("embeddings", [
        ("vec_id", "vec_id"),
        ("side", "CASE WHEN vec_id % 2 = 0 THEN 'real' ELSE 'synthetic' END"),
        ("embedding", "embedding"),
        ("label", "label"),
    ]),
    # Several synthetic runs (lineitem, run id from the supplier)
    "runs": ("lineitem", [
        ("run_id", "CAST(l_suppkey % 3 AS INT)"),
        ("side", "CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'synthetic' END"),
        ("l_quantity", "CASE WHEN l_orderkey % 2 = 1 THEN l_quantity * (1.0 + 0.05 * (l_suppkey % 3)) "
                       "ELSE l_quantity END"),
        ("l_discount", "l_discount"),
        ("l_linestatus", "l_linestatus"),
    ]),
    # Labels and scores without a model
    "scored": ("orders", [
        ("o_orderkey", "o_orderkey"),
        ("label", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"),
        ("score", "CAST(o_custkey * 7919 % 1000 AS DOUBLE) / 1000.0"),
        ("prediction", "CASE WHEN CAST(o_custkey * 7919 % 1000 AS DOUBLE) / 1000.0 >= 0.5 THEN 1 ELSE 0 END"),
        ("mlabel", "o_orderpriority"),
        ("mpred", "CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' "
                  "WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END"),
        ("o_totalprice", "o_totalprice"),
        ("pred_price", "o_totalprice * (0.9 + CAST(o_custkey % 21 AS DOUBLE) / 100.0)"),
    ]),
    # Imputation trials and a one-hot group over events
    "ev": ("events", [
        ("event_id", "event_id"),
        ("user_id", "user_id"),
        ("event_type", "event_type"),
        ("value", "value"),
        ("is_view", "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END"),
        ("is_click", "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END"),
        ("is_signup", "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END"),
        ("is_error", "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"),
        ("is_purchase", "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END"),
    ]),
}

# Category order of the events one-hot group and of the trials.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, cols = VIEWS[name]
    return table(spark, sf_dir, base).selectExpr(*[f"{expr} AS {col}" for col, expr in cols])


def cte(*names: str) -> str:
    """``WITH`` clause defining the given views for DuckDB."""
    parts = []
    for name in names:
        base, cols = VIEWS[name]
        sel = ", ".join(f"{expr} AS {col}" for col, expr in cols)
        parts.append(f"{name} AS (SELECT {sel} FROM {base})")
    return "WITH " + ",\n".join(parts) + "\n"


def pair(spark: SparkSession, sf_dir: str, name: str = "feat", side: str = "side") -> tuple[DataFrame, DataFrame]:
    """(real, synthetic) frames of a view, without the side column."""
    v = view(spark, sf_dir, name)
    drop = [c for c in ("side", "split") if c in v.columns]
    return (v.where(f"{side} = 'real'").drop(*drop), v.where(f"{side} = 'synthetic'").drop(*drop))


def triple(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = view(spark, sf_dir, name)
    drop = [c for c in ("side", "split") if c in v.columns]
    return tuple(v.where(f"split = '{k}'").drop(*drop) for k in ("real", "synthetic", "holdout"))  # type: ignore[return-value]


FEAT_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "is_big"]
FEAT_CAT = ["l_returnflag"]
FEAT_LABEL = "l_linestatus"
