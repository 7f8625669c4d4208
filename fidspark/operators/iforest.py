"""Isolation forest (M15, M16) on Spark.

Fit: every tree needs ``psi = min(256, n)`` rows drawn without replacement.
One pass assigns rows to trees by disjoint intervals of a per-row hash
(m = ceil(T * p) hashes with inclusion probability p), so the data is never
replicated per tree; each tree keeps its psi smallest draws (a window over
~1.25 psi rows) and is grown by ``groupBy('tree').applyInPandas``.  The
forest (T x (2 psi - 1) nodes at most) is collected and broadcast; scoring
runs in ``mapInPandas`` with vectorised traversal.

Scores follow the published definition: s(x) = 2^(-E[h(x)] / c(psi)),
score_samples = -s, offset = the ``contamination`` percentile of training
scores, decision = score_samples - offset, outlier when decision < 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidspark.session import ensure_parallel, one_row

EULER = 0.5772156649015329
DEALT = 10_000  # copies of a row that one task deals out at a time


def c_factor(n):
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


@dataclass
class Forest:
    cols: list[str]
    psi: int
    trees: dict  # arrays: feature, threshold, left, right, size (n_trees x max_nodes)
    offset: float | None = None


def _uniform(key, seed: int):
    return F.pmod(F.xxhash64(key, F.lit(int(seed))), F.lit(1 << 30)) / float(1 << 30)


def _grow(cols: Sequence[str], psi: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        X = pdf[list(cols)].to_numpy(dtype=np.float64)
        rng = np.random.default_rng([seed, t])
        feat, thr, left, right, size = [], [], [], [], []
        stack = [(np.arange(len(X)), 0, -1, 0)]  # (rows, depth, parent, side)
        while stack:
            rows, depth, parent, side = stack.pop()
            node = len(feat)
            feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(rows))
            if parent >= 0:
                (left if side == 0 else right)[parent] = node
            if len(rows) <= 1 or depth >= max_depth:
                continue
            sub = X[rows]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.flatnonzero(hi > lo)
            if cand.size == 0:
                continue
            f = int(rng.choice(cand))
            v = float(rng.uniform(lo[f], hi[f]))
            feat[node], thr[node] = f, v
            go_left = sub[:, f] < v
            stack.append((rows[~go_left], depth + 1, node, 1))
            stack.append((rows[go_left], depth + 1, node, 0))
        return pd.DataFrame({"tree": t, "node": np.arange(len(feat), dtype=np.int32), "feature": np.array(feat, np.int32),
                             "threshold": np.array(thr), "left": np.array(left, np.int32),
                             "right": np.array(right, np.int32), "size": np.array(size, np.int32)})

    return grow


def _copies_apart(x: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``x`` with a ``_key``: the hash of the row's values and its number among equal rows.

    Equal rows must not all draw the same trees, and a row's draws must not
    depend on how files are split, so equal rows are counted and their copies
    dealt out again, DEALT at a time, which spreads a row that is a third of
    the table over tasks.
    """
    counted = x.groupBy(*cols).agg(F.count("*").alias("_copies"))
    lots = counted.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / DEALT)))).repartition(*cols, "_lot")
    first, last = F.col("_lot") * DEALT, F.least((F.col("_lot") + 1) * DEALT, F.col("_copies")) - 1
    return lots.select(*cols, F.explode(F.sequence(first, last)).alias("_copy")).select(*cols, F.xxhash64(*cols, "_copy").alias("_key"))


def fit(df: DataFrame, cols: Sequence[str], n_trees: int = 300, max_samples: int = 256, seed: int = 42,
        key: str | None = None, contamination: float | None = 0.05) -> Forest:
    cols = list(cols)
    x = df.select(*([] if key is None else [F.col(key).alias("_key")]), *[F.col(c).cast("double").alias(c) for c in cols])
    n = x.count()
    x = _copies_apart(x, cols) if key is None else x
    psi = int(min(max_samples, n))
    p = min(1.0, 1.25 * psi / max(n, 1))
    per_hash = max(1, int(1.0 // p))
    m = int(math.ceil(n_trees / per_hash))
    draws = []
    for j in range(m):
        u = _uniform(F.col("_key"), seed * 7919 + j)
        slot = F.floor(u / F.lit(p)).cast("int")
        tree = F.lit(j * per_hash) + slot
        draws.append(F.when((slot < per_hash) & (tree < n_trees), F.struct(tree.alias("tree"), u.alias("u"))))
    ex = x.select(*cols, "_key", F.explode(F.filter(F.array(*draws), lambda s: s.isNotNull())).alias("_d"))
    ex = ex.select(*cols, "_key", "_d.tree", "_d.u")
    # ~1.25 psi candidate rows per tree; keep the psi smallest draws (ties by key)
    w = Window.partitionBy("tree").orderBy("u", "_key")
    sample = ex.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= psi).drop("_rn", "u", "_key")
    schema = "tree int, node int, feature int, threshold double, left int, right int, size int"
    nodes = sample.groupBy("tree").applyInPandas(_grow(cols, psi, seed), schema).toPandas()  # T x <= 2 psi nodes
    trees = _pack(nodes, n_trees)
    forest = Forest(cols, psi, trees)
    if contamination is not None:
        forest.offset = offset(forest, df, contamination)
    return forest


def _pack(nodes: pd.DataFrame, n_trees: int) -> dict:
    width = int(nodes["node"].max()) + 1 if len(nodes) else 1
    out = {k: np.full((n_trees, width), -1 if k != "threshold" else 0.0,
                      dtype=np.float64 if k == "threshold" else np.int32)
           for k in ("feature", "threshold", "left", "right", "size")}
    for k in out:
        out[k][nodes["tree"].to_numpy(), nodes["node"].to_numpy()] = nodes[k].to_numpy()
    present = np.zeros(n_trees, dtype=bool)
    present[nodes["tree"].unique()] = True
    out["present"] = present
    return out


def _laid_out(tr: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per tree (feature, threshold, right, path length, depth), nodes by level and a left child just before the right one.

    So one step is ``right[node] - (x < threshold[node])``. A leaf steps to itself: nothing is below its threshold.
    """
    out = []
    for t in np.flatnonzero(tr["present"]):
        feature, threshold, left, right, size = (tr[k][t] for k in ("feature", "threshold", "left", "right", "size"))
        levels, depth = [np.array([0])], [np.zeros(1)]
        while True:
            inner = levels[-1][feature[levels[-1]] >= 0]
            if not len(inner):
                break
            levels.append(np.stack([left[inner], right[inner]], axis=1).ravel())
            depth.append(np.full(len(levels[-1]), float(len(levels) - 1)))
        old, depth = np.concatenate(levels), np.concatenate(depth)
        leaf = feature[old] < 0
        to = np.arange(len(old), dtype=np.int64)
        to[~leaf] = 2 * np.arange(1, (~leaf).sum() + 1)  # children stand in the order of their parents
        out.append((np.where(leaf, 0, feature[old]).astype(np.int64), np.where(leaf, -np.inf, threshold[old]), to,
                    depth + c_factor(size[old]), len(levels) - 1))
    return out


STEP_ROWS = 16_384  # rows that go down the trees together, so that their arrays stay in the processor's cache


def _path_lengths(X: np.ndarray, trees: list) -> np.ndarray:
    """Mean path length of each row over trees that :func:`_laid_out` gives."""
    total, d = np.zeros(len(X)), X.shape[1]
    for lo in range(0, len(X), STEP_ROWS):
        flat, columns = np.ascontiguousarray(X[lo:lo + STEP_ROWS]).ravel(), np.ascontiguousarray(X[lo:lo + STEP_ROWS].T)
        n = len(flat) // d
        first, at, x, cut, node, own = np.arange(n) * d, np.empty(n, np.int64), np.empty(n), np.empty(n), np.empty(n, np.int64), total[lo:lo + n]
        for feature, threshold, right, length, depth in trees:
            np.subtract(right[0], columns[feature[0]] < threshold[0], out=node)  # all rows are at the root
            for _ in range(1, depth):
                np.take(feature, node, out=at, mode="clip")
                np.add(at, first, out=at)
                np.take(flat, at, out=x, mode="clip")
                np.take(threshold, node, out=cut, mode="clip")
                np.take(right, node, out=at, mode="clip")
                np.subtract(at, x < cut, out=node)
            own += length[node]
    return total / max(len(trees), 1)


def score_samples(forest: Forest, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., score) with score = -2^(-E[h]/c(psi)) (higher = more normal), plus ``decision``."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(forest.trees)
    cols, psi = forest.cols, forest.psi
    cpsi = float(c_factor(np.array([psi]))[0]) or 1.0
    off = forest.offset

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = _laid_out(bc.value)
        for pdf in it:
            if pdf.empty:
                continue
            X = pdf[list(cols)].to_numpy(dtype=np.float64)
            h = _path_lengths(X, trees)
            s = -np.power(2.0, -h / cpsi)
            out = pdf[list(keep)].copy() if keep else pd.DataFrame(index=pdf.index)
            out["score"] = s
            out["decision"] = s - (off if off is not None else 0.0)
            yield out

    x = ensure_parallel(df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols if c not in keep]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
                       + ["score double", "decision double"])
    return x.mapInPandas(run, schema)


def offset(forest: Forest, df: DataFrame, contamination: float) -> float:
    """Exact ``contamination`` percentile (linear) of the training scores."""
    scored = score_samples(Forest(forest.cols, forest.psi, forest.trees, None), df)
    return score_offset(scored.groupBy("score").agg(F.count("*").alias("n")), contamination)


def score_offset(counts: DataFrame, contamination: float) -> float:
    """Exact ``contamination`` percentile (linear) of scores that occur ``n`` times each."""
    from fidspark.operators import cdf

    values = counts.select(F.lit("s").alias("feature"), F.col("score").alias("value"), F.col("n").alias("n_r"))
    pre = cdf.prefix_sums(values, ["feature"], "value", ["n_r"])
    return cdf.quantiles(pre, [contamination], sides=["n_r"]).first()["q"]


def outlier_gap(r: DataFrame, s: DataFrame, cols: Sequence[str], n_trees: int = 300, seed: int = 42,
                contamination: float = 0.05, key: str | None = None) -> DataFrame:
    """Forest fitted on real; outlier rates, mean decision per side and the rate gap.

    Both sides are scored once and counted by score, which holds all that the offset and the rates need.
    """
    forest = fit(r, cols, n_trees, seed=seed, key=key, contamination=None)
    sides = r.select(*cols, F.lit("real").alias("side")).unionByName(s.select(*cols, F.lit("synthetic").alias("side")))
    counts = score_samples(forest, sides, keep=["side"]).groupBy("side", "score").agg(F.count("*").alias("n")).persist()
    cut = score_offset(counts.where("side = 'real'"), contamination)
    decision = F.col("score") - F.lit(cut)

    def side(name: str, value):
        own = F.col("side") == name
        return F.try_divide(F.sum(F.when(own, value * F.col("n"))), F.sum(F.when(own, F.col("n"))))

    st = counts.agg(*[side(x, (decision < 0).cast("double")).alias(f"{x}_iforest_outlier_rate") for x in ("real", "synthetic")],
                    *[side(x, decision).alias(f"{x}_iforest_score_mean") for x in ("real", "synthetic")]).first()
    counts.unpersist()
    out = r.sparkSession.createDataFrame([tuple(st)], ", ".join(f"{c} double" for c in st.asDict()))
    return out.withColumn("iforest_outlier_rate_gap",
                          F.abs(F.col("real_iforest_outlier_rate") - F.col("synthetic_iforest_outlier_rate")))


def outlier_utility(r: DataFrame, s: DataFrame, cols: Sequence[str], key: str, n_trees: int = 300,
                    seed: int = 42) -> DataFrame:
    """Forest on real labels real outliers; forest on synthetic scores real rows; top-k flag
    (k = round(rate * n)); recall, precision, F1, AUPRC and its improvement over the real forest."""
    from fidspark.operators import scores

    ref = fit(r, cols, n_trees, seed=seed, key=key)
    ref_s = score_samples(ref, r, keep=[key]).select(key, (F.col("decision") < 0).cast("int").alias("y_true"),
                                                      (-F.col("decision")).alias("ref_score"))
    rate = ref_s.agg(F.avg("y_true")).first()[0] or 0.0
    syn = fit(s, cols, n_trees, seed=seed, contamination=None, key=key if key in s.columns else None)
    syn_s = score_samples(syn, r, keep=[key]).select(key, (-F.col("decision")).alias("syn_score"))
    j = ref_s.join(syn_s, key).persist()  # released below
    n = j.count()
    k = int(max(1, round(rate * n)))
    flagged = scores.top_k_flag(j, "syn_score", k, out="y_pred")
    rep = scores.classification_report(flagged, "y_true", "y_pred", positive="1").select(
        F.col("recall_pos").alias("outlier_recall"), F.col("precision_pos").alias("outlier_precision"),
        F.col("f1_pos").alias("outlier_affiliation_f1_proxy")).withColumn("_k", F.lit(1))
    ap = scores.average_precision(j, "y_true", "syn_score").withColumnRenamed("average_precision", "outlier_auc_pr")
    ap_ref = scores.average_precision(j, "y_true", "ref_score").withColumnRenamed("average_precision", "ref_auc_pr")
    a = ap.withColumn("_k", F.lit(1)).join(ap_ref.withColumn("_k", F.lit(1)), "_k")
    out = one_row(rep.join(a, "_k").select(
        "outlier_recall", "outlier_precision", "outlier_affiliation_f1_proxy", "outlier_auc_pr",
        (F.col("outlier_auc_pr") - F.col("ref_auc_pr")).alias("outlier_auc_pr_improvement_vs_real_reference")))
    j.unpersist()
    return out
