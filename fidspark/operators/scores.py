"""Metrics from labels and scores.

Confusion counts come from one ``groupBy(label, prediction)``; ranking
metrics (AUROC, average precision, k-th largest score) use the CDF core over
distinct scores, so they are exact and no task sees all rows of one score.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidspark.operators import cdf
from fidspark.session import kept


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(class, support, tp, fp, fn, precision, recall, f1) with 0 on zero division."""
    c = confusion(df, label, pred)
    yc = c.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"),
                                                 F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    pc = c.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    t = yc.join(pc, "cls", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return t.select("cls", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"),
                    (F.col("support") - F.col("tp")).alias("fn"), prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"))


def classification_report(df: DataFrame, label: str, pred: str, positive: str | None = None) -> DataFrame:
    """One row: accuracy, macro/weighted/micro F1, (binary precision/recall/F1 for ``positive``)."""
    # macro averages run over the union of labels and predictions; a class without support weighs 0 elsewhere
    share = F.sum("tp") / F.sum("support")
    out = [share.alias("accuracy"), F.avg("f1").alias("f1_macro"),
           (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"), share.alias("f1_micro")]
    if positive is not None:
        out += [F.max(F.when(F.col("cls") == str(positive), F.col(c))).alias(f"{c}_pos") for c in ("precision", "recall", "f1")]
    return per_class(df, label, pred).agg(*out)


def inverse_weighted_f1(df: DataFrame, label: str, pred: str) -> DataFrame:
    """M9: sum_c F1_c (1 - share_c) / (K - 1) over the classes present in ``label``."""
    pc = per_class(df, label, pred).where(F.col("support") > 0)
    w = Window.partitionBy()  # one row per class
    t = pc.select("f1", (F.col("support") / F.sum("support").over(w)).alias("share"), F.count(F.lit(1)).over(w).alias("k"))
    return t.agg(F.try_divide(F.sum(F.col("f1") * (1 - F.col("share"))), F.first("k") - 1).alias("inverse_weighted_f1"))


def auroc(df: DataFrame, label: str, score: str, positive=1, copies: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact AUROC with ties averaged (rank-sum over distinct scores); ``copies``: rows one row stands for; one row
    per group of ``by``, all in one pass."""
    y = (F.col(label).cast("string") == str(positive))
    n = F.lit(1).cast("long") if copies is None else F.col(copies).cast("long")
    counts = kept(df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.sum(n).alias("n_all"), F.sum(F.when(y, n).otherwise(0)).alias("npos")), "scores")
    rank = F.col("cum_n_all") - (F.col("n_all") - 1) / 2.0
    t = cdf.prefix_sums(counts, by, "s", ["n_all", "npos"]).table.groupBy(*by).agg(
        F.sum(rank * F.col("npos")).alias("rs"), F.sum("npos").alias("p"), F.sum("n_all").alias("n"))
    p, n = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return t.select(*by, F.try_divide(F.col("rs") - p * (p + 1) / 2, p * n).alias("auroc"))


def auroc_ovr(df: DataFrame, label: str, prob_cols: dict[str, str]) -> DataFrame:
    """M11 one-vs-rest macro: mean over classes of AUROC(label == c, prob_c)."""
    y = F.col(label).cast("string")
    per = [F.struct(F.lit(c).alias("cls"), F.col(col).cast("double").alias("s"), (y == c).cast("int").alias("hit")) for c, col in prob_cols.items()]
    long = df.select(F.explode(F.array(*per)).alias("_c")).select("_c.*")  # all classes in one pass
    return auroc(long, "hit", "s", by=["cls"]).agg(F.avg("auroc").alias("auroc_ovr_macro"))


def average_precision(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Sum over distinct thresholds (descending) of delta-recall x precision."""
    y = (F.col(label).cast("string") == str(positive))
    counts = df.groupBy((-F.col(score).cast("double")).alias("neg_s")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("npos"))
    pre = cdf.prefix_sums(counts, [], "neg_s", ["n", "npos"])
    t = pre.table
    return t.agg(F.try_divide(F.sum(F.col("npos") * F.col("cum_npos") / F.col("cum_n")), F.sum("npos"))
                 .alias("average_precision"))


def regression_report(df: DataFrame, label: str, pred: str, scale: float = 1.0) -> DataFrame:
    """Rmse (x scale), mae, mape, r2, explained variance."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    e = y - p
    return df.agg(
        (F.sqrt(F.avg(e * e)) * scale).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))).alias("mape"),
        (1 - F.avg(e * e) / F.var_pop(y)).alias("r2"),
        (1 - F.var_pop(e) / F.var_pop(y)).alias("explained_variance"),
    )


def sigmoid_labels(c: str) -> "F.Column":
    """1/(1+exp(-x)) rounded to a 0/1 label."""
    return F.round(1.0 / (1.0 + F.exp(-F.col(c)))).cast("int")


def softmax_argmax(arr: str) -> "F.Column":
    """Arg-max of softmax == arg-max of the logits (0-based, first max)."""
    return (F.array_position(F.col(arr), F.array_max(F.col(arr))) - 1).cast("int")


def kth_largest(df: DataFrame, score: str, k: int) -> DataFrame:
    """T2 threshold: exact k-th largest score via counts + prefix sums (k may be large)."""
    counts = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    pre = cdf.prefix_sums(counts.withColumn("_g", F.lit(0)), ["_g"], "s", ["n"])
    # ascending 0-based index n_total - k
    t = pre.table
    return t.where((F.col("tot_n") - k >= F.col("cum_n") - F.col("n")) & (F.col("tot_n") - k < F.col("cum_n"))).select(
        F.col("s").alias("threshold"))


def top_k_flag(df: DataFrame, score: str, k: int, out: str = "flag") -> DataFrame:
    """flag = score >= k-th largest score (ties may exceed k)."""
    th = kth_largest(df, score, k).withColumn("_k", F.lit(1))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(th), "_k").select(
        *df.columns, (F.col(score) >= F.col("threshold")).cast("int").alias(out))


def best_by(df: DataFrame, group: str, param: str, score: str, maximize: bool = True) -> DataFrame:
    """T4: best parameter per criterion (ties -> max_by/min_by pick one)."""
    agg = F.max_by(param, score) if maximize else F.min_by(param, score)
    best = F.max(score) if maximize else F.min(score)
    return df.groupBy(group).agg(agg.alias("best_param"), best.alias("best_score"))


def signed_score(reports: DataFrame) -> DataFrame:
    """-rmse for regression, accuracy otherwise."""
    return reports.select("*", F.when(F.col("task") == "regression", -F.col("rmse")).otherwise(F.col("accuracy"))
                          .alias("signed_score"))
