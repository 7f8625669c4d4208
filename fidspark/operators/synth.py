"""Table-level synthesis and imputation.

Draws are hash-uniforms of (draw id, seed), so they are reproducible and
independent of partitioning.  A draw meets the cumulative shares it falls
between by an equality join on a cell of [0, 1); nothing is broadcast by force.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidspark.functions import hash_uniform
from fidspark.operators import nn


def condition_probabilities(df: DataFrame, cats: Sequence[str], log: bool = True) -> DataFrame:
    """(column_idx, feature, value, prob, cum_lo, cum_hi): within each column, prob ~ ln(count+1)
    (training) or ~ count (generation); values ordered by string."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cats]).unpivot([], list(cats), "feature", "value")
    cnt = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    idx = {c: i for i, c in enumerate(cats)}
    cidx = F.create_map(*[x for c in cats for x in (F.lit(c), F.lit(idx[c]))])[F.col("feature")]
    wgt = F.log(F.col("n") + 1.0) if log else F.col("n").cast("double")
    w = Window.partitionBy("feature")  # one partition per column over its categories
    t = cnt.select(cidx.alias("column_idx"), "feature", "value", (wgt / F.sum(wgt).over(w)).alias("prob"))
    wc = Window.partitionBy("feature").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return t.select("*", (F.sum("prob").over(wc) - F.col("prob")).alias("cum_lo"), F.when(
        F.lead("prob").over(Window.partitionBy("feature").orderBy(F.col("value").asc_nulls_first())).isNull(), F.lit(1.0)).otherwise(
        F.sum("prob").over(wc)).alias("cum_hi"))  # the last bound is 1, not a sum of rounded shares


CELLS = 4096  # equal cells of [0, 1) by which draws meet shares


def _draw(draws: DataFrame, u: str, shares: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Join each draw with the row of ``shares`` whose [cum_lo, cum_hi) holds its ``u`` (within equal ``on``)."""
    last = F.least(F.floor(F.col("cum_hi") * CELLS), F.lit(CELLS - 1))
    spread = shares.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("cum_lo") * CELLS), F.greatest(
        last, F.floor(F.col("cum_lo") * CELLS)))))  # at most one row per share and one per cell
    met = draws.withColumn("_cell", F.floor(F.col(u) * CELLS)).join(spread, [*on, "_cell"])
    return met.where((F.col(u) >= F.col("cum_lo")) & (F.col(u) < F.col("cum_hi"))).drop("_cell", "cum_lo", "cum_hi")


def sample_conditions(draws: DataFrame, key: str, probs: DataFrame, n_cols: int, seed: int = 0) -> DataFrame:
    """Per draw a column chosen uniformly, then a value by the column's cumulative probabilities."""
    d = draws.select(key, (F.floor(hash_uniform(key, seed) * n_cols)).cast("int").alias("column_idx"),
                     hash_uniform(key, seed + 1).alias("u"))
    shares = probs.select("column_idx", "feature", "value", "cum_lo", "cum_hi")
    return _draw(d, "u", shares, ["column_idx"]).select(key, "column_idx", "feature", "value")


def sample_matching(conditions: DataFrame, key: str, real: DataFrame, real_key: str, cats: Sequence[str],
                    seed: int = 0) -> DataFrame:
    """For each (feature, value) condition, a real row holding that value, uniformly with replacement. Null is a value."""
    from fidspark.operators import prep

    long = real.select(real_key, *[F.col(c).cast("string").alias(c) for c in cats]).unpivot(
        [real_key], list(cats), "feature", "value")
    sizes = long.groupBy("feature", F.col("value").alias("_value")).agg(F.count("*").alias("_n"))
    c = conditions.join(
        sizes.withColumnRenamed("feature", "_feature"), (F.col("feature") == F.col("_feature")) & F.col("value").eqNullSafe(F.col("_value")))
    c = c.select(key, "feature", "value", (F.floor(hash_uniform(key, seed + 2) * F.col("_n")) + 1).alias("_rn"))
    rows = prep.number_rows(long, ["feature", "value"], real_key).select(
        F.col("feature").alias("_feature"), F.col("value").alias("_value"), "rn", real_key)
    same = (F.col("feature") == F.col("_feature")) & F.col("value").eqNullSafe(F.col("_value")) & (F.col("_rn") == F.col("rn"))
    return c.join(rows, same).select(key, "feature", "value", real_key)


def sample_start(train: DataFrame, col: str, draws: DataFrame, key: str, kind: str = "cat", seed: int = 0) -> DataFrame:
    """(key, start): the text "<col> is <value>" each draw begins with.

    ``cat``: values weighted by their counts; ``num``: a value drawn from the
    rows with replacement, five decimals. Nulls in ``col`` are never drawn.
    """
    held = train.where(F.col(col).isNotNull())
    value = F.format_string("%.5f", F.col(col).cast("double")) if kind == "num" else F.col(col).cast("string")
    shares = condition_probabilities(held.select(value.alias(col)), [col], log=False).select("value", "cum_lo", "cum_hi")
    d = draws.select(key, hash_uniform(key, seed).alias("_u"))
    return _draw(d, "_u", shares).select(key, F.concat(F.lit(f"{col} is "), "value").alias("start"))


def sample_start_name(draws: DataFrame, key: str, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """(key, start): each draw begins with "<col> is " of a column chosen uniformly, where no distribution is known."""
    names = F.array(*[F.lit(f"{c} is ") for c in columns])
    pick = F.floor(hash_uniform(key, seed) * len(columns)).cast("int")
    return draws.select(key, F.get(names, pick).alias("start"))


def tail_band_penalty(r: DataFrame, s: DataFrame, cols: Sequence[str], q: float = 0.05) -> DataFrame:
    """Per feature real q/(1-q) quantiles; mean over synthetic rows of max(0, lo-x) + max(0, x-hi);
    also the mean over features."""
    from fidspark.operators.stats import NumericComparison

    nc = NumericComparison(r, s, cols)
    band = nc.real_quantiles([q, 1 - q])
    lo_c, hi_c = band.columns[1], band.columns[2]
    pen = F.greatest(F.col(lo_c) - F.col("value"), F.lit(0.0)) + F.greatest(F.col("value") - F.col(hi_c), F.lit(0.0))
    c = nc.counts.where(F.col("value").isNotNull()).join(band, "feature")
    return c.groupBy("feature").agg(F.try_divide(F.sum(pen * F.col("n_s")), F.sum("n_s")).alias("tail_penalty"))


def smote(df: DataFrame, key: str, label: str, cols: Sequence[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Per class, one synthetic row per real row: x + u (x_nn - x), nn a uniform pick among the
    k nearest rows of the same class (exact, self excluded). All classes are one join; a null label is a class.
    A class of one row has no neighbour and gives none."""
    nbr = nn.knn_within(df, key, label, nn.Space(num=cols), k)
    pick = F.floor(hash_uniform(F.col("q_key"), seed) * F.size("near")).cast("int")
    chosen = (nbr.groupBy("q_key").agg(F.sort_array(F.collect_list(F.struct("rank", "b_key"))).alias("near"))  # k a row
              .select(F.col("q_key").alias(key), F.get("near", pick)["b_key"].alias("_nn")))
    x = df.select(key, label, *cols)
    y = df.select(F.col(key).alias("_nn"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    u = hash_uniform(key, seed + 1)
    return x.join(chosen, key).join(y, "_nn").select(
        key, label, *[(F.col(c) + u * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in cols])


def smote_encoded(df: DataFrame, key: str, label: str, num: Sequence[str], cat: Sequence[str], k: int = 5, seed: int = 0,
                  n_quantiles: int | None = None) -> DataFrame:
    """X8 in encoded space: per class, one synthetic row per real row, with its own types back.

    Numbers are mapped to normal scores by their quantiles (E3) and categories
    to one-hot blocks; the neighbours are the k nearest of the class there. The
    new row lies u of the way to a neighbour; its numbers go back by the
    inverse map, so they stay within the column's range, and its blocks by
    their largest entry (E22), which is the neighbour's category beyond half
    way. Rows with a null number take part as the farthest neighbours and give
    nulls. A class of one row gives none.
    """
    from fidspark.operators import encode

    grid = encode.quantile_grid(df, num, n_quantiles)
    rows = encode.quantile_normal(df.select(key, label, *num, *cat), grid)
    near = nn.knn_within(rows, key, label, nn.Space(num=num, cat=cat), k)
    pick = F.floor(hash_uniform(F.col("q_key"), seed) * F.size("near")).cast("int")
    chosen = (near.groupBy("q_key").agg(F.sort_array(F.collect_list(F.struct("rank", "b_key"))).alias("near"))  # k a row
              .select(F.col("q_key").alias(key), F.get("near", pick)["b_key"].alias("_nn")))
    other = rows.select(F.col(key).alias("_nn"), *[F.col(c).alias(f"_n_{c}") for c in (*num, *cat)])
    u = hash_uniform(key, seed + 1)
    mixed = rows.join(chosen, key).join(other, "_nn").select(
        key, label, *[(F.col(c) + u * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in num],
        *[F.when(u > 0.5, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in cat])
    return encode.quantile_normal(mixed, grid, inverse=True)


def impute_baseline(train: DataFrame, test: DataFrame, col: str, kind: str, key: str, trials: int = 1,
                    seed: int = 0) -> DataFrame:
    """Numeric -> train mean; categorical -> a draw by train frequency per (row, trial)."""
    if kind == "num":
        m = train.agg(F.avg(col)).first()[0]
        return test.select(key, F.lit(0).alias("trial"), F.lit(m).alias(col))
    probs = condition_probabilities(train, [col], log=False)
    rows = test.select(key, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    rows = rows.withColumn("_u", hash_uniform(F.col(key) * trials + F.col("trial"), seed))
    return _draw(rows, "_u", probs.select("value", "cum_lo", "cum_hi")).select(key, "trial", F.col("value").alias(col))


def mask_column(df: DataFrame, col: str, n_categories: int) -> DataFrame:
    """Masked categorical column -> the reserved extra category K."""
    return df.withColumn(col, F.lit(n_categories))


def pool_imputations(trials: DataFrame, truth: DataFrame, key: str, value: str, categories: Sequence[str]) -> DataFrame:
    """M trials per row -> vote share per category (mean of one-hot), arg-max (first category on ties);
    micro F1 (= accuracy) and micro AUROC over all (row, category) pairs."""
    from fidspark.operators import scores

    m = trials.select("trial").distinct().count()  # number of trials
    cat_idx = F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i))])
    votes = trials.groupBy(key, value).agg((F.count(F.lit(1)) / m).alias("share"))
    best = votes.withColumn("_i", cat_idx[F.col(value)]).groupBy(key).agg(
        F.min_by(value, F.struct(-F.col("share"), F.col("_i"))).alias("pred"))
    acc = best.join(truth.select(key, F.col(value).alias("truth")), key).agg(
        F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("f1_micro")).withColumn("_k", F.lit(1))
    grid = truth.select(key, F.col(value).alias("truth"), F.explode(F.array(*[F.lit(c) for c in categories])).alias(value))
    pairs = grid.join(votes, [key, value], "left").select(
        (F.col(value) == F.col("truth")).cast("int").alias("y"), F.coalesce("share", F.lit(0.0)).alias("s"))
    auc = scores.auroc(pairs, "y", "s").withColumnRenamed("auroc", "auroc_micro").withColumn("_k", F.lit(1))
    return acc.join(auc, "_k").drop("_k")


def pool_numeric(trials: DataFrame, truth: DataFrame, key: str, value: str, lo: float = 1.0, hi: float = 20000.0) -> DataFrame:
    """I3 for a number: the mean of the trials' log-clipped values per row against the truth's; one row, rmse.
    Rows without a trial or a truth are left out."""
    from fidspark.operators import encode

    pooled = trials.select(key, encode.log_clip(value, lo, hi).alias("_x")).groupBy(key).agg(F.avg("_x").alias("_p"))
    both = pooled.join(truth.select(key, encode.log_clip(value, lo, hi).alias("_t")), key)
    return both.agg(F.sqrt(F.avg(F.pow(F.col("_p") - F.col("_t"), 2))).alias("rmse"))
