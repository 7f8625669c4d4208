"""CDF core: value counts, skew-safe prefix sums, exact quantiles, KS, W1, ranks.

Design (scale): a feature is first collapsed to one row per distinct value
(``groupBy(feature, value)`` with map-side partial aggregation), so a hot value
holding a third of all rows becomes a single row.  Running sums are then taken
per *(feature, value bucket)*: bucket bounds come from ``percentile_approx``
over the distinct values (bounded memory), so no window partition ever holds a
whole feature.  Bucket totals (#features x #buckets rows, a proven bound) give
the offsets that turn local sums into global ones; that small table is the only
thing broadcast.  Everything is exact; only the *balance* of buckets is
approximate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidspark.session import default_buckets


def long_form(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``cols`` into (ids..., feature, value double)."""
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return cast.unpivot(list(ids), list(cols), "feature", "value")


def two_sided_counts(r: DataFrame, s: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, n_r, n_s): counts per distinct value on both sides, nulls kept as a value."""
    lr = long_form(r, cols).withColumn("_side", F.lit(0))
    ls = long_form(s, cols).withColumn("_side", F.lit(1))
    return lr.unionByName(ls).groupBy("feature", "value").agg(
        F.count_if(F.col("_side") == 0).alias("n_r"),
        F.count_if(F.col("_side") == 1).alias("n_s"),
    )


def value_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), n: str = "n") -> DataFrame:
    """(keys..., value double, n, feature): counts per distinct value, null being one; each column is counted on its own."""
    return reduce(DataFrame.unionByName, [
        df.groupBy(*keys, F.col(c).cast("double").alias("value")).agg(F.count(F.lit(1)).alias(n)).withColumn("feature", F.lit(c)) for c in cols])


@dataclass
class Prefix:
    """Result of :func:`prefix_sums`.

    ``table``: input rows (non-null order values) plus ``cum_<s>`` (inclusive
    running sum) and ``next_value`` (next distinct order value within the keys).
    ``totals``: one row per key group with ``tot_<s>`` -- small.
    """

    table: DataFrame
    totals: DataFrame


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    buckets: int | None = None,
) -> Prefix:
    """Inclusive running sums of ``sums`` ordered by ``order`` within ``keys``.

    ``order`` must be unique within ``keys`` (pre-aggregate ties first).
    """
    keys = list(keys)
    if not keys:
        df = df.withColumn("_g", F.lit(0))
        keys = ["_g"]
    nb = buckets or default_buckets(df.sparkSession)
    # every branch below reads the same columns of df, so that its shuffle is run once
    fracs = [i / nb for i in range(1, nb)]
    bounds = df.where(F.col(order).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(F.col(order).cast("double"), fracs, 10000).alias("_bounds") if fracs else F.array().cast("array<double>").alias("_bounds"),
        *[F.sum(s).alias(f"tot_{s}") for s in sums])
    # bounds: one row per key group, nb-1 doubles each -> safe to broadcast
    base = _with_bucket(df.where(F.col(order).isNotNull()).join(F.broadcast(bounds), keys), order, nb - 1)

    w = Window.partitionBy(*keys, "_bucket").orderBy(order)
    wcum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.select(
        *df.columns, "_bucket", *[f"tot_{s}" for s in sums],
        *[F.sum(s).over(wcum).alias(f"_l_{s}") for s in sums],
        F.lead(order).over(w).alias("_lnext"),
    )
    bstats = base.groupBy(*keys, "_bucket").agg(
        *[F.sum(s).alias(f"_b_{s}") for s in sums], F.min(order).alias("_bfirst")
    )
    wb = Window.partitionBy(*keys).orderBy("_bucket")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    offs = bstats.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_b_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        F.first("_bfirst").over(wb.rowsBetween(1, Window.unboundedFollowing)).alias("_nfirst"),
    )
    # offs: #key groups x #buckets rows -> safe to broadcast
    out = local.join(F.broadcast(offs), [*keys, "_bucket"]).select(
        *[c for c in df.columns],
        *[(F.col(f"_l_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"tot_{s}") for s in sums],
        F.coalesce(F.col("_lnext"), F.col("_nfirst")).alias("next_value"),
    )
    return Prefix(out, bounds.drop("_bounds"))


def _with_bucket(df: DataFrame, order: str, n_bounds: int) -> DataFrame:
    """``df`` with _bucket, the number of its ``n_bounds`` rising ``_bounds`` below ``order``, by binary search; without _bounds."""
    df = df.withColumn("_bucket", F.lit(0))
    step = 1 << max(0, n_bounds.bit_length() - 1)
    while n_bounds and step:
        ahead = F.col("_bucket") + F.lit(step)
        below = (ahead <= n_bounds) & (F.get("_bounds", ahead - 1) < F.col(order))
        df = df.withColumn("_bucket", F.when(below, ahead).otherwise(F.col("_bucket")))
        step >>= 1
    return df.drop("_bounds")


def two_sided_cdf(r: DataFrame, s: DataFrame, cols: Sequence[str], buckets: int | None = None) -> Prefix:
    """Empirical CDFs of both sides per feature (W1): cum_n_r / tot_n_r etc."""
    counts = two_sided_counts(r, s, cols)
    return prefix_sums(counts, ["feature"], "value", ["n_r", "n_s"], buckets)


def quantiles(
    pre: Prefix,
    probs: Sequence[float],
    sides: Sequence[str] = ("n_r", "n_s"),
    keys: Sequence[str] = ("feature",),
    order: str = "value",
) -> DataFrame:
    """Exact quantiles with linear interpolation ((n-1)p, as pandas/``percentile``).

    Returns (keys..., side, p, q) with side the count-column name.
    """
    keys = list(keys)
    prob_arr = F.array(*[F.lit(float(p)) for p in probs])
    targets = None
    for sname in sides:
        tot = F.col(f"tot_{sname}")
        t = pre.totals.select(*keys, F.lit(sname).alias("side"), tot.alias("_tot")).where(F.col("_tot") > 0)
        t = t.select("*", F.explode(prob_arr).alias("p"))
        h = (F.col("_tot") - 1) * F.col("p")
        t = t.select(
            *keys, "side", "p",
            (h - F.floor(h)).alias("frac"),
            F.floor(h).cast("long").alias("_lo"),
            F.least(F.floor(h).cast("long") + 1, F.col("_tot") - 1).alias("_hi"),
        )
        t = t.select(*keys, "side", "p", "frac",
                     F.explode(F.array(
                         F.struct(F.lit("lo").alias("which"), F.col("_lo").alias("idx")),
                         F.struct(F.lit("hi").alias("which"), F.col("_hi").alias("idx")),
                     )).alias("_t")).select(*keys, "side", "p", "frac", "_t.which", "_t.idx")
        targets = t if targets is None else targets.unionByName(t)
    tab = pre.table.alias("c")
    tg = F.broadcast(targets).alias("t")  # features x sides x probs x 2 rows
    cond = [F.col(f"c.{k}") == F.col(f"t.{k}") for k in keys]
    inside = None
    for sname in sides:
        cum, n = F.col(f"c.cum_{sname}"), F.col(f"c.{sname}")
        here = (F.col("t.side") == sname) & (cum - n <= F.col("t.idx")) & (F.col("t.idx") < cum)
        inside = here if inside is None else inside | here
    hit = tab.join(tg, cond + [inside]).select(
        *[F.col(f"t.{k}").alias(k) for k in keys], "t.side", "t.p", "t.frac", "t.which", F.col(f"c.{order}").alias("v")
    )
    agg = hit.groupBy(*keys, "side", "p").agg(
        F.max(F.when(F.col("which") == "lo", F.col("v"))).alias("v_lo"),
        F.max(F.when(F.col("which") == "hi", F.col("v"))).alias("v_hi"),
        F.first("frac").alias("frac"),
    )
    return agg.select(
        *keys, "side", "p",
        (F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))).alias("q"),
    )


def ks_statistic(pre: Prefix) -> DataFrame:
    """(feature, ks_statistic, n_r, n_s): max |F_r - F_s| over distinct values (A5)."""
    t = pre.table
    d = F.abs(F.try_divide(t.cum_n_r, t.tot_n_r) - F.try_divide(t.cum_n_s, t.tot_n_s))
    return t.groupBy("feature").agg(
        F.max(d).alias("ks_statistic"),
        F.first("tot_n_r").alias("n_r"),
        F.first("tot_n_s").alias("n_s"),
    )


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample Kolmogorov p-value (Q_KS(sqrt(n1 n2/(n1+n2)) D))."""
    from fidspark.functions import kolmogorov_sf

    en = F.sqrt(n1 * n2 / (n1 + n2))
    return kolmogorov_sf(en * d)


def wasserstein(pre: Prefix, scale: DataFrame | None = None) -> DataFrame:
    """(feature, wd): sum over distinct values of |F_r - F_s| * gap to the next value.

    ``scale`` (feature, lo, width) divides the gap: W1 is linear in a min-max map.
    """
    t = pre.table
    gap = F.col("next_value") - F.col("value")
    if scale is not None:
        t = t.join(F.broadcast(scale), "feature")
        gap = gap / F.col("width")
    d = F.abs(F.try_divide(F.col("cum_n_r"), F.col("tot_n_r")) - F.try_divide(F.col("cum_n_s"), F.col("tot_n_s")))
    return t.groupBy("feature").agg(F.coalesce(F.sum(d * gap), F.lit(0.0)).alias("wd"))


def average_ranks(counts: DataFrame, keys: Sequence[str], order: str, n: str, buckets: int | None = None) -> DataFrame:
    """(keys..., order, avg_rank, n, tot_n): 1-based rank with ties averaged (W2), the value's count and the group's."""
    pre = prefix_sums(counts, keys, order, [n], buckets)
    t = pre.table
    return t.select(*keys, order, (F.col(f"cum_{n}") - (F.col(n) - 1) / 2.0).alias("avg_rank"), n, f"tot_{n}")


#: A value held by more than one in HOT_VALUES rows of its group is hot, so a group has fewer than HOT_VALUES of them.
HOT_VALUES = 200


def attach_ranks(long: DataFrame, ranks: DataFrame, keys: Sequence[str], order: str, n: str) -> DataFrame:
    """``long`` (keys, order, others) with avg_rank, from what ``average_ranks`` gives; null for a null value.

    Hot values, fewer than HOT_VALUES per group, go to the rows by broadcast,
    so rows that share one stay where they are; only rows of rarer values are
    shuffled to meet their rank.
    """
    on = [*keys, order]
    is_hot = F.col(n) * HOT_VALUES > F.col(f"tot_{n}")
    hot = F.broadcast(ranks.where(is_hot).select(*on, "avg_rank"))
    near = long.join(hot, on, "left")
    far = near.where(F.col("avg_rank").isNull() & F.col(order).isNotNull()).drop("avg_rank")
    cold = ranks.where(~is_hot).select(*on, "avg_rank")
    done = near.where(F.col("avg_rank").isNotNull() | F.col(order).isNull())
    return done.unionByName(far.join(cold, on))


#: Ranks of so many distinct values, at most, are brought to the rows whole.
SMALL_RANKS = 100_000


def rank_column(rows: DataFrame, column: str, ranks: DataFrame, keys: Sequence[str], n: str, distinct: int, row_id: str) -> DataFrame:
    """``rows`` with ``column`` replaced by its average rank; null stays null.

    ``ranks``: what ``average_ranks`` gives for this column (keys, value,
    avg_rank, n, tot_n), ``distinct`` rows. Ranks of few values, and those of
    hot values (fewer than HOT_VALUES per group), are broadcast; else each row
    is shuffled once, whole, to meet the rank of its value. Rows that need
    none are spread by ``row_id``.
    """
    def met(rows: DataFrame, ranks: DataFrame, name: str, *more: str) -> DataFrame:
        side = ranks.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("value").alias("_value"), F.col("avg_rank").alias(name), *more)
        on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col(column) == F.col("_value")]
        if more:
            on += [F.col("_salt") == F.col("_cold")]
        else:
            side = F.broadcast(side)
        return rows.join(side, reduce(lambda a, b: a & b, on), "left").drop("_value", *[f"_of_{k}" for k in keys])

    names = rows.columns
    if distinct <= SMALL_RANKS:
        out, rank = met(rows, ranks, "_rank"), F.col("_rank")
    else:
        is_hot = F.col(n) * HOT_VALUES > F.col(f"tot_{n}")
        near = met(rows, ranks.where(is_hot), "_near")
        settled = F.col("_near").isNotNull() | F.col(column).isNull()
        near = near.withColumn("_salt", F.when(settled, F.pmod(F.xxhash64(row_id), F.lit(1024)) + 1).otherwise(F.lit(0).cast("long")))
        out = met(near, ranks.where(~is_hot).withColumn("_cold", F.lit(0).cast("long")), "_far", "_cold")
        rank = F.coalesce("_near", "_far")
    return out.select(*[rank.alias(c) if c == column else F.col(c) for c in names])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rn") -> DataFrame:
    """``df`` with ``name``, the row's number (from 1) by ``order`` within ``keys``; no task sees a whole group.

    Rows are dealt to ranges of (keys, order), numbered within a range, and the
    counts of the group's ranges before it (groups x ranges rows) are added.
    ``order`` should decide all ties. The number of ranges is fixed, so that
    both uses of the ranges agree.
    """
    parts = default_buckets(df.sparkSession)
    dealt = df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id())
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    starts = sizes.select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    return local.join(starts, [*keys, "_range"]).withColumn(name, F.col("_before") + F.col("_local")).select(*df.columns, name)
