"""Projection, cleaning, reshaping, set operations and splits.

All row-level work is column expressions (codegen); draws and splits use the
portable hash of a row key so results do not depend on partitioning and are
identical when a lost task is recomputed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fidspark.functions import HASH_RANGE, hash_uniform, null_markers, portable_hash
from fidspark.session import default_buckets


# --------------------------------------------------------------------------- columns

def label_last(df: DataFrame, label: str) -> DataFrame:
    """Features in order, label last; error if the label is missing."""
    if label not in df.columns:
        raise ValueError(f"label {label!r} not in {df.columns}")
    return df.select(*[c for c in df.columns if c != label], label)


def align(r: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Synthetic takes the real names by position; error on arity mismatch."""
    if len(r.columns) != len(s.columns):
        raise ValueError(f"cannot align {len(s.columns)} columns with {len(r.columns)}")
    return r, s.toDF(*r.columns)


def resolve_label(df: DataFrame, label: str | int | None = None) -> str:
    """By case/space-insensitive name, by index, or the last column."""
    cols = df.columns
    if label is None:
        return cols[-1]
    if isinstance(label, int):
        return cols[label]
    by_name = {c.strip().casefold(): c for c in reversed(cols)}
    found = by_name.get(label.strip().casefold())
    if found is None:
        raise ValueError(f"no label column {label!r}")
    return found


def split_label(df: DataFrame, label: str | int | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, label) projections of the same scan."""
    lab = resolve_label(df, label)
    return df.drop(lab), df.select(lab)


def to_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P5: every listed column to double; unparseable -> null (try_cast)."""
    cols = set(df.columns if cols is None else cols)
    return df.select(*[
        F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null (NaN counts as missing, as in pandas)."""
    cols = list(subset or df.columns)
    dbl = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    cond = reduce(lambda a, b: a & b, [
        (F.col(c).isNotNull() & ~F.isnan(c)) if c in dbl else F.col(c).isNotNull() for c in cols])
    return df.where(cond)


def apply_missing_policy(df: DataFrame, num: Sequence[str], cat: Sequence[str], target: str | None,
                         fill: str = "empty") -> DataFrame:
    """Drop null target, drop null numerics, fill null categoricals with ``fill``."""
    keep = [c for c in ([target] if target else []) + list(num)]
    out = drop_incomplete(df, keep) if keep else df
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c) if c in cat else F.col(c)
                        for c in out.columns])


def null_marker_columns(df: DataFrame, cols: Sequence[str] | None = None, marks=("?", "", " "),
                        cat_fill: str | None = None, cats: Sequence[str] = ()) -> DataFrame:
    """Markers -> NULL; optionally categoricals -> a literal such as 'nan'."""
    cols = set(df.columns if cols is None else cols)
    out = []
    for c in df.columns:
        e = null_markers(c, marks) if c in cols else F.col(c)
        if cat_fill is not None and c in cats:
            e = F.coalesce(e.cast("string"), F.lit(cat_fill))
        out.append(e.alias(c))
    return df.select(*out)


def cap_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """P10: exactly n rows without replacement, chosen by a seeded hash of ``key``.

    ``orderBy(...).limit(n)`` is planned as a top-k (TakeOrderedAndProject):
    each partition keeps n candidates, no full sort.  Sampling is the feature here.
    """
    return df.orderBy(portable_hash(key, seed), F.col(key)).limit(n)


def sample_pct(df: DataFrame, pct: float, key: str, seed: int = 42) -> DataFrame:
    """Keep rows whose hash-uniform draw is below ``pct`` / 100 (Bernoulli, stable)."""
    return df.where(hash_uniform(key, seed) < pct / 100.0)


def cast_roles(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Categoricals to string."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in cats else F.col(c) for c in df.columns])


def binarize(c: str, normal, keep_null: bool = False) -> Column:
    """Normal class -> 0, others -> 1 (a null label becomes 1 unless ``keep_null``)."""
    col = F.col(c)
    if isinstance(normal, (int, float)):
        hit = F.expr(f"try_cast(`{c}` AS DOUBLE)") == float(normal)
    else:
        hit = F.trim(col.cast("string")) == str(normal)
    out = F.when(hit, F.lit(0)).otherwise(F.lit(1))
    return F.when(col.isNull(), F.lit(None).cast("int")).otherwise(out) if keep_null else out


def argmax_columns(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """A one-hot group -> 0-based index of its first maximum."""
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    return df.withColumn(out, (F.array_position(arr, F.array_max(arr)) - 1).cast("int")).drop(*cols)


def reorder(df: DataFrame, num: Sequence[str], cat: Sequence[str], target: str | None) -> DataFrame:
    """[num.., cat.., target]."""
    return df.select(*num, *cat, *([target] if target else []))


def restore(df: DataFrame, original: Sequence[str]) -> DataFrame:
    """P20: back to the original column order."""
    return df.select(*original)


def clip_to_reference(s: DataFrame, r: DataFrame, cols: Sequence[str], to_int: bool = False) -> DataFrame:
    """Clip synthetic columns into the real [min, max] (one-row stats, attached as literals)."""
    row = r.agg(*[F.min(c).alias(f"mn_{c}") for c in cols], *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
    out = []
    for c in s.columns:
        if c in cols:
            e = F.greatest(F.least(F.col(c), F.lit(row[f"mx_{c}"])), F.lit(row[f"mn_{c}"]))
            out.append((e.cast("long") if to_int else e).alias(c))
        else:
            out.append(F.col(c))
    return s.select(*out)


def snap_to_reference(s: DataFrame, r: DataFrame, col: str, key: str) -> DataFrame:
    """Replace each synthetic value by the nearest distinct real value (ties -> the lower).

    Exact as-of matching both ways without a cross join: union the distinct
    values of both sides (a hot value is one row; a null stays null), then ``last``/``first(ignorenulls)``
    windows ordered by value give the real neighbour below and above.  The
    windows are partitioned by a value range (``repartitionByRange`` semantics
    through bucket ids from the CDF core) with carried boundary values, so
    no single task sees a whole column.
    """
    from fidspark.operators import cdf

    reals = r.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull()).distinct()
    rows = s.select(key, F.col(col).cast("double").alias("value"))
    wanted = rows.select(F.col("value").alias("v")).where("v IS NOT NULL").distinct()
    u = reals.select("v", F.col("v").alias("rv")).unionByName(wanted.select("v", F.lit(None).cast("double").alias("rv")))
    # bucket by value range; carry the last real value of earlier buckets and first of later ones
    nb = cdf.default_buckets(s.sparkSession)
    fr = [i / nb for i in range(1, nb)]
    bounds = reals.agg(F.percentile_approx("v", fr, 10000).alias("_b")) if nb > 1 else None
    if bounds is not None:
        u = u.withColumn("_k", F.lit(1)).join(F.broadcast(bounds.withColumn("_k", F.lit(1))), "_k").withColumn(
            "_bucket", F.size(F.filter("_b", lambda b: b < F.col("v")))).drop("_b", "_k")
    else:
        u = u.withColumn("_bucket", F.lit(0))
    edge = u.groupBy("_bucket").agg(F.min("rv").alias("bmin"), F.max("rv").alias("bmax"))
    wb = Window.orderBy("_bucket")  # one row per bucket: tiny
    edge = edge.select("_bucket",
                       F.max("bmax").over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_max"),
                       F.min("bmin").over(wb.rowsBetween(1, Window.unboundedFollowing)).alias("next_min"))
    w = Window.partitionBy("_bucket").orderBy("v", F.col("rv").asc_nulls_last())
    below = F.last("rv", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    w2 = Window.partitionBy("_bucket").orderBy("v", F.col("rv").asc_nulls_first())
    above = F.first("rv", ignorenulls=True).over(w2.rowsBetween(0, Window.unboundedFollowing))
    t = u.select("*", below.alias("lo"), above.alias("hi")).where(F.col("rv").isNull())
    t = t.join(F.broadcast(edge), "_bucket", "left")
    lo = F.coalesce("lo", "prev_max")
    hi = F.coalesce("hi", "next_min")
    snapped = F.when(hi.isNull(), lo).when(lo.isNull(), hi).when(
        F.col("v") - lo <= hi - F.col("v"), lo).otherwise(hi)
    return rows.join(t.select("v", snapped.alias("snapped")), rows["value"] == F.col("v"), "left").drop("v")


def complete_target_only(s: DataFrame, r: DataFrame, target: str, key: str) -> DataFrame:
    """Take every column from real except the synthesised target (join on row id)."""
    return r.drop(target).join(s.select(key, target), key, "inner")


def normalize_space(c: str) -> Column:
    """P25: strip and put exactly one leading space."""
    return F.concat(F.lit(" "), F.trim(F.col(c).cast("string")))


def row_to_text(df: DataFrame, cols: Sequence[str], out: str = "text", shuffle_seed: int | None = None,
                key: str | None = None) -> DataFrame:
    """P26: "col is value, col is value", in the order given, or by hash per row with ``shuffle_seed`` and ``key``."""
    pieces = [F.concat(F.lit(f"{c} is "), F.col(c).cast("string")) for c in cols]
    if shuffle_seed is None:
        return df.select("*", F.concat_ws(", ", *pieces).alias(out))
    drawn = F.array_sort(F.array(*[F.struct(portable_hash(key, shuffle_seed + i).alias("h"), F.lit(i).alias("i"), p.alias("piece"))
                                   for i, p in enumerate(pieces)]))
    return df.select("*", F.concat_ws(", ", F.transform(drawn, lambda d: d["piece"])).alias(out))


def text_to_row(df: DataFrame, text: str, cols: Sequence[str]) -> DataFrame:
    """Split on ',', then ' is '; first value per column wins; malformed pieces skipped."""
    pieces = F.transform(F.split(F.col(text), ","), lambda p: F.split(F.trim(p), " is "))
    good = F.filter(pieces, lambda kv: F.size(kv) == 2)
    out = [F.col(c) for c in df.columns]
    def named(c):
        return lambda kv: F.trim(kv[0]) == c

    for c in cols:
        hit = F.filter(good, named(c))
        out.append(F.when(F.size(hit) > 0, F.trim(F.element_at(F.element_at(hit, 1), 2))).alias(c))
    return df.select(*out)


def valid_rows(df: DataFrame, num: Sequence[str], n: int | None = None, order: str | None = None) -> DataFrame:
    """Keep rows whose numeric fields parse and that have no null; first n by ``order``."""
    cond = reduce(lambda a, b: a & b, [F.expr(f"try_cast(`{c}` AS DOUBLE)").isNotNull() for c in num])
    out = drop_incomplete(df.where(cond))
    if n is not None:
        out = out.orderBy(order).limit(n)  # the limit is the feature (keep the first n accepted)
    return out


def in_range(stats: dict[str, tuple[float, float]]) -> Column:
    """Whether all listed columns lie in [min, max]; a null lies in none."""
    return F.coalesce(reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in stats.items()]), F.lit(False))


def reject_out_of_range(s: DataFrame, stats: dict[str, tuple[float, float]], n: int | None = None, order: str | None = None) -> DataFrame:
    """Keep rows whose listed columns lie in [min, max]; with ``n``, the first n of them by ``order``."""
    kept = s.where(in_range(stats))
    return kept if n is None else kept.orderBy(order).limit(n)  # the limit is the feature


def range_counts(s: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """One row (n_kept, n_rejected)."""
    kept = F.count_if(in_range(stats))
    return s.agg(kept.alias("n_kept"), (F.count("*") - kept).alias("n_rejected"))


def reject_and_count(s: DataFrame, stats: dict[str, tuple[float, float]]) -> tuple[DataFrame, Observation]:
    """The rows in range, and what the job that reads them observes: n_kept, n_rejected.

    The counts come with the first action on the rows, from the same pass.
    """
    seen = Observation()
    kept = F.count_if(in_range(stats))
    return s.observe(seen, kept.alias("n_kept"), (F.count(F.lit(1)) - kept).alias("n_rejected")).where(in_range(stats)), seen


def draw_until(draw: Callable[[int, int], DataFrame], stats: dict[str, tuple[float, float]], n: int, path: str,
               rounds: int = 20) -> tuple[DataFrame, int, int]:
    """Draw, reject and draw again until ``n`` rows lie in range: (rows, how many drawn were kept, how many rejected).

    ``draw(round, missing)`` gives a frame, of about as many rows as are
    missing. Each round is one job, which appends to ``path`` and counts; a
    round draws more by the share rejected so far. The rows are the first n of
    the rounds in order; fewer if ``rounds`` rounds do not reach n.
    """
    kept = rejected = 0
    out = None
    for i in range(rounds):
        if kept >= n:
            break
        share = kept / (kept + rejected) if kept else 1.0
        rows, seen = reject_and_count(draw(i, math.ceil((n - kept) / share)), stats)
        rows.withColumn("_round", F.lit(i)).write.mode("append").parquet(path)
        out = out or rows.sparkSession
        kept, rejected = kept + seen.get["n_kept"], rejected + seen.get["n_rejected"]
    if out is None:
        raise ValueError("n and rounds are at least 1")
    # the limit is the feature
    return out.read.parquet(path).orderBy("_round").limit(n).drop("_round"), kept, rejected


def handle_nan_rows(df: DataFrame, cols: Sequence[str], keep: bool = True) -> DataFrame:
    """Rows with a NaN/null in ``cols``: zero the row (keep=True) or drop it."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c)) for c in cols])
    if keep:
        return df.select(*[F.when(bad, F.lit(0.0)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                           for c in df.columns])
    return df.where(~bad)


# --------------------------------------------------------------------------- set operations

def stack_sources(r: DataFrame, s: DataFrame, flag: str = "is_real") -> DataFrame:
    """Union all by position with a source flag (1 real, 0 synthetic)."""
    r, s = align(r, s)
    return r.withColumn(flag, F.lit(1)).unionByName(s.withColumn(flag, F.lit(0)))


def union_splits(*dfs: DataFrame) -> DataFrame:
    """Union all of splits with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def stack_runs(runs: Sequence[DataFrame], col: str = "run_id") -> DataFrame:
    """Union of runs with an id."""
    return reduce(lambda a, b: a.unionByName(b), [d.withColumn(col, F.lit(i)) for i, d in enumerate(runs)])


def missing_categories(r: DataFrame, s: DataFrame, cols: Sequence[str]) -> DataFrame:
    """U4: (feature, value) present in real but not in synthetic (left anti join)."""
    def lng(df):
        return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
            [], list(cols), "feature", "value").where(F.col("value").isNotNull()).distinct()

    return lng(r).join(lng(s), ["feature", "value"], "left_anti")


def drop_all_duplicates(df: DataFrame) -> DataFrame:
    """Drop every copy of a repeated row (keep rows that occur once)."""
    cols = df.columns
    return df.groupBy(*cols).count().where(F.col("count") == 1).select(*cols)


# --------------------------------------------------------------------------- splits

def random_split(df: DataFrame, shares: Sequence[float], key: str, seed: int = 42,
                 names: Sequence[str] = ("train", "test", "val")) -> DataFrame:
    """Add ``split`` by hash-uniform thresholds (stable across re-reads, unlike randomSplit)."""
    u = hash_uniform(key, seed)
    edges, acc = [], 0.0
    for sh in shares:
        acc += sh
        edges.append(acc)
    e = F.lit(names[len(shares) - 1])
    for name, hi in reversed(list(zip(names, edges))[:-1]):
        e = F.when(u < hi, F.lit(name)).otherwise(e)
    return df.withColumn("split", e)


def _rank_in_class(df: DataFrame, label: str, key: str, seed: int, copies: str | None = None) -> DataFrame:
    """``df`` plus _rank (from 1, by hash within the label) and _size (rows of the label).

    Hashes are uniform, so equal ranges of them cut a class into parts of like
    size. Rows are numbered within a part, and the counts of the parts before
    it (labels x parts rows) are added, so no task sees a whole class.
    ``copies``: a column that says how many equal rows one row stands for;
    _rank is then the rank of its last copy.
    """
    parts = 4 * default_buckets(df.sparkSession)
    n = F.lit(1).cast("long") if copies is None else F.col(copies)
    rows = df.withColumn("_h", portable_hash(key, seed)).withColumn("_part", F.floor(F.col("_h") * parts / F.lit(float(HASH_RANGE))))
    counts = rows.groupBy(F.col(label).alias("_label"), F.col("_part").alias("_of")).agg(F.sum(n).alias("_n"))
    one = Window.partitionBy("_label")
    counts = counts.select("_label", "_of", F.sum("_n").over(one).alias("_size"), F.coalesce(F.sum("_n").over(
        one.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = Window.partitionBy(label, "_part").orderBy("_h", F.col(key))
    at = F.row_number().over(here) if copies is None else F.sum(n).over(here.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_at", at)
    return (rows.join(counts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_of")))
            .withColumn("_rank", F.col("_at") + F.col("_before")).drop("_h", "_part", "_label", "_of", "_before", "_at"))


def number_rows(df: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """``df`` plus rn (from 1, by the numeric column ``order`` within ``group``) and n_group (rows of the group).

    Rows are numbered within ranges of ``order``, and the counts of the ranges
    before are added, so a group that holds most rows is no single task.
    """
    ranges = 4 * default_buckets(df.sparkSession)
    edges = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10000)).first()[0] or []
    edges = F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<long>")
    rows = df.withColumn("_range", F.size(F.filter(edges, lambda e: e < F.col(order))))
    held = rows.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    one = Window.partitionBy(*[f"_g_{c}" for c in group])
    held = held.withColumn("n_group", F.sum("_n").over(one)).withColumn("_before", F.coalesce(F.sum("_n").over(
        one.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(order)))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group])
    return rows.join(held, same & (F.col("_range") == F.col("_of"))).select(
        *df.columns, (F.col("_at") + F.col("_before")).alias("rn"), "n_group")


def fold_copies(df: DataFrame, cols: Sequence[str], label: str, k: int, seed: int = 42) -> DataFrame:
    """W4 for rows without a key: (cols, label, fold, w), ``w`` equal rows being in that fold.

    Equal rows are counted first and their copies dealt round robin, so every
    fold holds its share of each class and a value held by most rows is one row.
    """
    rows = df.groupBy(*cols, label).agg(F.count("*").alias("_copies")).withColumn("_key", F.xxhash64(*cols, label))
    ranked = _rank_in_class(rows, label, "_key", seed, "_copies").withColumn("_first", F.col("_rank") - F.col("_copies"))
    dealt = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    def below(n):  # copies of the class with a rank below n that are in the fold
        return F.floor((n - 1 - F.col("fold")) / k)

    return dealt.withColumn("w", (below(F.col("_rank")) - below(F.col("_first"))).cast("double")).where("w > 0").select(
        *cols, label, "fold", "w")


def stratified_fold(df: DataFrame, label: str, k: int, key: str, seed: int = 42) -> DataFrame:
    """fold = (rank within the label by hash, from 0) % k, so each class is spread evenly. A null label is a class."""
    return _rank_in_class(df, label, key, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")


def stratified_split(df: DataFrame, label: str, test_share: float, key: str, seed: int = 42) -> DataFrame:
    """Per class, the first round(n_c * share) rows by hash go to test. A null label is a class."""
    test = F.col("_rank") <= F.round(F.col("_size") * test_share)
    return _rank_in_class(df, label, key, seed).withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_rank", "_size")


def resplit(df: DataFrame, share: float, key: str, label: str | None = None, seed: int = 42, split: str = "split",
            parts: Sequence[str] = ("train", "val")) -> DataFrame:
    """Rows of ``parts`` are divided anew, ``share`` of them (of each class, with ``label``) to the second; the rest stay."""
    inside = F.col(split).isin(*parts)
    old, rest = df.where(inside).drop(split), df.where(~inside | F.col(split).isNull())
    if label is None:
        new = random_split(old, [1 - share, share], key, seed, parts)
    else:
        second = F.col("split") == "test"
        new = stratified_split(old, label, share, key, seed).withColumn("split", F.when(second, parts[1]).otherwise(parts[0]))
    return new.withColumnRenamed("split", split).select(df.columns).unionByName(rest)


def covering_split_check(df: DataFrame, cats: Sequence[str], split_col: str = "split") -> DataFrame:
    """X2 check: per categorical column, categories missing from train (0 rows = covering)."""
    train = df.where(F.col(split_col) == "train")
    return missing_categories(df, train, cats)


def covering_split(df: DataFrame, cats: Sequence[str], shares: Sequence[float], key: str, seed: int = 1234,
                   names: Sequence[str] = ("train", "test")) -> DataFrame:
    """A split by hash whose first part holds every category of ``cats``, for any seed.

    One aggregate finds, for each value of each column (null is none), whether
    the first part holds it and, if not, its representative, the row of
    the least (hash, key). Only the
    representatives move, one per missing value, and one row may stand for
    several columns. Rows of equal keys move together.
    """
    cand = random_split(df, shares, key, seed, names)
    long = cand.select(F.col(key).alias("_key"), (F.col("split") == names[0]).alias("_in"), portable_hash(key, seed + 1).alias("_h"),
                       *[F.col(c).cast("string").alias(c) for c in cats]).unpivot(["_key", "_in", "_h"], list(cats), "feature", "value")
    values = long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.bool_or("_in").alias("held"), F.min(F.struct("_h", "_key")).alias("first"))
    move = values.where(~F.col("held")).select(F.col("first._key").alias("_key")).distinct()
    moved = cand.join(move.withColumn("_moved", F.lit(True)), cand[key] == move["_key"], "left")
    return moved.select(*[F.when(F.col("_moved"), F.lit(names[0])).otherwise(F.col("split")).alias("split") if c == "split" else cand[c] for c in cand.columns])
