"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash of their content, so a block is a random
draw from its source. Each source's target in words becomes a quota of blocks:
whole passes over the source, then blocks in permuted order up to the target,
the last one cut at a word. A binary tree over the output shards splits the
quotas exactly: each node draws, without replacement, how many blocks of each
source go left. A shard then takes the next blocks of each source's
permutation, so shards hold disjoint draws, and shuffles its rows by a hash.

Per-document work is columns only. The driver sees one row per source, never
documents; blocks number about MAX_BLOCKS at most, as their size in words
grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fidspark.llm.common import let, stage, text_of, total, words_of

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS, MAX_BLOCKS, SHARD_WORDS = 1 << 16, 1_000_000, 1 << 24
SEED = 20


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> dict[str | None, float]:
    """Words per source: ``share`` of all words by weight, none above ``most`` times its source.

    Sources go by code point, null last, and the weights repeat along them.
    The excess of a source at its limit is shared among the others by weight
    until no source is above its limit (a source without words gets none).
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    left = [(name, most * size, weights[i % len(weights)]) for i, (name, size) in enumerate(ordered)]
    rest, out = share * sum(size for _, size in sizes), {}
    while left:
        unit = rest / sum(w for _, _, w in left)
        full = [x for x in left if x[1] <= unit * x[2]]
        if not full:
            return out | {name: unit * w for name, _, w in left}
        out |= {name: limit for name, limit, _ in full}
        rest -= sum(limit for _, limit, _ in full)
        left = [x for x in left if x[1] > unit * x[2]]
    return out


def split_quotas(quotas: Sequence[int], shards: int, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(shard, source, blocks) with blocks > 0, by recursive multivariate-hypergeometric splits.

    Shards get equal numbers of blocks (to one); each node's draw has a
    generator of its own, seeded by the node, so reruns agree.
    """
    out: list[tuple[int, int, int]] = []
    todo = [(0, shards, np.arange(len(quotas)), np.asarray(quotas, dtype=np.int64))]
    while todo:
        lo, hi, ids, have = todo.pop()
        ids, have = ids[have > 0], have[have > 0]
        if hi - lo == 1 or not len(ids):
            out += [(lo, int(i), int(k)) for i, k in zip(ids, have)]
            continue
        mid = (lo + hi) // 2
        n_left = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, n_left, method="marginals")
        todo += [(mid, hi, ids, have - left), (lo, mid, ids, left)]
    return sorted(out)


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def draws(df: DataFrame, text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
          block_words: int = BLOCK_WORDS, max_blocks: int = MAX_BLOCKS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """``df`` (with doc_id, source), its text replaced by size, source_size, target and ``drawn``, an array of (shard, words).

    ``size`` counts the text's words (null: 0). A row appears in ``drawn``
    once per time the mix takes it; ``words`` is its size but for the one
    document of a source at which the target is reached, which is cut there;
    of rows equal in doc_id, source and text the first ones are taken whole,
    so a source's draws meet its target to the word. A text of any length is
    one document, cut at a word.
    Null sources form one source, which comes last. An empty table gives an
    empty table; so do sources without words give empty draws. ``df`` is
    staged once with size and hash; added names replace equal ones.
    """
    spark = df.sparkSession
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), text_of(text))
    rows = stage(df.withColumns({"size": F.size(words_of(text_of(text))).cast("long"), "_h": key, "_row_id": F.monotonically_increasing_id()})
                 .drop(text), "sized")
    words = total(rows, F.sum("size"))
    n_blocks = max(1, min(max_blocks, -(-words // block_words)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_h"), F.lit(n_blocks)))
    blocks = stage(rows.groupBy("source", "_block").agg(F.sum("size").alias("words")), "blocks")

    # one row per source: target, whole passes, words of the last pass
    sizes = [(r["source"], r["words"]) for r in blocks.groupBy("source").agg(F.sum("words").alias("words")).collect()]
    sizes.sort(key=lambda x: (x[0] is None, x[0] or ""))
    want = targets(sizes, weights, share, most)
    plan = []
    for i, (name, size) in enumerate(sizes):
        passes, rest = divmod(round(want[name]), size) if size else (0, 0)
        plan.append((i, name, size, float(want[name]), passes, rest))
    plan = _frame(spark, plan, "_s int, source string, source_size long, target double, _passes long, _rest long")
    same = blocks["source"].eqNullSafe(plan["source"])

    # copies of each block: whole passes, then permuted order up to the rest of the target
    order = Window.partitionBy("_s").orderBy(F.xxhash64(F.lit(seed), "_s", "_block"), "_block")
    quota = (blocks.join(plan, same).drop(blocks["source"])
             .withColumn("_end", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_cut", F.when((F.col("_end") > F.col("_rest")) & (F.col("_end") - F.col("words") < F.col("_rest")),
                                        F.col("_rest") - F.col("_end") + F.col("words")))
             .withColumn("_copies", F.col("_passes") + ((F.col("_end") <= F.col("_rest")) | F.col("_cut").isNotNull()).cast("long")))
    quota = stage(quota, "quota")

    # the tree gives each shard its number of blocks of each source
    taken = {r["_s"]: r["n"] for r in quota.groupBy("_s").agg(F.sum("_copies").alias("n")).collect()}
    counts = [taken.get(i, 0) for i in range(len(sizes))]
    shards = max(1, -(-round(sum(want.values())) // shard_words))
    start, bounds = [0] * len(sizes), []
    for shard, s, k in split_quotas(counts, shards, seed):
        bounds.append((s, start[s], shard))
        start[s] += k
    bounds = _frame(spark, bounds, "_s int, _rank long, shard int")

    # the blocks of a source in permuted order meet its shards' ranges
    drawn = quota.filter("_copies > 0").select("_s", "_block", F.posexplode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_pass", "_"))
    rank = Window.partitionBy("_s").orderBy(F.xxhash64(F.lit(seed + 1), "_s", "_block", "_pass"), "_block", "_pass")
    drawn = drawn.drop("_").withColumn("_rank", (F.row_number().over(rank) - 1).cast("long"))
    both = (drawn.select("_s", "_rank", "_block", "_pass", F.lit(None).cast("int").alias("shard"))
            .unionByName(bounds.select("_s", "_rank", F.lit(None).cast("long").alias("_block"), F.lit(None).cast("int").alias("_pass"), "shard")))
    fill = Window.partitionBy("_s").orderBy("_rank", F.col("shard").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = (both.withColumn("shard", F.last("shard", ignorenulls=True).over(fill)).filter("_block is not null")
              .groupBy("_s", "_block").agg(F.sort_array(F.collect_list(F.struct("_pass", "shard"))).alias("_shards")))
    quota = stage(quota.join(placed, ["_s", "_block"], "left")
                  .select("_s", "source", "_block", "source_size", "target", "_passes", "_cut", "_shards"), "placed")

    # where the cut falls in a source's last block: its documents in hash order, equal rows as one
    cut = quota.filter("_cut is not null").select("source", "_block", F.col("_cut").alias("_left"))
    keys = (_meet(rows.select("source", "_block", "_h", "size"), cut)
            .groupBy("source", "_block", "_left", "_h").agg(F.sum("size").alias("w"), F.count("*").alias("m")))
    along = Window.partitionBy("source", "_block").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    edge = (keys.withColumn("e", F.sum("w").over(along)).filter("e > _left and e - w <= _left")
            .select("source", "_block", F.col("_h").alias("_edge"), (F.col("w") / F.col("m")).cast("long").alias("_each"),
                    (F.col("_left") - F.col("e") + F.col("w")).alias("_need")))
    quota = stage(_meet(quota, _turns(rows, stage(edge, "edges")), "left"), "cuts")

    first = F.col("_row_id") < F.col("_turn")
    last = F.when(F.col("_cut").isNull() | (F.col("_h") < F.col("_edge")), F.col("size")).when(
        F.col("_h") == F.col("_edge"), F.when(first, F.col("size")).when(F.col("_row_id") == F.col("_turn"), F.col("_part"))).otherwise(0)
    last = F.coalesce(last, F.lit(0)).cast("long")
    every = F.transform(F.coalesce("_shards", F.array().cast("array<struct<_pass:int,shard:int>>")),
                        lambda d: F.struct(d["shard"].alias("shard"), F.when(d["_pass"] < F.col("_passes"), F.col("size")).otherwise(
                            last).alias("words")))
    out = _meet(rows, quota, "left").withColumn("drawn", F.filter(every, lambda d: d["words"] > 0))
    return out.drop("_block", "_s", "_passes", "_cut", "_shards", "_edge", "_part", "_turn", "_row_id")


def _turns(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """(source, _block, _edge, _turn, _part): of the equal rows at a source's cut, the row that is cut, and the words it gives.

    The row's rank among its equals is known; which row that is follows from
    counts per task's part of the rows, then from ranks within one part, so
    that any number of equal rows is never sorted in one task.
    """
    part = F.shiftright("_row_id", 33)
    equal = (_meet(rows.select("source", "_block", "_h", "_row_id"), edge).filter("_h = _edge")
             .select("source", "_block", "_edge", "_need", "_each", "_row_id", part.alias("_task")))
    before = Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = (equal.groupBy("source", "_block", "_edge", "_need", "_each", "_task").agg(F.count("*").alias("n"))
              .withColumn("_rank", F.floor(F.col("_need") / F.col("_each")) - F.coalesce(F.sum("n").over(before), F.lit(0))))
    # an edge holds its cut, so one task of each source has the rank
    here = counts.filter("_rank >= 0 and _rank < n").select(F.col("source").alias("_s2"), F.col("_task").alias("_t2"), "_rank")
    ranked = (equal.join(here, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_task") == F.col("_t2")))
              .withColumn("_k", F.row_number().over(Window.partitionBy("source", "_task").orderBy("_row_id")) - 1))
    return ranked.filter("_k = _rank").select("source", "_block", "_edge", F.col("_row_id").alias("_turn"), (F.col("_need") % F.col("_each")).alias("_part"))


def _meet(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (source, _block), where a null source equals a null source."""
    b = b.withColumnsRenamed({"source": "_source2", "_block": "_block2"})
    return a.join(b, F.col("source").eqNullSafe(F.col("_source2")) & (F.col("_block") == F.col("_block2")), how).drop("_source2", "_block2")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per time it is drawn, dealt to shards and shuffled within them.

    A document cut at its source's target keeps its first words, joined by
    single spaces. Columns named like the operator's own are kept.
    """
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", F.col("source").cast("string").alias("source"), text_of().alias("_text"))
    drawn = draws(packed, "_text", **options).select("_row", "_h", "size", F.posexplode("drawn").alias("_n", "_d"))
    cut = let(words_of(F.col("_row.text")), lambda w: F.concat_ws(" ", F.slice(w, 1, F.col("_d.words").cast("int"))))
    text = F.when(F.col("_d.words") < F.col("size"), cut).otherwise(F.col("_row.text"))
    mixed = drawn.repartition("_d.shard", F.pmod("_h", F.lit(64))).sortWithinPartitions("_d.shard", F.xxhash64("_h", "_n"))
    return mixed.select("_row.*", text.alias("_cut_text")).withColumn("text", F.col("_cut_text")).drop("_cut_text").select(*docs.columns)
