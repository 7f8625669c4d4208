"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a document (never its labels, language, source or id) are
standardised and mapped to FEATURES random cosines, which approximate a
Gaussian kernel. Tasks sum the normal equations of their labelled rows; the
driver adds a bounded number of these sums and solves them. Scores of rows
from the fold that a model has not seen are calibrated by isotonic regression
over at most BINS bins. All documents are then scored in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidspark.llm.common import stage
from fidspark.llm.quality_rules import with_stats

FEATURES, RIDGE, SEED, FOLDS, SUMS, BINS = 256, 1e-3, 7, 2, 16, 512
_LIMIT = 4.0  # standard deviations at which a statistic is held


def statistics() -> list[Column]:
    """The inputs of the score, from the counts of ``with_stats``."""
    s = lambda c: F.col(f"stats.{c}").cast("double")
    words, chars, lines = (F.greatest(s(c), F.lit(1.0)) for c in ("n_words", "word_chars", "n_lines"))
    return [F.log1p(s("n_words")), s("word_chars") / words, F.least(s("n_symbols") / words, F.lit(4.0)), s("n_symbol_runs") / words, s("n_letters") / chars,
            s("n_dup_lines") / lines, s("n_repeat_words") / words, s("n_upper") / chars, s("n_digits") / chars, s("n_bangs") / words,
            s("n_closed_lines") / lines, F.log1p(words / lines)]


class Cosines:
    """Standardises rows of statistics and maps them to random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED) -> None:
        rng, d = np.random.default_rng(seed), len(mean)
        self.mean, self.scale = mean, scale
        self.w, self.b = rng.normal(0, 1 / math.sqrt(d), (d, features)), rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -_LIMIT, _LIMIT)
        return np.hstack((np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b)), np.ones((len(x), 1))))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def normal_equations(labelled: DataFrame, cosines: Cosines) -> dict[int, np.ndarray]:
    """Per fold the matrix [Z y]'[Z y]; at most SUMS partial sums a fold reach the driver."""
    side = len(cosines.b) + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
            z = np.hstack((cosines(_matrix(batch)), y[:, None])) if batch.num_rows else np.zeros((0, side))
            for k in np.unique(fold).tolist():
                sums[k] = sums.get(k, 0) + z[fold == k].T @ z[fold == k]
        if sums:
            part = int(batch.column("part")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([k for k in sums], pa.int32()), pa.array([part % SUMS] * len(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()),
                                              pa.array([s.astype("<f8").tobytes() for s in sums.values()], pa.binary())], names=["fold", "slot", "part", "s"])

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        whole = sum(np.frombuffer(s.as_py(), "<f8") for s in group.column("s"))
        return pa.table({"fold": group.column("fold")[:1], "slot": group.column("slot")[:1], "s": pa.array([whole.tobytes()], pa.binary())})

    parts = labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = labelled.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(int(parts))).cast("int"))
    dealt = dealt.repartition(int(parts), "part").sortWithinPartitions("part", "doc_id", "x")
    sums = dealt.mapInArrow(partial, "fold int, slot int, part int, s binary").groupBy("fold", "slot").applyInArrow(add, "fold int, slot int, s binary")
    out: dict[int, np.ndarray] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["fold"], r["slot"])):
        out[r["fold"]] = out.get(r["fold"], 0) + np.frombuffer(r["s"], "<f8").reshape(side, side)
    return out


def solve(sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    n, k = sums[-2, -2], len(sums) - 1
    penalty = np.eye(k) * ridge * max(n, 1)
    penalty[-1, -1] = 1e-9  # the constant is free
    return np.linalg.solve(sums[:k, :k] + penalty, sums[:k, k])


def isotonic(bins: list[tuple[float, float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (score, sum of labels, rows), sorted; knots of the rising curve."""
    pools: list[list[float]] = []
    for x, y, n in bins:
        pools.append([x * n, y, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def score_documents(docs: DataFrame, labels: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted, raw (the uncalibrated ridge score).

    Learns from ``labels.quality`` of documents whose crc32(doc_id as text)
    mod 3 is not 1. Null qualities are no labels, several of one doc_id count
    as their mean, a null doc_id has none and is not held out. Empty, null and
    long texts are scored by their statistics like any other. Without usable
    labels all scores are 0.5; an empty table gives an empty table; other
    columns are not looked at.
    """
    x = F.array(*(F.coalesce(c, F.lit(0.0)) for c in statistics()))
    rows = with_stats(docs.select("doc_id", F.col("text").alias("_text")), "_text").select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"), x.alias("x"))
    rows = stage(rows, "statistics")
    y = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).cast("int")
    train = stage(rows.filter(~F.col("held_out")).join(y, F.col("doc_id") == F.col("_id")).select("doc_id", "x", "y", fold.alias("fold")), "train")
    width = len(statistics())
    moments = train.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{k}{i}") for i in range(width) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not moments["n"]:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), F.lit(0.5).alias("raw"))
    mean, scale = (np.round(np.array([moments[f"{k}{i}"] for i in range(width)]), 9) for k in "ms")
    cosines = Cosines(mean, np.where(scale > 1e-9, scale, 1.0))
    sums = normal_equations(train, cosines)
    whole = sum(sums.values())
    final = solve(whole, ridge)
    others = {k: solve(whole - s, ridge) if (whole - s)[-2, -2] > 0 else final for k, s in sums.items()}

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z, fold = cosines(_matrix(batch)), batch.column("fold").to_numpy()
                raw = np.choose(fold, [z @ others.get(k, final) for k in range(FOLDS)])
                yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(raw, -0.5, 1.5) * BINS / 2).astype(np.int32)), batch.column("y")], names=["bin", "y"])

    bins = train.mapInArrow(unseen, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    knots = isotonic([(r["bin"] * 2 / BINS, r["y"], r["n"]) for r in sorted(bins, key=lambda r: r["bin"])])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = cosines(_matrix(batch)) @ final if batch.num_rows else np.zeros(0)
            # a little of the raw score keeps the order within a pool
            s = np.clip(0.98 * np.interp(raw, *knots) + 0.02 * np.clip(raw, 0, 1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(raw)],
                                             names=["doc_id", "held_out", "score", "predicted", "raw"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {doc_type}, held_out boolean, score double, predicted int, raw double")
