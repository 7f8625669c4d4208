"""Fits and families of metrics work side by side, on tables whose partitions go by their rows."""

import threading

import pytest
from pyspark.sql import functions as F

from fidspark.operators import models, scores
from fidspark.plans import compare


def _pair(spark, n=400):
    df = spark.range(n).select(F.col("id").alias("k"), F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"),
                               (F.sin("id") + F.cos(F.col("id") * 7) > 0).cast("string").alias("y"))
    return df, df.withColumn("a", F.col("a") + 0.1)


def test_families_of_all_runs_work_side_by_side(spark, monkeypatch):
    """Two runs of two families: each waits until all four have begun."""
    met = threading.Barrier(4, timeout=30)

    def family(name):
        def report(r, s, *rest):
            met.wait()
            return s.agg(F.avg("a").alias(name))
        return report

    monkeypatch.setattr(compare, "FAMILIES", {n: family(n) for n in ("one", "two")})
    r, s = _pair(spark)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = {(x.run_id, x.metric): x.value for x in compare.compare_runs(r, [s, s.withColumn("a", F.lit(5.0))], "y", ["a"], "k").collect()}
    assert set(got) == {(i, n) for i in (0, 1) for n in ("one", "two")}
    assert got[1, "one"] == got[1, "two"] == 5.0 and got[0, "one"] == pytest.approx(s.agg(F.avg("a")).first()[0])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_what_was_held_is_released_when_a_family_fails(spark, monkeypatch):
    def broken(*rest):
        raise ValueError("no metrics")

    monkeypatch.setattr(compare, "FAMILIES", {"one": broken})
    r, s = _pair(spark)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with pytest.raises(ValueError):
        compare.compare_full(r, s, "y", ["a"], "k")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_auroc_of_all_classes_is_one_pass(spark, monkeypatch):
    kept, calls = scores.kept, []
    monkeypatch.setattr(scores, "kept", lambda df, tag: calls.append(tag) or kept(df, tag))
    df = spark.range(300).select((F.col("id") % 3).cast("int").alias("y"), *[F.round(F.sin(F.col("id") * (c + 2)), 1).alias(f"p{c}") for c in range(4)])
    got = scores.auroc_ovr(df, "y", {str(c): f"p{c}" for c in range(4)}).first()[0]
    assert len(calls) == 1
    each = [scores.auroc(df, "y", f"p{c}", positive=c).first()[0] for c in range(4)]
    assert each[3] is None and got == pytest.approx(sum(each[:3]) / 3)  # no row is of class 3


def test_partitions_of_a_fit_go_by_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert models._fit_parts(spark, 0) == models._fit_parts(spark, models.FIT_ROWS) == 1
    assert models._fit_parts(spark, cores * models.MOST_ROWS) == cores
    assert models._fit_parts(spark, 10 * cores * models.MOST_ROWS) == 10 * cores


def test_utility_gap_fits_tables_in_few_partitions_side_by_side(spark, monkeypatch):
    """The split of the real table has many shuffle partitions; each step of a fit would be a task for each of them."""
    real, seen, met = models._classifier, [], threading.Barrier(4, timeout=60)

    def watched(*args):
        learner = real(*args)

        class Watched(type(learner)):
            def _fit(self, dataset):
                seen.append(dataset.rdd.getNumPartitions())
                met.wait()  # two models on both tables
                return super()._fit(dataset)

        learner.__class__ = Watched
        return learner

    monkeypatch.setattr(models, "_classifier", watched)
    r, s = _pair(spark)
    got = {x.model: x for x in models.utility_gap(r, [s], ["a", "b"], "y", ["lr", "dt"], key="k").collect()}
    assert seen == [1] * 4 and set(got) == {"lr", "dt"}
    assert all(abs(x.accuracy_gap) <= 20 and abs(x.auc_gap) <= 0.3 for x in got.values())


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_boosting_on_counted_bins_equals_boosting_on_rows(spark, monkeypatch, task):
    """Numbers of at most 32 values: the bins are the values, so both ways must find the same trees and metrics."""
    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11 - 5).cast("double").alias("b"),
                                  F.when(F.col("id") % 5 < 2, "u").otherwise("v").alias("c"))
    noise = F.pmod(F.xxhash64("a", "b", "c"), F.lit(5))
    df = df.withColumn("y", (F.col("a") + F.col("b") + noise > 4).cast("int") if task == "classification" else F.col("a") * F.col("b") + noise)
    grid = {"maxIter": (2, 4), "minInstancesPerNode": (1, 60), "maxDepth": (4,), "minInfoGain": (0.0, 0.01)}
    fitted, learner = [], models.GBTClassifier if task == "classification" else models.GBTRegressor

    class Watched(learner):
        def _fit(self, dataset):
            fitted.append(dataset.count())
            return super()._fit(dataset)

    monkeypatch.setattr(models, learner.__name__, Watched)
    plain = {x.criterion: x for x in models.ml_efficiency(df, df, ["a", "b"], "y", ["c"], task, grid).collect()}
    rows = fitted[0]
    fitted.clear()
    monkeypatch.setattr(models, "FIT_ROWS", 100)
    for x in models.ml_efficiency(df, df, ["a", "b"], "y", ["c"], task, grid).collect():
        assert x.params == plain[x.criterion].params
        assert tuple(x)[2:] == pytest.approx(tuple(plain[x.criterion])[2:])
    assert rows > 2000 and max(fitted) <= 154  # 7 * 11 * 2 cells, one label each


def test_cuts_of_bins(spark):
    df = spark.range(1000).select(F.array((F.col("id") % 4).cast("double"), F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    few, many, one = models._bin_cuts(df, 3)
    assert few == [0.0, 1.0, 2.0] and one == [] and len(many) == models.BINS - 1
    assert all(abs(c - 1000 * (i + 1) / models.BINS) <= 1.5 for i, c in enumerate(many))
