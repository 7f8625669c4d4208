"""Scans of several files, draws of rows without a key, boosted prefixes, and the full report."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fidspark.operators import iforest, models
from fidspark.plans import compare
from fidspark.sources import io


def _files(folder, *texts):
    for i, t in enumerate(texts):
        (folder / f"part{i}.data").write_text(t)
    return str(folder)


def test_each_file_loses_its_own_leading_lines_and_header(spark, tmp_path):
    p = _files(tmp_path, "junk one\n\na b\n1 2.\na b\n3 4.\n", "junk two\na b\n5 6.\n" + "7 8.\n" * 500)
    got = io.read_table(spark, p, skip_lines=1, header=True, strip_suffix=".").groupBy("a", "b").count().collect()
    # the second "a b" of the first file is a data row
    assert sorted(map(tuple, got)) == [("1", "2", 1), ("3", "4", 1), ("5", "6", 1), ("7", "8", 500), ("a", "b", 1)]


def test_delimited_files_each_have_a_header(spark, tmp_path):
    p = _files(tmp_path, "a,b\n1,2\na,b\n", "a,b\n3,4\n")
    assert sorted(map(tuple, io.read_table(spark, p).collect())) == [("1", "2"), ("3", "4"), ("a", "b")]


def test_leading_lines_of_a_file_in_several_blocks(spark, tmp_path):
    p = _files(tmp_path, "junk\n" + "".join(f"{i} x\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = io.read_table(spark, p, header=False, skip_lines=1)
        assert df.rdd.getNumPartitions() > 4
        assert df.agg(F.count("*"), F.countDistinct("_c0")).first()[:] == (20_000, 20_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_value_beyond_the_first_rows_keeps_its_column(spark, tmp_path):
    p = _files(tmp_path, "a,b,c\n" + "1,?,?\n" * 3000 + "1,2,?\n")
    assert io.read_table(spark, p).columns == ["a", "b"]


def test_files_that_are_empty_or_too_short(spark, tmp_path):
    assert io.read_table(spark, _files(tmp_path, "\n \n")).count() == 0
    (tmp_path / "s").mkdir()
    assert io.read_table(spark, _files(tmp_path / "s", "one\n"), skip_lines=3).count() == 0


def test_forest_without_a_key_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in rng.normal(size=(900, 2))] + [(0.5, 0.5)] * 450 + [(None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double").na.fill(0.0)
    one, other = (iforest.fit(d, ["a", "b"], n_trees=20, seed=5) for d in (df.coalesce(1), df.orderBy("b").repartition(7)))
    assert one.offset == other.offset
    assert all(np.array_equal(one.trees[k], other.trees[k]) for k in one.trees)


def test_paths_equal_a_walk_node_by_node():
    """Rows go down a tree laid out by level, all together; values that are missing or infinite take the same turns."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 3)), 1)
    nodes = pd.concat([iforest._grow(["a", "b", "c"], 64, 1)(pd.DataFrame(x[rng.integers(0, 300, n)], columns=["a", "b", "c"]).assign(tree=t))
                       for t, n in enumerate((64, 64, 1, 64, 2))])
    tr = iforest._pack(nodes[nodes.tree != 1], 6)
    x[0, 0], x[1, 1], x[2, 2] = np.nan, np.inf, -np.inf

    def walk(row, t):
        node = depth = 0
        while tr["feature"][t, node] >= 0:
            side = "left" if row[tr["feature"][t, node]] < tr["threshold"][t, node] else "right"
            node, depth = tr[side][t, node], depth + 1
        return depth + float(iforest.c_factor(tr["size"][t, node]))

    want = [np.mean([walk(row, t) for t in (0, 2, 3, 4)]) for row in x]
    trees = iforest._laid_out(tr)
    assert len(trees) == 4 and np.allclose(iforest._path_lengths(x, trees), want, rtol=1e-14)


def test_copies_are_dealt_out_in_lots(spark, monkeypatch):
    monkeypatch.setattr(iforest, "DEALT", 100)
    df = spark.createDataFrame([(1.0,)] * 1050 + [(2.0,)], "a double")
    keyed = iforest._copies_apart(df, ["a"])
    assert keyed.count() == 1051 == keyed.select("_key").distinct().count()


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_first_trees_equal_a_shorter_fit(spark, task):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(z), float(x + 0.3 * e > 0) if task == "classification" else float(x + e)) for x, z, e in rng.normal(size=(400, 3))]
    df = spark.createDataFrame(rows, "a double, b double, y double").withColumn("y", F.col("y").cast("int") if task == "classification" else F.col("y"))
    grid = {"maxIter": (2, 6), "minInstancesPerNode": (1,), "maxDepth": (3,), "minInfoGain": (0.0,)}
    both = models.ml_efficiency(df, df, ["a", "b"], "y", task=task, grid=grid).collect()
    alone = {}
    for n in (2, 6):
        for r in models.ml_efficiency(df, df, ["a", "b"], "y", task=task, grid={**grid, "maxIter": (n,)}).collect():
            alone[r.criterion, r.params] = r
    assert {r.criterion for r in both} == set(models.CRITERIA[task])
    for r in both:
        assert tuple(r) == pytest.approx(tuple(alone[r.criterion, r.params]))


def test_machines_beyond_two_classes_are_one_against_the_rest(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense(4.0 * (i % 3), (i % 3 - 1.0) ** 2, 0.01 * i), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, ["features", "y"]).coalesce(1).cache()
    learner = models._classifier("svm", 60, 3, 3, 1)
    learner.getClassifier().setMaxIter(5)
    out = learner.fit(df).transform(df)
    assert out.where("prediction = y").count() >= 55
    df.unpersist()


def test_summary_releases_what_it_held(spark):
    spark.catalog.clearCache()
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("a"), F.sin("id").alias("b"),
                                 (F.col("id") % 2).cast("string").alias("y"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    row = compare.compare_full(df, df, "y", ["a", "b"], "k", metrics=["tables", "tstr"]).first()
    assert row.ks_stat_mean == 0.0 and row.class_abs_prop_diff_max == 0.0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_labels_and_weights_are_attached_without_a_shuffle(spark):
    """Rows of a class must not all go to one task: its number and weight are brought to the rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("c"), F.sin("id").alias("a"))
        r, _, _ = models.encode_labels(df, df, "c")
        for d in (r, models._balanced_weights(df.select("a", F.col("c").cast("double").alias("y")))):
            plan = d._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
