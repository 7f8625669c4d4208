"""Folds of counted copies, row numbers with a hot group, joins by block, modes, the encoder chain, models, reports."""

import glob

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from fidspark.operators import mixture, models, nn, prep, synth
from fidspark.plans import compare
from fidspark.spec import TableSpec


def test_folds_of_equal_rows_hold_both_classes(spark):
    df = spark.range(120).select((F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    got = prep.fold_copies(df, ["x"], "y", 5).toPandas()
    assert got.w.sum() == 120
    per = got.groupby(["fold", "y"]).w.sum()
    assert len(per) == 10 and set(per) == {12.0}


def test_detection_of_equal_tables_is_near_one(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("double").alias("a"))
    assert models.detection_score(df, df, ["a"]).first()[0] > 0.9


def test_empty_side_gives_null_propensity(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("a"))
    assert models.propensity(df, df.where("a < 0"), ["a"])[1].first()["pmse"] is None


def test_row_numbers_with_a_hot_group_and_nulls(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("v"), (F.col("id") % 50).cast("string"))).alias("g"))
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    got = {r["id"]: r["rn"] for r in prep.number_rows(df, ["g"], "id").collect()}
    assert got == {r["id"]: r["rn"] for r in plain.collect()}
    assert prep.number_rows(df.where("id < 0"), ["g"], "id").count() == 0


def test_neighbours_within_groups_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.arange(400), "g": np.where(np.arange(400) % 3 > 0, "hot", None), "a": rng.integers(0, 30, 400).astype(float)})
    df = spark.createDataFrame(pdf)
    space = nn.Space(num=["a"])
    one, many = (sorted(map(tuple, nn.knn_within(df, "k", "g", space, 3, block_bytes=b).collect())) for b in (1 << 25, 2000))
    assert one == many and len(one) == 1200
    for key, rank, dist, other in one[:60]:
        own = pdf[(pdf.g.isna() if pdf.g.isna()[key] else pdf.g == pdf.g[key]) & (pdf.k != key)]
        near = sorted((abs(a - pdf.a[key]), k) for a, k in zip(own.a, own.k))[rank - 1]
        assert (dist, other) == near


def test_smote_keeps_a_null_class_and_skips_single_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 1.0), (3, None, 5.0), (4, None, 7.0), (5, "b", 9.0)], "k long, g string, x double")
    got = {r["k"]: (r["g"], r["x"]) for r in synth.smote(df, "k", "g", ["x"]).collect()}
    assert set(got) == {1, 2, 3, 4} and 5.0 <= got[3][1] <= 7.0 and got[3][0] is None


def test_draws_follow_their_shares(spark):
    train = spark.range(1000).select(F.when(F.col("id") < 700, "a").otherwise("b").alias("c"))
    got = synth.impute_baseline(train, spark.range(4000).select("id"), "c", "cat", "id")
    assert got.count() == 4000
    assert got.where("c = 'a'").count() / 4000 == pytest.approx(0.7, abs=0.03)


def test_alpha_beta_of_a_table_with_itself(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(500), "a": rng.normal(size=500), "b": rng.normal(size=500)}))
    row = nn.alpha_beta(df, df, ["a", "b"], "k", "k").first()
    assert row["delta_precision_alpha"] > 0.99 and row["delta_coverage_beta"] > 0.99
    far = df.withColumn("a", F.col("a") + 50)
    assert nn.alpha_beta(df, far, ["a", "b"], "k", "k").first()["delta_precision_alpha"] < 0.1


def test_modes_find_two_clusters_and_decode(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, 700), rng.normal(100, 2, 300), np.zeros(50)])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), "x": x})).withColumn("old", F.col("x"))
    modes = mixture.fit_modes(df, "x", 4, special=[0.0])
    assert min(abs(m - 100) for m in modes.mean) < 5 and min(abs(m) for m in modes.mean) < 5
    e = mixture.encode_modes(df, "x", modes, "k")
    assert e.where("x_mode = 0").count() == 50
    back = mixture.decode_modes(e.withColumn("inside", F.abs("x_u") < mixture.CLIP), "x", modes)
    assert back.where("(inside OR old = 0) AND abs(x - old) > 1e-6").count() == 0


def test_modes_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "k long, x double")
    modes = mixture.fit_modes(df, "x")
    assert modes.mean == (5.0,)
    assert {r["x"] for r in mixture.decode_modes(mixture.encode_modes(df, "x", modes), "x", modes).collect()} == {5.0, None}
    assert mixture.fit_modes(df.where("k > 9"), "x").width == 1


def test_encoder_unknown_and_rare(spark):
    train = spark.createDataFrame([(i, float(i), "a" if i < 8 else "b" if i == 8 else None, i % 2) for i in range(10)],
                                  "k long, n double, c string, y int")
    spec = TableSpec(num=("n",), cat=("c",), target="y")
    enc = mixture.Encoder(spec, "k", scale="minmax", min_frequency=0.2).fit(train)
    got = {r["k"]: (r["n"], r["c"]) for r in enc.split(enc.transform(train)).collect()}
    assert got[0][0] == 0.0 and got[9][0] == 1.0
    assert got[0][1] == got[9][1] != got[8][1]  # a null takes the most frequent category, a rare one its own
    assert enc.inverse(enc.transform(train)).where("k = 8").first()["c"] == "__rare__"


def test_efficiency_of_a_regression(spark):
    rng = np.random.default_rng(9)
    a = rng.uniform(size=400)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": rng.uniform(size=400), "y": 3 * a}))
    grid = {"maxIter": (5,), "minInstancesPerNode": (1, 10), "maxDepth": (4,), "minInfoGain": (0.0,)}
    rows = models.ml_efficiency(df, df, ["a", "b"], "y", task="regression", grid=grid).collect()
    assert {r["criterion"] for r in rows} == {"r2", "rmse"} and min(r["test_r2"] for r in rows) > 0.9
    assert np.prod([len(v) for v in models.EFFICIENCY_GRID.values()]) == 36


def test_runs_report_is_averaged_and_written(spark, tmp_path):
    df = spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    runs = compare.compare_runs(df, [df, df.withColumn("x", F.col("x") + 1)], "y", ["x"], "id", metrics=["neighbours"])
    compare.write_reports(runs, str(tmp_path))
    averaged = pd.concat(map(pd.read_csv, glob.glob(f"{tmp_path}/summary_metrics/*.csv")))
    assert dict(zip(averaged.metric, averaged.value))["nn_near_duplicate_rate"] > 0.5
    with pytest.raises(ValueError):
        compare.compare_full(df, df, "y", ["x"], "id", metrics=["nothing"])
