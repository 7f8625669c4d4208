"""One class or value holding most rows, null labels and values, columns without a dictionary."""

from pyspark.sql import functions as F

from fidspark.operators import encode, prep


def _classes(spark):
    label = F.when(F.col("k") % 10 < 7, "hot").when(F.col("k") % 10 < 9, "cold")
    return spark.range(2000).withColumnRenamed("id", "k").withColumn("y", label)


def test_stratified_fold_spreads_each_class_evenly(spark):
    got = prep.stratified_fold(_classes(spark), "y", 5, "k").groupBy("y", "fold").count().collect()
    assert {(r["y"], r["fold"]): r["count"] for r in got} == {
        (y, f): n for y, n in (("hot", 280), ("cold", 80), (None, 40)) for f in range(5)}


def test_stratified_split_takes_the_share_of_each_class(spark):
    got = prep.stratified_split(_classes(spark), "y", 0.25, "k").where("split = 'test'").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {"hot": 350, "cold": 100, None: 50}


def test_stratified_ranks_are_not_one_task_per_class(spark):
    plan = prep.stratified_fold(_classes(spark), "y", 5, "k")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("_part#" in line for line in windows)


def test_snap_keeps_hot_values_and_nulls(spark):
    real = spark.createDataFrame([(1.0,), (4.0,), (None,)], "x double")
    syn = spark.createDataFrame([(i, 2.0) for i in range(50)] + [(50, None), (51, 9.0), (52, 2.5)], "k long, x double")
    got = {r["k"]: r["snapped"] for r in prep.snap_to_reference(syn, real, "x", "k").collect()}
    assert got == {**{i: 1.0 for i in range(50)}, 50: None, 51: 4.0, 52: 1.0}


def test_ordinal_of_an_empty_dictionary_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, c string")
    none = encode.fit_dictionary(df.limit(0), ["c"])
    assert {r["k"]: r["c"] for r in encode.ordinal(df, ["c"], none).collect()} == {1: 0, 2: 0}
    assert {r["k"]: r["c"] for r in encode.ordinal(df, ["c"], none, unknown="null").collect()} == {1: None, 2: None}
