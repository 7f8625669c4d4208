"""Identities and known answers (no oracle needed)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fidspark.operators import assoc, cdf, encode, freq, prep, scores, stats
from fidspark.plans import compare


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.normal(size=n)
    x[: n // 3] = 0.5  # one value holds a third of all rows
    y = rng.integers(0, 5, size=n).astype(float)
    pdf = pd.DataFrame({"k": np.arange(n), "x": x, "y": y, "lab": rng.choice(["a", "b"], size=n)})
    return spark.createDataFrame(pdf), pdf


def test_prefix_sums_match_pandas_with_hot_value(spark, skewed):
    df, pdf = skewed
    counts = cdf.long_form(df, ["x"]).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    pre = cdf.prefix_sums(counts, ["feature"], "value", ["n"], buckets=7)
    got = pre.table.toPandas().sort_values("value")
    exp = pdf.x.value_counts().sort_index().cumsum()
    assert np.allclose(got["cum_n"].to_numpy(), exp.to_numpy())
    assert np.allclose(got["next_value"].to_numpy()[:-1], exp.index.to_numpy()[1:])


def test_exact_quantiles_match_numpy(spark, skewed):
    df, pdf = skewed
    nc = stats.NumericComparison(df, df, ["x", "y"], buckets=5)
    q = nc.tail_quantiles().toPandas().set_index("feature")
    for c in ["x", "y"]:
        for p, nm in [(0.01, "q01"), (0.05, "q05"), (0.95, "q95"), (0.99, "q99")]:
            assert q.loc[c, f"real_{nm}"] == pytest.approx(np.quantile(pdf[c], p))


def test_compare_with_itself_is_zero(spark, skewed):
    df, _ = skewed
    r = df.select("x", "y", "lab")
    row = compare.compare_summary(r, r, label="lab", num=["x", "y"]).first()
    for k in ["class_abs_prop_diff_mean", "tail_abs_diff_mean", "univariate_outlier_rate_gap_mean",
              "mean_abs_spearman_corr_diff", "ks_stat_mean", "range_violation_rate_below_min"]:
        assert row[k] == pytest.approx(0.0, abs=1e-12)


def test_class_proportions_sum_to_one(spark, skewed):
    df, _ = skewed
    t = stats.class_distribution(df, df.limit(100), "lab").toPandas()
    assert t.real_prop.sum() == pytest.approx(1.0)
    assert t.synthetic_prop.sum() == pytest.approx(1.0)


def test_spearman_matches_pandas(spark, skewed):
    df, pdf = skewed
    other = df.select((F.col("x") * -1).alias("x"), "y")
    got = assoc.spearman_diff_pairs(df.select("x", "y"), other, ["x", "y"]).first()
    assert got["real_corr"] == pytest.approx(pdf[["x", "y"]].corr(method="spearman").iloc[0, 1])
    assert got["synthetic_corr"] == pytest.approx(-got["real_corr"])


def test_ks_and_wasserstein_known(spark):
    a = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    b = spark.createDataFrame([(float(i) + 5,) for i in range(10)], "x double")
    nc = stats.NumericComparison(a, b, ["x"], buckets=3)
    assert nc.ks().first()["ks_statistic"] == pytest.approx(0.5)
    # W1 of a shift by 5 over a real range of 9
    assert nc.wasserstein().first()["wd"] == pytest.approx(5 / 9)


def test_auroc_separable_and_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)], "y int, s double")
    assert scores.auroc(df, "y", "s").first()[0] == pytest.approx(1.0)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert scores.auroc(tied, "y", "s").first()[0] == pytest.approx(0.5)


def test_ordinal_roundtrip_and_unknown(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    test = spark.createDataFrame([("b",), ("z",)], "c string")
    dic = encode.fit_dictionary(train, ["c"])
    enc = {r[0] for r in encode.ordinal(test, ["c"], dic).collect()}
    assert enc == {1, 3}


def test_jsd_identical_is_zero(spark, skewed):
    df, _ = skewed
    assert freq.js_distance(df, df, ["lab"]).first()["jsd"] == pytest.approx(0.0, abs=1e-12)


def test_drop_all_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, c string")
    assert [tuple(r) for r in prep.drop_all_duplicates(df).collect()] == [(2, "b")]


def test_align_arity_error(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        prep.align(a, b)


def test_buckets_are_found_by_binary_search(spark):
    """As many bounds as lie below a value, whatever their number; no lambda runs over all bounds for each row."""
    for n in (1, 2, 3, 7, 8, 199):
        bounds = [float(i // 2) for i in range(n)]
        df = spark.createDataFrame([(x / 2,) for x in range(-2, n + 4)], "v double").withColumn("_bounds", F.array(*[F.lit(b) for b in bounds]))
        assert [(r["v"], r["_bucket"]) for r in cdf._with_bucket(df, "v", n).collect()] == [
            (x / 2, sum(b < x / 2 for b in bounds)) for x in range(-2, n + 4)]
    counts = spark.range(50).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    assert "lambdafunction" not in cdf.prefix_sums(counts, [], "v", ["n"], buckets=9).table._jdf.queryExecution().executedPlan().toString()


def test_auroc_of_all_groups_in_one_pass(spark):
    rows = [(f, int((i * 7 + f) % 3 == 0), float(i * (f + 3) % 11)) for f in range(3) for i in range(40)] + [(3, 1, 0.5)]
    df = spark.createDataFrame(rows, "f int, y int, s double")
    got = {r["f"]: r["auroc"] for r in scores.auroc(df, "y", "s", by=["f"]).collect()}
    for f in range(4):
        one = scores.auroc(df.where(F.col("f") == f), "y", "s").first()[0]
        assert got[f] == (None if f == 3 else pytest.approx(one))


def test_rows_stay_whole_while_they_get_their_ranks(spark, monkeypatch):
    """Ranks come to the rows column by column, by broadcast or shuffle; no row is taken apart and put together again."""
    from fidspark.operators import assoc

    df = spark.range(400).select((F.col("id") % 2).cast("string").alias("g"), F.when(F.col("id") % 9 > 0, F.floor(F.col("id") / 3 % 50)).cast("double").alias("a"),
                                 F.when(F.col("id") < 250, 1.0).otherwise(F.col("id").cast("double")).alias("b"))
    pdf = df.toPandas()
    for small in (cdf.SMALL_RANKS, 0):
        monkeypatch.setattr(cdf, "SMALL_RANKS", small)
        ranked = assoc.rank_columns(df, ["a", "b"], group="g")
        assert "pivot" not in ranked._jdf.queryExecution().optimizedPlan().toString().lower()
        got = ranked.orderBy("_rid").toPandas()
        want = pdf.groupby("g")[["a", "b"]].rank()
        assert got[["a", "b"]].equals(want)
