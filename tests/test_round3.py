"""Exact KS, Beta noise, weight priors of mixtures, covering splits, observed rejection, SMOTE in encoded space, array sources."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fidspark.functions import kolmogorov_sf
from fidspark.functions.numeric import beta_cdf, beta_ppf, digamma, ks_exact, normal_cdf
from fidspark.operators import encode, mixture, prep, stats, synth
from fidspark.sources import arrays


def test_exact_ks_equals_enumeration():
    for m, n in [(1, 1), (2, 3), (4, 4), (5, 3), (6, 4)]:
        found = []
        for first in itertools.combinations(range(m + n), m):
            step = np.isin(np.arange(m + n), first)
            found.append(np.abs(np.cumsum(step) * n - np.cumsum(~step) * m).max())
        for d in set(found):
            assert ks_exact(d / (m * n), m, n) == pytest.approx(np.mean(np.array(found) >= d), abs=1e-12)
    assert ks_exact(0.0, 5, 7) == 1.0 and math.isnan(ks_exact(0.5, 0, 7))


def test_exact_ks_agrees_with_the_series_for_many_rows(spark):
    d, m, n = 0.045, 3000, 2000
    lam = d * math.sqrt(m * n / (m + n))
    series = spark.range(1).select(kolmogorov_sf(F.lit(lam))).first()[0]
    assert ks_exact(d, m, n) == pytest.approx(series, rel=0.06)
    assert 0 < ks_exact(0.5, 500, 400) < 1e-40


def test_ks_takes_the_exact_value_for_small_samples(spark):
    r = spark.createDataFrame([(float(i), None) for i in range(8)], "a double, b double")
    s = spark.createDataFrame([(float(i) + 3.5, 1.0) for i in range(6)], "a double, b double")
    got = {x["feature"]: x for x in stats.ks_two_sample(r, s, ["a", "b"]).collect()}
    assert got["a"]["p_value"] == pytest.approx(ks_exact(got["a"]["ks_statistic"], 8, 6))
    assert got["b"]["p_value"] is None or got["b"]["ks_statistic"] is None


def test_distribution_functions():
    x = np.linspace(-6, 6, 101)
    assert np.allclose(normal_cdf(x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], atol=1e-14)
    assert np.allclose(normal_cdf(encode.normal_ppf(np.array([1e-6, 0.2, 0.5, 0.99]))), [1e-6, 0.2, 0.5, 0.99], rtol=1e-6)
    assert digamma(np.array([1.0, 0.5, 0.001, 30.0])) == pytest.approx([-0.5772156649, -1.9635100260, -1000.5755719, 3.3844378], rel=1e-7)
    u = np.linspace(0.001, 0.999, 57)
    assert np.allclose(beta_ppf(u, 1, 1), u, atol=1e-12)
    t = beta_ppf(u, 2, 2)
    assert np.allclose(3 * t**2 - 2 * t**3, u, atol=1e-12)
    assert np.allclose(beta_cdf(beta_ppf(u, 0.5, 0.5), 0.5, 0.5), u, atol=1e-10)
    assert np.allclose(beta_ppf(u, 0.5, 0.5), np.sin(np.pi * u / 2) ** 2, atol=1e-9)


def test_beta_noise_has_the_moments_of_its_distribution(spark):
    df = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("y"))
    for f in (0.5, 3.0):
        noise = encode.dequantize(df, ["x"], "k", f, dist="beta").toPandas()["x"] - np.arange(6000) % 7
        assert abs(noise.mean()) < 0.02 and noise.var() == pytest.approx(1 / (4 * (2 * f + 1)), rel=0.08)
        assert noise.abs().max() <= 0.5


def test_quantile_map_goes_back(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("x"))
    grid = encode.quantile_grid(df, ["x"], 100)
    back = encode.quantile_normal(encode.quantile_normal(df, grid), grid, inverse=True).toPandas()
    assert np.allclose(back["x"], back["k"] ** 2, atol=1e-2)


def test_a_mixture_drops_the_components_it_does_not_need(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(50, 2, 1000), [np.nan]])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).select(F.nanvl("x", F.lit(None).cast("double")).alias("x"))
    modes = mixture.fit_modes(df, "x")
    assert len(modes.mean) == 2 and modes.weight == pytest.approx((0.75, 0.25), abs=0.01)
    assert modes.mean == pytest.approx((0, 50), abs=0.3) and modes.std == pytest.approx((1, 2), rel=0.25)
    assert mixture.fit_modes(df.where("x > 1e9"), "x").width == 1 and mixture.fit_modes(df.where("x > 1e9"), "x").weight == (1.0,)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_covering_split_holds_every_category(spark, seed):
    df = spark.createDataFrame([(i, f"a{i % 40}", f"b{i % 7}" if i % 5 else None, "x") for i in range(400)], "k long, a string, b string, split2 string")
    got = prep.covering_split(df, ["a", "b"], [0.02, 0.98], "k", seed)
    assert got.columns == [*df.columns, "split"] and got.count() == 400
    assert prep.covering_split_check(got, ["a", "b"]).count() == 0
    plain = prep.random_split(df, [0.02, 0.98], "k", seed).where("split = 'train'").count()
    assert plain <= got.where("split = 'train'").count() <= plain + 47


def test_rejection_is_counted_in_the_same_pass_and_refilled(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 10).cast("double").alias("x"))
    rows, seen = prep.reject_and_count(df, {"x": (2.0, 5.0)})
    assert len(rows.collect()) == 40 and seen.get == {"n_kept": 40, "n_rejected": 60}
    draws = []

    def draw(i, n):
        draws.append(n)
        return spark.range(n).select((F.col("id") % 10).cast("double").alias("x"))

    out, kept, rejected = prep.draw_until(draw, {"x": (2.0, 5.0)}, 50, str(tmp_path / "accepted"))
    assert out.count() == 50 and out.where("x < 2 OR x > 5").count() == 0
    assert draws[0] == 50 and len(draws) == 2 and kept >= 50 and kept + rejected == sum(draws)


def test_smote_in_encoded_space_keeps_types_and_domains(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.arange(300), "label": np.where(np.arange(300) % 3 == 0, "a", "b"), "x": rng.lognormal(size=300), "n": rng.integers(0, 50, 300).astype(float),
                        "c": rng.choice(["u", "v", "w"], 300)})
    got = synth.smote_encoded(spark.createDataFrame(pdf), "k", "label", ["x", "n"], ["c"], k=4, n_quantiles=60).toPandas()
    assert sorted(got["k"]) == list(range(300)) and set(got["c"]) <= {"u", "v", "w"}
    assert got["x"].between(pdf["x"].min(), pdf["x"].max()).all() and got["n"].between(0, 49).all()
    both = got.merge(pdf, on="k")
    assert (both["label_x"] == both["label_y"]).all() and (both["x_x"] != both["x_y"]).mean() > 0.9


def test_split_arrays_equal_the_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    want = {}
    for split, n in (("train", 1000), ("test", 7)):
        want[split] = rng.normal(size=(n, 3)), rng.choice(["x", "yé", ""], size=(n, 2)), rng.integers(0, 4, n)
        for name, a in zip(("X_num", "X_cat", "y"), want[split]):
            np.save(tmp_path / f"{name}_{split}.npy", a)
    df = arrays.read_split_arrays(spark, str(tmp_path), rows_per_task=300)
    assert df.columns == ["split", "row", "num_0", "num_1", "num_2", "cat_0", "cat_1", "y"] and df.rdd.getNumPartitions() == 5
    for split, (num, cat, y) in want.items():
        got = df.where(F.col("split") == split).orderBy("row").toPandas()
        assert (got[["num_0", "num_1", "num_2"]].to_numpy() == num).all() and (got[["cat_0", "cat_1"]].to_numpy() == cat).all() and (got["y"] == y).all()
    np.save(tmp_path / "y_val.npy", np.array(["a", None], dtype=object))
    with pytest.raises(Exception, match="Python objects"):
        arrays.read_split_arrays(spark, str(tmp_path)).collect()


def test_numbers_by_ranges_are_contiguous(spark):
    from fidspark.operators import cdf

    rows = [("a" if i % 3 else None, f"v{i * 7919 % 1000:04d}", i % 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v string, n int").where("g IS NOT NULL").repartition(5)
    got = cdf.numbered(df, ["g"], [F.desc("n"), F.asc("v")]).collect()
    want = sorted((r for r in rows if r[0]), key=lambda r: (-r[2], r[1]))
    assert [(r["g"], r["v"], r["n"]) for r in sorted(got, key=lambda r: r["rn"])] == want
    assert sorted(r["rn"] for r in got) == list(range(1, len(want) + 1))


def test_a_binary_column_gets_its_ranks_without_a_shuffle(spark):
    from fidspark.operators import assoc, cdf

    pdf = pd.DataFrame({"a": np.arange(3000) % 2 * 1.0, "b": np.random.default_rng(0).normal(size=3000).round(2)})
    pdf.loc[5:9, "b"] = np.nan
    df = spark.createDataFrame(pdf).select("a", F.nanvl("b", F.lit(None).cast("double")).alias("b"))
    ranked = assoc.rank_columns(df, ["a", "b"]).orderBy("_rid").toPandas()
    assert np.allclose(ranked["a"], pdf["a"].rank()) and np.allclose(ranked["b"], pdf["b"].rank(), equal_nan=True)
    long = cdf.long_form(df, ["a"])
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    plan = cdf.attach_ranks(long, cdf.average_ranks(counts, ["feature"], "value", "n"), ["feature"], "value", "n")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_sinks_and_readers_round_trip(spark, tmp_path):
    """Files written by the sinks are read back by the scans."""
    import json

    from fidspark.sources import io
    from fidspark.spec import TableSpec

    info = {"task_type": "regression", "column_names": ["a", "c", "y"], "num_col_idx": [0], "cat_col_idx": [1], "target_col_idx": [2], "header": "infer"}
    (tmp_path / "info.json").write_text(json.dumps(info))
    spec = TableSpec.from_json(str(tmp_path / "info.json"))
    assert (list(spec.num), list(spec.cat), spec.target, spec.task) == (["a"], ["c"], "y", "regression")
    df = spark.createDataFrame([(1.5, "x", 10.0, "train"), (None, "y", 11.0, "test"), (2.5, None, 12.0, "train")], "a double, c string, y double, split string")
    io.write_table(df, str(tmp_path / "t"), partition_by=["split"])
    assert sorted(spark.read.parquet(str(tmp_path / "t")).where("split = 'train'").select("a", "c", "y").collect(), key=str) == sorted(
        df.where("split = 'train'").drop("split").collect(), key=str)
    for split in ("train", "test"):
        io.write_table(df.where(F.col("split") == split).drop("split"), str(tmp_path / split), "csv")
    back = io.read_splits(spark, {s: str(tmp_path / s) for s in ("train", "test")}, spec)
    assert dict(back.dtypes)["a"] == "double" and dict(back.dtypes)["y"] == "double" and dict(back.dtypes)["c"] == "string"
    assert back.count() == 3 and back.where("split = 'test'").first()["y"] == 11.0
    io.write_report({"r": df.agg(F.count("*").alias("n"))}, str(tmp_path / "rep"), "json")
    assert spark.read.json(str(tmp_path / "rep" / "r")).first()["n"] == 3
    marked = prep.null_marker_columns(spark.createDataFrame([("?", "x"), ("q", " ")], "c string, d string"), cat_fill="nan", cats=["c"])
    assert sorted(map(tuple, marked.collect()), key=str) == [("nan", "x"), ("q", None)]
    roles = {f.name: f.metadata for f in spec.annotate(df).schema.fields}
    assert roles == {"a": {"role": "num", "sdtype": "numerical"}, "c": {"role": "cat", "sdtype": "categorical"},
                     "y": {"role": "target", "sdtype": "numerical"}, "split": {}}
