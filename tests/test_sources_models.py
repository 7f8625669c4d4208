"""Scans on fixture files, isolation forest and the ML operators on known-answer data."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest

from fidspark.operators import iforest, models
from fidspark.sources import io


def _write(text):
    d = tempfile.mkdtemp(prefix="fidspark-src-")
    p = os.path.join(d, "t.data")
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_csv_with_header_and_question_marks(spark):
    p = _write("a,b,c\n1,?,x\n\n2,3,y\n")
    df = io.read_table(spark, p)
    assert df.columns == ["a", "b", "c"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("1", None, "x"), ("2", "3", "y")]


def test_numeric_first_line_is_kept_as_data(spark):
    p = _write("0.73 0 1 2.5\n0.24 1 0 1.5\n")
    df = io.read_table(spark, p, names=["age", "f1", "f2", "tsh"])
    assert df.count() == 2
    assert df.columns == ["age", "f1", "f2", "tsh"]


def test_skip_and_strip_suffix(spark):
    p = _write("|junk line\n25, Private, >50K.\n30, State-gov, <=50K.\n")
    df = io.read_table(spark, p, header=False, skip_lines=1, strip_suffix=".")
    vals = sorted(r[-1] for r in df.collect())
    assert vals == ["<=50K", ">50K"]


def test_all_null_columns_dropped(spark):
    p = _write("a,b\n1,?\n2,?\n")
    assert io.read_table(spark, p).columns == ["a"]


def test_iforest_flags_far_points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 2))
    x[:10] += 12.0
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(k=np.arange(1000)))
    forest = iforest.fit(df, ["a", "b"], n_trees=50, seed=1, key="k")
    sc = iforest.score_samples(forest, df, keep=["k"]).toPandas().sort_values("k")
    assert sc.score.to_numpy()[:10].mean() < sc.score.to_numpy()[10:].mean()
    assert (sc.decision < 0).mean() == pytest.approx(0.05, abs=0.01)


def test_propensity_separable(spark):
    rng = np.random.default_rng(2)
    r = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=300)}))
    s = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=300) + 6.0}))
    _, m = models.propensity(r, s, ["a"], folds=3)
    assert m.first()["domain_classifier_auroc"] > 0.99
