"""The perceptron on blocks of rows is Spark's; balls of both sides come from one look at each pair."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fidspark.operators import models, nn, perceptron


def _classes(spark, n=128 * 20):
    """Rows of three classes; Spark's loss is a mean over blocks of 128 rows, so there are only whole ones."""
    x = [F.sin("id"), F.cos(F.col("id") * 3), F.sin(F.col("id") * 0.37)]
    y = (x[0] * x[1] + x[2] > 0).cast("double") + (x[0] > 0.5).cast("double")
    return spark.range(n).select(array_to_vector(F.array(*x)).alias("features"), y.alias("y")).coalesce(1).cache()


@pytest.mark.parametrize("layers", [[3, 10, 3], [3, 8, 5, 3]])  # either kernel
def test_block_perceptron_takes_the_steps_of_sparks(spark, monkeypatch, layers):
    df = _classes(spark)
    learners = [kind(featuresCol="features", labelCol="y", probabilityCol="prob", layers=layers, seed=42, maxIter=8)
                for kind in (MultilayerPerceptronClassifier, perceptron.BlockPerceptron)]
    theirs, ours = [x.fit(df) for x in learners]
    assert type(ours) is type(theirs) and ours.weights.toArray() == pytest.approx(theirs.weights.toArray(), abs=1e-9)
    prob = [np.array([r.prob.toArray() for r in m.transform(df).select("prob").collect()]) for m in (theirs, ours)]
    assert prob[1] == pytest.approx(prob[0], abs=1e-9)
    monkeypatch.setattr(perceptron, "BLOCK_BYTES", 1000)  # many blocks and slices: the same sums
    monkeypatch.setattr(perceptron, "SLICE_BYTES", 1000)
    cut = learners[1].fit(df.repartition(5))
    assert cut.weights.toArray() == pytest.approx(theirs.weights.toArray(), abs=1e-6)


def test_kernels_agree_and_give_the_slope_of_the_loss():
    rng, layers = np.random.default_rng(1), [2, 6, 3]
    x, y = rng.normal(size=(500, 2)), rng.integers(0, 3, 500).astype(np.int32)
    blocks, w = [(x.tobytes(), y.tobytes())], rng.normal(size=2 * 6 + 6 + 6 * 3 + 3)
    one, any_ = (f(layers, w, blocks) for f in (perceptron._one_hidden, perceptron._any_layers))
    assert one[0] == any_[0] == 500 and one[1] == pytest.approx(any_[1]) and one[2] == pytest.approx(any_[2], abs=1e-9)
    for i in range(len(w)):
        h = np.zeros(len(w))
        h[i] = 1e-5
        up, down = (perceptron._one_hidden(layers, w + s * h, blocks)[1] for s in (1, -1))
        assert one[2][i] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_steps_of_a_perceptron_run_few_tasks(spark, monkeypatch):
    """Every step is a task per partition, which costs as much as many rows: partitions that follow each other are one."""
    cores, seen = spark.sparkContext.defaultParallelism, []

    def one_step(f, x, *rest):
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        f(x)
        status = spark.sparkContext.statusTracker()
        for job in range(before, spark.sparkContext._jsc.sc().dagScheduler().nextJobId()):
            seen.extend(status.getStageInfo(s).numTasks for s in status.getJobInfo(job).stageIds)
        return x

    monkeypatch.setattr(perceptron, "minimized", one_step)
    learner = models._classifier("mlp", 100, 3, 3, 42)
    learner.fit(_classes(spark, 2000).repartition(cores * perceptron.ROUNDS))
    assert seen and seen[-1] == cores


def test_minimum_of_a_valley():
    def f(x):  # Rosenbrock's
        a, b = x
        return 100 * (b - a * a) ** 2 + (1 - a) ** 2, np.array([-400 * a * (b - a * a) - 2 * (1 - a), 200 * (b - a * a)])

    assert perceptron.minimized(f, np.array([-1.2, 1.0]), 200, 1e-12) == pytest.approx([1, 1], abs=1e-4)
    start = np.array([1.0, 2.0])
    assert perceptron.minimized(lambda x: (np.nan, x * np.nan), start, 10, 1e-6) is start  # no step is better


def _vectors(spark, n, salt, cols, missing=False):
    """Points in 16 dimensions, some of them equal, far from the origin; with ``missing``, every 31st lacks a number."""
    at = F.when(F.col("id") % 9 == 0, F.lit(3)).otherwise(F.col("id") % 40)
    df = spark.range(n).select((F.col("id") * 7 % 1009).alias("k"), *[
        (F.lit(50.0) + F.sin(at * (i + 1) + salt) + F.sin(F.col("id") * (i + 2)) * F.when(F.col("id") % 9 == 0, 0.0).otherwise(0.05)).alias(c)
        for i, c in enumerate(cols)])
    return df.withColumn(cols[2], F.when(F.col("k") % 31 != 0, F.col(cols[2]))) if missing else df


def _plain_prdc(r, s, k):
    def dist(a, b):
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))

    def radii(x):
        d = dist(x, x)
        d[np.arange(len(x)), np.arange(len(x))] = np.inf
        return np.sort(d, axis=1)[:, k - 1]

    d, rad_r, rad_s = dist(r, s), radii(r), radii(s)
    return (d < rad_r[:, None]).any(axis=0).mean(), (d < rad_s[None, :]).any(axis=1).mean(), (d < rad_r[:, None]).sum(axis=0).mean() / k, \
        (d.min(axis=1) < rad_r).mean()


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("scale", [1.0, 1e160])  # squares that overflow go another way
def test_balls_of_both_sides_are_counted_from_one_look_at_each_pair(spark, monkeypatch, missing, scale):
    cols, grids, grid = [f"x{i}" for i in range(16)], [], nn._grid
    monkeypatch.setattr(nn, "_grid", lambda *a: grids.append(a) or grid(*a))
    monkeypatch.setattr(nn, "BLOCK_BYTES", 8 * 18 * 60)  # several blocks of either side
    r, s = _vectors(spark, 220, 0.0, cols, missing), _vectors(spark, 150, 0.05, cols, missing)
    if scale != 1.0:
        r, s = (d.select("k", *[(F.col(c) * scale).alias(c) for c in cols]) for d in (r, s))
    got = nn.prdc(r, s, cols, "k", "k").first()
    assert len(grids) == 3  # radii of both sides, then all pairs of a real and a synthetic row
    full = [np.array([x[1:] for x in d.collect() if x[3] is not None], float) / scale for d in (r, s)]
    want = np.array(_plain_prdc(*full, 5))
    if missing:  # rows without a number lie in no ball and are left out of coverage
        share = [len(f) / d.count() for f, d in zip(full, (r, s))]
        want *= [share[1], share[0], share[1], 1.0]
    if scale == 1.0:
        assert tuple(got) == pytest.approx(tuple(want))
    else:
        assert tuple(got) == (0.0, 0.0, 0.0, None if got.coverage is None else 0.0)  # distances overflow: none is less than another


def test_single_pairs_are_looked_at_only_where_a_slice_may_hold_neighbours(monkeypatch):
    rng, seen, exact = np.random.default_rng(3), [], nn._Dense.exact
    monkeypatch.setattr(nn._Dense, "exact", lambda self, x, row, col: seen.append(len(row)) or exact(self, x, row, col))
    monkeypatch.setattr(nn, "SLICE_CELLS", 2 * 512 * 100)
    base, query = rng.normal(size=(3000, 20)), rng.normal(size=(700, 20))
    base[100:160] = base[40]  # ties go to the smaller key
    query[:30] = base[40]
    keys, own = np.arange(3000) * 2, np.arange(700) * 3
    held = nn._Dense(base)
    d = np.sqrt(((query[:, None, :] - base[None, :, :]) ** 2).sum(axis=2))
    for exclude in (False, True):
        e = np.where(exclude & (own[:, None] == keys[None, :]), np.inf, d)
        by = np.lexsort((np.broadcast_to(keys, e.shape), e), axis=1)[:, :4]
        dist, key = held.top(keys, own, query, 4, exclude)
        assert (key == keys[by]).all() and dist == pytest.approx(np.take_along_axis(e, by, 1))
    assert sum(seen) < 0.05 * 2 * d.size
    radius, q_radius = np.where(np.arange(3000) % 5, 4.0, np.nan), np.where(np.arange(700) % 3, 4.5, 0.0)
    assert (held.inside(radius, query) == (d < radius).sum(axis=1)).all()
    near, inside, balls = held.mutual(keys, radius, q_radius, query)
    assert near == pytest.approx(d.min(axis=1)) and (inside == (d < radius).sum(axis=1)).all() and (balls == (d < q_radius[:, None]).sum(axis=0)).all()
