"""Exact nearest neighbours against brute force, including the chunked path."""

import numpy as np
import pandas as pd
import pytest

from fidspark.operators import nn


def _brute(q, b, k, exclude_self=False):
    d = np.sqrt(((q[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("block_bytes", [nn.BLOCK_BYTES, 2000])
def test_knn_matches_brute_force(spark, block_bytes):
    rng = np.random.default_rng(0)
    q, b = rng.normal(size=(120, 3)), rng.normal(size=(150, 3))
    qd = spark.createDataFrame(pd.DataFrame(q, columns=["a", "b", "c"]).assign(k=np.arange(120)))
    bd = spark.createDataFrame(pd.DataFrame(b, columns=["a", "b", "c"]).assign(k=np.arange(150)))
    one = {c: (0.0, 1.0) for c in "abc"}
    got = nn.nearest(qd, "k", bd, "k", nn.Space(num=list("abc")), k=2, q_stats=one, b_stats=one,
                     block_bytes=block_bytes).toPandas().sort_values("q_key")
    exp = _brute(q, b, 2)
    assert np.allclose(got[["d1", "d2"]].to_numpy(), exp)


def test_self_join_excludes_diagonal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(k=np.arange(80)))
    one = {c: (0.0, 1.0) for c in "ab"}
    got = nn.nearest(df, "k", df, "k", nn.Space(num=["a", "b"]), k=1, exclude_self=True,
                     q_stats=one, b_stats=one).toPandas().sort_values("q_key")
    assert np.allclose(got["d1"].to_numpy(), _brute(x, x, 1, True)[:, 0])


def test_nn_distance_zero_for_copies(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 7)) for i in range(50)], "k long, a double, b double")
    rows, summ = nn.nn_distance(df, df, ["a", "b"], "k", "k")
    s = summ.first()
    assert s["nn_distance_mean"] == pytest.approx(0.0)
    assert s["nn_near_duplicate_rate"] == pytest.approx(1.0)


def test_ties_go_to_the_smaller_key_and_nulls_come_last(spark):
    base = spark.createDataFrame([(9, 1.0), (3, 1.0), (5, 1.0), (1, None), (7, 4.0)], "k long, a double")
    query = spark.createDataFrame([(100, 1.0), (101, None)], "k long, a double")
    for size in (nn.BLOCK_BYTES, 30):
        got = nn.knn(query, "k", base, "k", nn.Space(num=["a"]), k=5, block_bytes=size).orderBy("q_key", "rank").collect()
        assert [(r["b_key"], r["dist"]) for r in got[:5]] == [(3, 0.0), (5, 0.0), (9, 0.0), (7, 3.0), (1, None)]
        assert [(r["b_key"], r["dist"]) for r in got[5:]] == [(k, None) for k in (1, 3, 5, 7, 9)]


def test_unknown_categories_cost_one(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k long, c string")
    query = spark.createDataFrame([(10, "x"), (11, "z"), (12, "w"), (13, None)], "k long, c string")
    held = spark.createDataFrame([(20, "w")], "k long, c string")
    space = nn.Space(num=[], cat=["c"], metric="l1")
    known = base.unionByName(held).select("c")
    got = {r["q_key"]: r["dist"] for r in nn.knn(query, "k", base, "k", space, known=known).collect()}
    assert got == {10: 0.0, 11: 1.0, 12: 2.0, 13: 1.0}


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, 1.0)], "k long, a double")
    assert nn.knn(some.limit(0), "k", some, "k", nn.Space(num=["a"])).count() == 0
    assert nn.knn(some, "k", some.limit(0), "k", nn.Space(num=["a"])).count() == 0


def _points(spark, x, first=0):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(x.shape[1])]).assign(k=np.arange(first, first + len(x))))


@pytest.mark.parametrize("metric", ["euclidean", "l1"])
@pytest.mark.parametrize("dim,k", [(1, 1), (3, 3)])
def test_pruned_join_equals_brute_force(spark, metric, dim, k):
    """Clusters, equal points (ties, zero radii) and far points, blocks of a few rows."""
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(12, dim)) * 20
    b = np.round(8 * (centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, dim)))) / 8  # sums are exact
    b[:200] = b[0]  # one point that many rows share
    q = np.concatenate([b[::5], np.round(8 * (centres[rng.integers(0, 12, 150)] + rng.normal(size=(150, dim)))) / 8, np.full((3, dim), 500.0)])
    cols = [f"c{i}" for i in range(dim)]
    got = nn.knn(_points(spark, q), "k", _points(spark, b), "k", nn.Space(num=cols, metric=metric), k=k, block_bytes=8 * (2 + dim) * 120)
    diff = q[:, None, :] - b[None, :, :]
    d = np.sqrt((diff**2).sum(-1)) if metric == "euclidean" else np.abs(diff).sum(-1)
    want = {}
    for i, row in enumerate(d):
        for rank, j in enumerate(np.lexsort((np.arange(len(b)), row))[:k]):
            want[i, rank + 1] = (j, row[j])
    found = {(r["q_key"], r["rank"]): (r["b_key"], r["dist"]) for r in got.collect()}
    assert found.keys() == want.keys()
    assert found == want


def test_pruned_join_with_categories_nulls_and_self(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 40)) if i % 17 else None, float(rng.integers(0, 9)), "abcd"[rng.integers(0, 4)] if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c string")
    space = nn.Space(num=["a", "b"], cat=["c"], metric="l1", scale={"a": 10.0})
    big = nn.knn(df, "k", df, "k", space, k=3, exclude_self=True).collect()
    small = nn.knn(df, "k", df, "k", space, k=3, exclude_self=True, block_bytes=64 * 70).collect()
    assert len(big) == 1200 and sorted(big, key=str) == sorted(small, key=str)


def test_pruning_visits_few_blocks(spark):
    rng = np.random.default_rng(2)
    base, query = _points(spark, rng.uniform(size=(3000, 2))), _points(spark, rng.uniform(size=(300, 2)))
    visits, possible = nn.visit_counts(query, "k", base, "k", nn.Space(num=["c0", "c1"]), k=2, block_bytes=32 * 100)
    assert visits < possible / 10


def test_in_task_search_prunes(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(5000, 2))
    cells, looked = nn._Cells(x, [], "euclidean"), []
    plain = nn._Cells.distances
    monkeypatch.setattr(nn._Cells, "distances", lambda self, n, c, r: looked.append(len(n) * len(r)) or plain(self, n, c, r))
    dist, _ = nn._top(cells, np.arange(5000), np.arange(5000, 5300), rng.uniform(size=(300, 2)), [], 1, False)
    assert sum(looked) < 300 * 5000 / 5 and (dist < 0.1).all()


@pytest.mark.parametrize("metric", ["euclidean", "l1"])
def test_approximate_join_finds_most_neighbours(spark, metric):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8)) * 5
    b, q = (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 8)) for n in (1500, 150))
    b[:500] = b[0]  # a hot bucket in every table
    q[0] = 1e6  # shares no bucket: answered by the exact join
    base, query = _points(spark, b), _points(spark, q, 10_000)
    space = nn.Space(num=[f"c{i}" for i in range(8)], metric=metric)
    exact = {(r["q_key"], r["b_key"]) for r in nn.knn(query, "k", base, "k", space, k=3).collect()}
    got = nn.knn_approximate(query, "k", base, "k", space, k=3).collect()
    assert len(got) == 450 and len({(r["q_key"], r["rank"]) for r in got}) == 450
    assert len(exact & {(r["q_key"], r["b_key"]) for r in got}) >= 0.9 * len(exact)
    if metric == "l1":  # the hot bucket in several blocks
        split = nn.knn_approximate(query, "k", base, "k", space, k=3, block_bytes=80 * 200).collect()
        assert sorted(split) == sorted(got)


def test_large_low_dimensional_bases_are_cut_and_pruned(spark):
    """Blocks of BLOCK_ROWS rows at most: a query row looks into few of them, not into the whole base."""
    rng = np.random.default_rng(6)
    base, query = _points(spark, rng.uniform(size=(150_000, 2))), _points(spark, rng.uniform(size=(400, 2)))
    visits, possible = nn.visit_counts(query, "k", base, "k", nn.Space(num=["c0", "c1"]))
    assert possible >= 400 * 3 and visits < possible / 3


@pytest.mark.parametrize("k", [1, 5, 70])
def test_matrix_products_find_the_same_rows(k, monkeypatch):
    """Many numbers: rough distances only choose candidates; distances, keys and ball counts equal those of the plain search."""
    rng = np.random.default_rng(7)
    b = rng.normal(size=(900, 64))
    b[100:160] = b[5]  # ties
    q, bk = np.concatenate([b[:60], rng.normal(size=(40, 64))]), np.arange(900)
    qk, cells, dense = np.concatenate([bk[:60], np.arange(40) + 9000]), nn._Cells(b, [], "euclidean"), nn._Dense(b)
    for exclude in (False, True):
        for x, y in zip(nn._top(cells, bk, qk, q, [], k, exclude), dense.top(bk, qk, q, k, exclude)):
            assert np.array_equal(x, y)
    radius = nn._top(cells, bk, bk, b, [], 5, True)[0][:, -1]
    radius[3] = np.nan
    assert np.array_equal(nn._inside(cells, radius, q, []), dense.inside(radius, q))
    monkeypatch.setattr(nn, "_Cells", None)  # the kernel takes matrix products
    cols = [f"c{i}" for i in range(64)]
    q_rows, b_rows = (pd.DataFrame(x, columns=[f"_n_{c}" for c in cols]).assign(_key=i) for x, i in ((q, qk), (b, bk)))
    assert len(nn._block_kernel(nn.Space(num=cols), k, True, "knn")(q_rows, b_rows)) == 100 * k


def test_large_groups_are_pruned(spark, monkeypatch):
    """Neighbours within groups equal those of the plain join; the rows of a group larger than a block visit few blocks."""
    rng = np.random.default_rng(9)
    rows = [(i, "x" if i % 5 else "y" if i % 10 else None, float(rng.integers(0, 60)) if i % 19 else None, float(rng.normal()), "ab"[i % 2]) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, g string, a double, b double, c string")
    space = nn.Space(num=["a", "b"], cat=["c"])
    whole = nn.knn_within(df, "k", "g", space, k=3).collect()
    pairs, plain = [], nn._Pivots.further
    monkeypatch.setattr(nn._Pivots, "further", lambda self, q: pairs.append((self.parts.sum(), out := plain(self, q))) or out)
    cut = nn.knn_within(df, "k", "g", space, k=3, block_bytes=64 * 100).collect()
    assert len(whole) == 2700 and sorted(cut, key=str) == sorted(whole, key=str)
    (blocks, further), = pairs
    assert blocks > 8 and further.count() < 900 * blocks / 3


def test_further_visits_look_no_farther_than_the_kth_distance(monkeypatch):
    rng = np.random.default_rng(10)
    x, q = rng.uniform(size=(5000, 2)), rng.uniform(size=(300, 2))
    cells, looked = nn._Cells(x, [], "euclidean"), []
    whole = nn._top(cells, np.arange(5000), np.arange(5000, 5300), q, [], 3, False)
    plain = nn._Cells.distances
    monkeypatch.setattr(nn._Cells, "distances", lambda self, n, c, r: looked.append(len(n) * len(r)) or plain(self, n, c, r))
    same = nn._top(cells, np.arange(5000), np.arange(5000, 5300), q, [], 3, False, whole[0][:, -1])
    assert np.array_equal(same[0], whole[0]) and np.array_equal(same[1], whole[1])
    looked.clear()
    nn._top(cells, np.arange(5000), np.arange(5000, 5300), q + 50, [], 3, False, np.full(300, 0.1))
    assert sum(looked) == 300 * len(cells.pivots)  # the bounds alone
