"""Clusters by cells against all pairs in numpy, on heaps, near misses, repeats and missing coordinates; running sums by ranges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrid.operators import cluster, stats


def brute(x, eps, least):
    """Cluster of each row (None: noise) from all pairs."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min([label[i], *label[near[i] & core]]) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    out = []
    for i in range(len(x)):
        reach = label[near[i] & core]
        out.append(int(label[i]) if core[i] else int(reach.min()) if len(reach) else None)
    return out


def found(df):
    return [r.cluster for r in df.orderBy("id").collect()]


def scene(seed):
    """Sparse rows, heaps just in and just out of reach of each other, equal rows."""
    rng = np.random.default_rng(seed)
    heap = rng.random((60, 2)) * 0.3
    return np.concatenate([rng.random((120, 2)) * 12, heap + [20, 0], heap * [-1, 1] + [21.25, 0], heap + [20, 5], heap * [-1, 1] + [21.65, 5], np.repeat([[30.0, 30.0]], 40, 0), [[31.0, 30.0], [32.0, 30.0]]])


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double")


@pytest.mark.parametrize("pairs", [4, 256])
def test_cells_equal_all_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(cluster, "PAIRS", pairs)  # 4: crowded cells are split many times
    x = scene(pairs)
    space = cluster.euclidean(["x", "y"], 1.0)
    assert found(cluster.single_link(frame(spark, x), space)) == brute(x, 1.0, 1)
    assert found(cluster.dbscan(frame(spark, x), space, 5)) == brute(x, 1.0, 5)


@pytest.mark.parametrize("most", [0, 5, 100_000])
def test_components_by_contraction(spark, monkeypatch, most):
    monkeypatch.setattr(cluster, "TASK_EDGES", most)
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (70, 60)] + [(int(a) + 200, int(b) + 200) for a, b in rng.integers(0, 60, (40, 2))]
    root = {v: v for e in edges for v in e if e[0] != e[1]}
    while any(root[a] != root[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = cluster.components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, got.collect())) == root and got.count() == len(root)


def test_heaps_cost_their_size(spark):
    """Two heaps of 30,000 rows out of reach, one of 30,000 equal rows: no pairs of a heap are made."""
    rng = np.random.default_rng(1)
    heap = rng.random((30_000, 2)) * 0.3
    x = np.concatenate([heap, heap * [-1, 1] + [1.605, 0], np.repeat([[9.0, 9.0]], 30_000, 0)])
    got = cluster.dbscan(frame(spark, x), cluster.euclidean(["x", "y"], 1.0), 10).groupBy("cluster").count().orderBy("cluster").collect()
    assert [tuple(r) for r in got] == [(0, 30_000), (30_000, 30_000), (60_000, 30_000)]


def test_a_crowded_field_is_not_split(spark, monkeypatch):
    """Cells that are in one component after the first representatives are not compared again, crowded as they are."""
    seen, written = [], cluster.written
    monkeypatch.setattr(cluster, "PAIRS", 4)
    monkeypatch.setattr(cluster, "written", lambda df: seen.append(df) or written(df))
    x = np.concatenate([np.random.default_rng(4).random((6_000, 2)) * 10, [[30.0, 30.0], [30.5, 30.0]]])
    got = found(cluster.single_link(frame(spark, x), cluster.euclidean(["x", "y"], 1.0)))
    assert got == [0] * 6_000 + [6_000] * 2
    pairs = [df.count() for df in seen if "x_home" in df.columns and "y_home" in df.columns]
    assert pairs[0] > 1_000 and sum(pairs[1:]) < 10


def test_rows_without_coordinates(spark):
    rows = [(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, 0.5, 0.0), (5, float("inf"), 1.0)]
    df, space = spark.createDataFrame(rows, "id long, x double, y double"), cluster.euclidean(["x", "y"], 1.0)
    assert found(cluster.single_link(df, space)) == [1, 2, 3, 1, 5]
    assert found(cluster.dbscan(df, space, 2)) == [1, None, None, 1, None]
    assert cluster.dbscan(df.where("false"), space, 2).count() == 0


def test_metres_on_both_sides_of_zero(spark):
    x = [(i, 76.0 + i * 0.01 - 0.05, lat) for i, lat in enumerate([-0.01, 0.0, 0.01, 60.0, 60.0, 60.01, 0.5])]
    df = spark.createDataFrame(x, "id long, lon double, lat double")
    assert found(cluster.single_link(df, cluster.on_earth(1600, 0.03))) == [0, 0, 0, 3, 3, 3, 6]


def test_ranges_agree_with_one_range(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(None if k == 3 else f"k{k}", float(v)) for k, v in zip(rng.integers(0, 4, 4000), rng.integers(0, 700, 4000), strict=True)]
    df = spark.createDataFrame(rows, "k string, v double")
    picks = {"low": lambda n: 0.1 * (n - 1), "median": lambda n: (n - 1) / 2, "top": lambda n: F.ceil(0.95 * (n - 1))}
    one = {r.k: tuple(r)[1:] for r in stats.quantiles(df, "k", "v", picks).collect()}
    monkeypatch.setattr(stats, "RANGE", 100)
    many = {r.k: tuple(r)[1:] for r in stats.quantiles(df, "k", "v", picks).collect()}
    assert one == many and set(one) == {"k0", "k1", "k2", None}
    for k, (low, median, top) in one.items():
        v = [b for a, b in rows if a == k]
        assert (low, median) == (pytest.approx(np.quantile(v, 0.1)), pytest.approx(np.median(v))) and top == np.quantile(v, 0.95, method="higher")
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 900, 2000))], "key long, n long")
    need = {r.share: r["keys"] for r in stats.greedy_coverage(sizes, "key", "n", [0.5, 0.8]).collect()}
    each = np.sort([r.n for r in sizes.collect()])[::-1].cumsum()
    assert need == {s: int((each < s * each[-1] - 1e-9).sum()) + 1 for s in (0.5, 0.8)}
    assert math.isfinite(stats.average_precision(df, F.col("v") > 600, F.col("v")).first()[0])
