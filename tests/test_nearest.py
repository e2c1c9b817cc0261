"""Nearest references against all pairs: crowded and empty places, the pole, ties, kinds; and no join that sends a side to all tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skygrid.operators import spatial

E2, A = 0.0066943799901413165, 6378137.0


def metres(a, b, c, d):
    mid = math.radians((b + d) / 2)
    s = 1 - E2 * math.sin(mid) ** 2
    return math.hypot(A * (1 - E2) / (s * math.sqrt(s)) * math.radians(d - b), A / math.sqrt(s) * math.cos(mid) * math.radians(c - a))


def scene(spark):
    rng = random.Random(5)
    spots = [(70.0, 10.0, 0.001), (70.3, 10.2, 0.05), (71.0, 85.0, 0.3), (-0.01, -0.01, 0.2)]
    place = lambda: (lambda x, y, w: (rng.gauss(x, w), rng.gauss(y, w)))(*rng.choice(spots))
    refs = [(i, *place(), i % 4) for i in range(600)]
    refs += [(1000 + i, *refs[i][1:3], 2) for i in range(40)]  # equal places
    pts = [(i, *place(), i % 3) for i in range(300)] + [(900, 100.0, 0.0, 1), (901, None, 1.0, 1)]
    points = spark.createDataFrame(pts, "id long, lon double, lat double, y int")
    return pts, refs, points, spark.createDataFrame(refs, "ref_id long, rlon double, rlat double, k int")


def boxed(pts, refs, half, ok=lambda p, r: True):
    return {p[0]: sorted((metres(p[1], p[2], r[1], r[2]), r[0]) for r in refs if abs(p[1] - r[1]) <= half and abs(p[2] - r[2]) <= half and ok(p, r)) for p in pts if p[1] is not None}


def test_nearest_against_all_pairs(spark):
    pts, refs, points, table = scene(spark)
    near, valid = boxed(pts, refs, 0.25), boxed(pts, refs, 0.25, lambda p, r: r[3] <= p[3] - 1)
    first = lambda found, i: (found.get(i) or [(None, None)])[0]
    got = {r.id: r for r in spatial.nearest_in_box(points, table, 0.25, F.col("k") <= F.col("y") - 1).collect()}
    assert len(got) == len(pts)
    for i, r in got.items():
        assert (r.ref_id, r.valid_ref_id) == (first(near, i)[1], first(valid, i)[1])
        assert r.metres == (first(near, i)[0] if first(near, i)[0] is None else pytest.approx(first(near, i)[0], abs=1e-6))
    kinds = {(r.id, r.k): r.metres for r in spatial.nearest_of_kinds(points, table, 0.25, "k").collect()}
    wanted = {(i, k): first(boxed([p for p in pts if p[0] == i], [r for r in refs if r[3] == k], 0.25), i)[0] for i in near for k in range(4)}
    wanted = {key: m for key, m in wanted.items() if m is not None}
    assert kinds.keys() == wanted.keys() and all(m == pytest.approx(wanted[key], abs=1e-6) for key, m in kinds.items())
    ties = sorted((r.id, r.ref_id) for r in spatial.nearest_ties(points, table, 0.25, 30.0).collect())
    assert ties == sorted((i, r) for i, ms in near.items() for m, r in ms if m - ms[0][0] < 30.0) and len(ties) > len(near)


def test_boxes_are_joined_by_merge(spark):
    rows = spark.range(100).withColumns({"lon": F.rand(1), "lat": F.rand(2)})
    plan = spatial.in_box(rows, rows.withColumnsRenamed({"id": "ref_id", "lon": "rlon", "lat": "rlat"}), 0.25)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["label_lift", "nearest_ref_in_box", "nearest_valid_ref", "radius_count_sweep", "rejoin_matched", "survival_filter", "weak_label_case", "weak_label_evidence"])
def test_found_refs_are_never_broadcast(spark, name):
    import __spark_entry__ as e

    plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_applicability_takes_all_fit_rows(spark):
    import numpy as np

    from skygrid.operators import vectors

    n = 41_000
    x = np.random.default_rng(3).permutation(n) * 1.0 + (np.arange(n) % 7) / 10
    far = np.arange(200) * 201.3 + 0.37
    rows = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([*x, *far])] + [(n + 200, None)], "id long, v array<double>")
    got = {r.id: r for r in vectors.applicability(rows, "id", "v", F.col("id") < n, chunk=9_000).collect()}
    s = np.sort(x)
    gap = np.diff(s)
    own = np.minimum(np.r_[np.inf, gap], np.r_[gap, np.inf]) / x.std()
    assert len(got) == 201 and got[n + 200].distance is None and got[n + 200].outside is None
    for i, v in enumerate(far):
        assert got[n + i].distance == pytest.approx(np.abs(x - v).min() / x.std(), abs=1e-9)
        assert got[n + i].threshold == pytest.approx(np.quantile(own, 0.95), abs=1e-9)
