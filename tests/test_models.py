"""Boosted trees against a plain numpy fit, blocked evaluation against separate fits, the probe against numpy."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skygrid.operators import boosting, probe

CLASSES = ["a", "b", "c"]
SCHEMA = "id long, block string, near_g1 boolean, near_g2 boolean, x double, y double, z int, label string"


def rows_of(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, z = rng.random(), rng.gauss(0, 1), rng.randint(0, 4)
        label = "a" if x > 0.6 else "b" if y > 0.2 else "c"
        x = None if rng.random() < (0.5 if label == "a" else 0.1) else x  # missing more often where the label is a
        y = float("nan") if rng.random() < 0.1 else y
        out.append((i, rng.choice(["g1", "g2", "g3", "out", None]), rng.random() < 0.2, rng.random() < 0.2, x, y, z, label if rng.random() < 0.9 else rng.choice([*CLASSES, "other", None])))
    return out


def plain_fit(bins, y, classes, width, rounds, depth, rate, least, reg, allowed):
    """The same trees row by row and cut by cut: a list of (feature, cut, missing left) by (round, class, node)."""
    raw = np.tile(np.log([np.sum(y == k) / len(y) for k in range(classes)]), (len(y), 1))
    splits = {}
    for r in range(rounds):
        g, h = boosting.gradients(y, raw[:, None, :])
        g, h = g[:, 0], h[:, 0]
        for k in range(classes):
            queue = [(0, np.arange(len(y)), 0)]
            while queue:
                node, own, level = queue.pop(0)
                score = lambda rows: float(g[rows, k].sum()) ** 2 / (h[rows, k].sum() + reg * boosting.UNIT)  # noqa: B023, E731
                best = None
                for lost in (True, False) if level < depth else ():
                    for f in allowed:
                        for cut in range(1, width - 1):
                            left = np.array([i for i in own if (bins[i][f] == 0 and lost) or 0 < bins[i][f] <= cut], int)
                            right = np.setdiff1d(own, left)
                            if min(len(left), len(right)) < least:
                                continue
                            gain = (score(left) + score(right) - score(own)) / boosting.UNIT
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = gain, f, cut, lost, left, right
                if best:
                    splits[r, k, node] = best[1:4]
                    queue += [(2 * node + 1, best[4], level + 1), (2 * node + 2, best[5], level + 1)]
                else:
                    raw[own, k] += -rate * g[own, k].sum() / (h[own, k].sum() + reg * boosting.UNIT)
    return splits, raw


def splits_of(ensemble, m):
    return {(r, k, n): (t.feature[n], t.cut[n], t.lost[n]) for r, trees in enumerate(ensemble.rounds) for (mm, k), t in trees.items() if mm == m for n in t.feature}


PARAMS = {"rounds": 3, "depth": 2, "rate": 0.3, "bins": 5, "least": 8, "store_every": 2}


def test_splits_and_scores_equal_numpy(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    models = [boosting.Model("all", F.lit(True)), boosting.Model("part", F.col("block") == "g1", ("y", "z"))]
    ensemble, data = boosting.fit(df, ["x", "y", "z"], "label", CLASSES, models, keep=("id", "block"), **PARAMS)
    held = [r for r in data.collect() if r.y >= 0]
    bins = np.array([[r.b0, r.b1, r.b2] for r in held])
    assert (bins[:, 0] == 0).any() and (bins[:, 1] == 0).any()
    width = max(map(len, ensemble.edges)) + 2
    for m, own, allowed in ((0, range(len(held)), (0, 1, 2)), (1, [i for i, r in enumerate(held) if r.block == "g1"], (1, 2))):
        y = np.array([held[i].y for i in own])
        splits, raw = plain_fit(bins[list(own)], y, 3, width, 3, 2, 0.3, 8, 1.0, allowed)
        assert splits == splits_of(ensemble, m) and splits
        assert np.allclose(raw, ensemble.raw(bins[list(own)])[:, m], atol=1e-9)
    assert {lost for _, _, lost in splits_of(ensemble, 0).values()} == {True, False}  # the default branch is learned


def test_bins_keep_order_and_null(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)] + [(99, None)], "id long, v double")
    edges = boosting.edges_of(df, ["v"], 4)
    data = boosting.binned(df.withColumn("label", F.lit("a")), ["v"], "label", ["a"], [boosting.Model("m", F.lit(True))], edges, ["id"])
    got = {r.id: r.b0 for r in data.collect()}
    assert got.pop(99) == 0
    assert [got[i] for i in range(20)] == [1 + sum(i > e for e in edges[0]) for i in range(20)]
    with pytest.raises(ValueError, match="at most"):
        boosting.binned(df, ["v"], "id", ["a"], [boosting.Model(str(i), F.lit(True)) for i in range(63)], edges, [])


def test_deeper_trees_beat_one_level_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame(rows_of(900, 5), SCHEMA)
    train, score = [boosting.Model("m", F.col("id") % 3 > 0)], {}
    for depth, parts in ((1, 2), (3, 2), (3, 7)):
        ensemble, data = boosting.fit(df.repartition(parts), ["x", "y", "z"], "label", CLASSES, train, keep=("id",), rounds=4, depth=depth, rate=0.3, bins=8)
        report = boosting.class_report(boosting.predicted(data.where("id % 3 = 0"), ensemble, []), CLASSES)
        score[depth, parts] = next(r.f1 for r in report.collect() if r["class"] == "macro"), splits_of(ensemble, 0)
    assert score[3, 2][0] > score[1, 2][0] + 0.02
    assert score[3, 2] == score[3, 7]


def test_blocked_evaluation_equals_separate_fits(spark):
    df = spark.createDataFrame(rows_of(700, 7), SCHEMA).withColumn("d", F.when(F.col("label") == "a", 0.0).when(F.col("label") == "b", 1.0).otherwise(2.0))
    near = {"g1": "near_g1", "g2": "near_g2"}
    args = ("id", "block", near, "out", ["x", "y", "z"], ["d"], "label", CLASSES)
    report = {(r.model, r["class"]): tuple(r)[2:] for r in boosting.blocked_evaluation(df, *args, cap=0.4, **PARAMS).collect()}
    assert {m for m, _ in report} == {"g1", "g2", "external", "leak:g1", "capped:g1", "capped:g2"}
    alone = {"g1": (F.col("block").isNotNull() & ~F.col("block").isin("g1", "out") & ~F.col("near_g1"), "g1"), "external": (F.col("block").isNotNull() & (F.col("block") != "out"), "out")}
    for name, (train, test) in alone.items():
        ensemble, data = boosting.fit(df, ["x", "y", "z"], "label", CLASSES, [boosting.Model("m", train)], keep=("block",), **PARAMS)
        for r in boosting.class_report(boosting.predicted(data.where(F.col("block") == test), ensemble, []), CLASSES).collect():
            assert np.allclose(tuple(r)[2:], report[name, r["class"]])
    assert report["leak:g1", "macro"][2] > report["g1", "macro"][2]


def test_ablation_counts_and_weighs_by_rows(spark):
    df = spark.createDataFrame(rows_of(500, 3), SCHEMA)
    got = {r.block: r for r in boosting.block_ablation(df, "id", "block", {"g1": "near_g1", "g2": "near_g2", "none": "near_g1"}, ["x", "y", "z"], ["x"], "label", CLASSES, "b", "a", **PARAMS).collect()}
    assert got["g1"].n == df.where("block = 'g1' and label = 'b'").count()
    assert got["none"].n == 0 and got["none"].share_with is None
    both = [got["g1"], got["g2"]]
    assert math.isclose(got["all"].share_without, sum(r.n * r.share_without for r in both) / sum(r.n for r in both))
    assert got["all"].share_without > got["all"].share_with  # x is what tells b from a


def test_report_of_absent_classes(spark):
    rows = spark.createDataFrame([("m", 0, 0), ("m", 0, 1), ("m", 1, 1), ("m", -1, 2)], "model string, y int, guess int")
    got = {r["class"]: tuple(r)[2:] for r in boosting.class_report(rows, CLASSES).collect()}
    assert got["a"] == (1.0, 0.5, 2 / 3, 2) and got["b"] == (0.5, 1.0, 2 / 3, 1) and got["c"] == (0.0, 0.0, 0.0, 0)
    assert np.allclose(got["macro"][:3], (0.5, 0.5, 4 / 9)) and got["macro"][3] == 3


def test_probe_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    y = (x @ np.array([[1, -1, 0.5], [0.2, 1, -1], [0, 0, 0]]).T + rng.normal(size=(120, 3))).argmax(axis=1)
    rows = [(i, v.tolist(), CLASSES[k]) for i, (v, k) in enumerate(zip(x, y))] + [(500, None, "a"), (501, [9.0, 9.0, 9.0], "unknown")]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string").repartition(3)
    fitted = probe.fit(df, "v", "label", CLASSES, strength=2.0)
    xs, w = np.concatenate([x, np.ones((120, 1))], axis=1), np.zeros((3, 4))
    for _ in range(20000):  # plain gradient steps on the whole
        p = boosting.softmax(xs @ w.T)
        w -= 0.02 * ((p - np.eye(3)[y]).T @ xs + np.concatenate([w[:, :3] / 2.0, np.zeros((3, 1))], axis=1))
    centred = lambda w: np.concatenate([w[:, :3], w[:, 3:] - w[:, 3:].mean()], axis=1)  # noqa: E731  all intercepts may move together
    assert np.abs(centred(fitted.weights) - centred(w)).max() < 1e-6
    got = {r.id: r.guess for r in probe.guesses(df, "v", fitted).collect()}
    assert [got[i] for i in range(120)] == [CLASSES[k] for k in boosting.softmax(xs @ w.T).argmax(axis=1)] and got[500] is None
    with pytest.raises(ValueError, match="no rows"):
        probe.fit(df.limit(0), "v", "label", CLASSES)


def test_floors_hold_for_rows_and_sites(spark):
    rows = [("g", "a", "a", i) for i in range(30)] + [("g", "b", "a", i % 2) for i in range(114)] + [("g", "c", None, i) for i in range(5)] + [("h", "a", "b", i) for i in range(31)]
    df = spark.createDataFrame(rows, "block string, label string, guess string, site int")
    got = {(r.block, r["class"]): r for r in probe.with_floors(df, "block", "label", "guess", "site", CLASSES).collect()}
    assert (got["g", "a"].support, got["g", "a"].recall, got["g", "a"].precision) == (30, 1.0, 30 / 144) and got["g", "a"].note is None
    assert got["g", "b"].f1 is None and got["g", "b"].note == "insufficient support, n=114 from 2 sites"
    assert got["g", "c"].note == "insufficient support, n=5 from 5 sites"
    assert got["h", "a"].recall == 0.0 and got["h", "b"].note == "insufficient support, n=0 from 0 sites"


def test_sums_of_a_batch_longer_than_a_packed_part(spark):
    import pyarrow as pa

    n, most = 3 * boosting.PACKED + 5, boosting.UNIT // 4
    bins = np.arange(n, dtype=np.int16) % 3
    batch = pa.RecordBatch.from_arrays([pa.array(bins), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int64))], ["b0", "y", "mask"])
    ensemble = boosting.Ensemble(("x",), ((0.0,),), ("a", "b"), ("m",), np.zeros((1, 2)), [])
    trees = {(0, k): boosting.Tree(value={0: 0.0}) for k in range(2)}
    (sums,) = boosting.histograms([batch], ensemble, 0, trees, {key: [0] for key in trees}, 3)
    counts = np.bincount(bins)
    assert sums["n"].to_pylist() == [*counts, *counts] and sums["h"].to_pylist() == [c * most for c in (*counts, *counts)]
    assert sums["g"].to_pylist() == [-c * boosting.UNIT // 2 for c in counts] + [c * boosting.UNIT // 2 for c in counts]


def test_sums_by_products_equal_sums_by_counts(monkeypatch):
    """Whatever the chunks, with closed nodes, missing values and rows that a model does not learn from."""
    rng, n, width = np.random.default_rng(6), 2 * boosting.CHUNK + 77, 9
    bins, y, mask = rng.integers(0, width, (n, 3)).astype(np.int16), rng.integers(0, 3, n), rng.integers(1, 4, n)
    batch = pa.RecordBatch.from_pydict({"y": pa.array(y.astype(np.int32)), "mask": pa.array(mask), **{f"b{i}": pa.array(bins[:, i].copy()) for i in range(3)}})
    ensemble = boosting.Ensemble(("a", "b", "c"), ((0.0,) * (width - 2),) * 3, tuple(CLASSES), ("m", "o"), np.log(np.array([[0.2, 0.3, 0.5], [0.4, 0.4, 0.2]])), [])
    trees = {(m, k): boosting.Tree(feature={0: (m + k) % 3}, cut={0: 3 + k}, lost={0: bool(k % 2)}, value={1: 0.0, 2: 0.0}) for m in range(2) for k in range(3)}
    nodes = {key: [1, 2] if key != (1, 2) else [2] for key in trees}
    got = []
    for dense in (64, 0):
        monkeypatch.setattr(boosting, "DENSE", dense)
        (sums,) = boosting.histograms([batch], ensemble, 0, trees, nodes, width)
        got.append(sorted(map(tuple, zip(*(sums[c].to_pylist() for c in ("cell", "g", "h", "n")), strict=True))))
    assert got[0] == got[1]
    g, h = boosting.gradients(y, np.repeat(ensemble.start[None], n, axis=0))
    for cell, *sums in got[0]:
        rest, b = divmod(cell, width)
        rest, f = divmod(rest, 3)
        t, slot = divmod(rest, 2)
        m, k = sorted(trees)[t]
        x = bins[:, (m + k) % 3]
        left = (x <= 3 + k) & ((x > 0) | bool(k % 2))
        own = ((mask >> m) & 1 == 1) & (left == (nodes[m, k][slot] == 1)) & (bins[:, f] == b)
        assert sums == [int(g[own, m, k].sum()), int(h[own, m, k].sum()), int(own.sum())]


def test_open_leaves_equal_walked_trees():
    """Trees of one leaf, of few and of more than eight, lopsided ones too."""
    rng = np.random.default_rng(8)
    columns = list(rng.integers(0, 6, (4, 500)).astype(np.int16))
    trees = [boosting.Tree(value={0: 0.5})]
    for nodes in ([0], [0, 2, 6], [0, 1, 2, 3, 4, 5, 6], [0, 1, 2, 3, 4, 5, 6, 7, 8]):
        leaves = {c for n in nodes for c in (2 * n + 1, 2 * n + 2)} - set(nodes)
        trees.append(boosting.Tree({n: int(rng.integers(4)) for n in nodes}, {n: int(rng.integers(1, 5)) for n in nodes}, {n: bool(rng.integers(2)) for n in nodes}, {n: float(rng.normal()) for n in leaves}))

    def walk(tree, row):
        node = 0
        while node in tree.feature:
            b = columns[tree.feature[node]][row]
            node = 2 * node + 2 - bool(tree.lost[node] if b == 0 else b <= tree.cut[node])
        return tree.value[node]

    rounds = [{(0, 0): trees[i], (0, 1): trees[(i + 1) % 5]} for i in range(5)]
    got = boosting.added(np.zeros((1, 2, 500)), columns, rounds)
    assert np.allclose(got[0], [[sum(walk(r[0, k], row) for r in rounds) for row in range(500)] for k in (0, 1)], atol=1e-12)


def test_rows_that_share_an_ident_count_once_each(spark):
    """Ident and label do not multiply rows, and the cap is not passed."""
    rows = rows_of(700, 7)
    df = spark.createDataFrame(rows + [(i, *r) for i, *r in rows[:300]], SCHEMA)
    report = {(r.model, r["class"]): r.support for r in boosting.blocked_evaluation(df, "id", "block", {"g1": "near_g1"}, "out", ["x", "z"], ["x"], "label", CLASSES, cap=0.4, rounds=1, depth=1, bins=4).collect()}
    held = [r for r in rows + rows[:300] if r[-1] in CLASSES]
    assert {m: report[m, "macro"] for m in ("g1", "leak:g1", "capped:g1", "external")} == {m: sum(r[1] == ("out" if m == "external" else "g1") for r in held) for m in ("g1", "leak:g1", "capped:g1", "external")}


@pytest.mark.parametrize("share", [0.001, 0.2, 0.4, 0.99])
def test_kept_rows_of_the_majority_are_those_of_the_cap(spark, share):
    from skygrid.operators import sampling

    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 5 < 3, "m").when(F.col("id") % 5 == 3, "n").alias("l"))
    wanted = {r.id for r in sampling.majority_cap(df, "id", "l", share).collect()}
    assert {r.id for r in df.where(sampling.majority_kept(df, "id", "l", share)).collect()} == wanted
    twice = df.unionAll(df)
    kept = twice.where(sampling.majority_kept(twice, "id", "l", share)).where("l = 'm'").count()
    limit = int(share / (1 - share) * 16_000 + 1e-9)
    assert min(limit, 24_000) - 1 <= kept <= limit
