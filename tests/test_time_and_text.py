"""Nearest in time against brute force, and numbers of awkward JSON."""

import random

from skygrid.operators import temporal
from skygrid.sources import tables


def test_asof_equals_brute_force_with_ties_repeats_and_hot_bins(spark):
    rng = random.Random(12)
    second = lambda: rng.choice([rng.randint(0, 9000), rng.randint(100, 130), 600, 1200])
    left = [(i, second()) for i in range(400)] + [(900, None), (901, 50_000), (0, 600)]
    right = [(i, second()) for i in range(150)] + [(700, None), (3, 600), (4, 600)]
    frame = lambda rows, i, t: spark.createDataFrame(rows, f"{i} long, s long").selectExpr(i, f"timestamp_seconds(s) AS {t}")
    for tolerance in (60, 600):
        got = sorted(((r.id, r.ref_id, r.gap_s) for r in temporal.asof_nearest(frame(left, "id", "at"), frame(right, "ref_id", "rat"), tolerance).collect()), key=str)
        want = []
        for i, s in left:
            near = [(abs(s - t), t, k) for k, t in right if t is not None and s is not None and abs(s - t) <= tolerance]
            want.append((i, min(near)[2], float(min(near)[0])) if near else (i, None, None))
        assert got == sorted(want, key=str)
    none = frame([], "ref_id", "rat")
    assert {r.ref_id for r in temporal.asof_nearest(frame(left, "id", "at"), none, 60).collect()} == {None}


def test_numbers_of_awkward_json(spark):
    texts = {1: '{"a": 1, "b": [2.5, {"c": -3}], "t": true, "n": null, "s": "4"}', 2: "7", 3: "[]", 4: "{", 5: None, 6: "", 7: '{"a": NaN}', 8: "[" * 5000 + "1" + "]" * 5000, 9: '{"a": 1e400, "b": 1' + "0" * 400 + "}", 10: '{"x.y": {"": 5}}', 11: "[1] [2]"}
    got = {}
    for r in tables.json_numbers(spark.createDataFrame(list(texts.items()), "id long, j string"), "id", "j").collect():
        got.setdefault(r.id, set()).add((r.path, r.value))
    assert got.pop(1) == {("a", 1.0), ("b.0", 2.5), ("b.1.c", -3.0)}
    assert got.pop(2) == {("", 7.0)} and got.pop(10) == {("x.y.", 5.0)}
    deep = got.pop(8, {(".".join(["0"] * 5000), 1.0)})  # or refused by the parser as too deep
    assert deep == {(".".join(["0"] * 5000), 1.0)}
    assert got.pop(9) == {("a", float("inf"))}
    assert not got
