"""The contextual detector against plain numpy on whole scenes, and the scenes that it must tell apart."""

import numpy as np
import pytest

from skygrid.operators import raster

SCHEMA = "granule string, row int, col int, mir double, tir1 double"


def rows_of(mir, tir1, granule="g"):
    return [(granule, r, c, None if np.isnan(mir[r, c]) else float(mir[r, c]), float(tir1[r, c])) for r in range(len(mir)) for c in range(mir.shape[1])]


def plain(mir, tir1, radius=5, floor=300.0):
    """Each pixel's surroundings cut out of the padded scene."""
    out = set()
    around = lambda f, r, c: np.pad(f, radius, mode="edge")[r : r + 2 * radius + 1, c : c + 2 * radius + 1].ravel()
    for r, c in zip(*np.nonzero(mir > floor)):
        m, d, t = (around(f, r, c) for f in (mir, mir - tir1, tir1))
        over = lambda x, near: x > np.nanmedian(near) + max(4.0, 3 * np.nanmedian(np.abs(near - np.nanmedian(near))))
        if over(mir[r, c], m) and over(mir[r, c] - tir1[r, c], d) and tir1[r, c] - np.nanmedian(t) >= -1.0:
            out.add((int(r), int(c)))
    return out


def found(spark, scenes, **kw):
    rows = [x for name, (m, t) in scenes.items() for x in rows_of(m, t, name)]
    return {(r.granule, r.row, r.col) for r in raster.detect(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()}


def test_random_scenes_over_blocks(spark):
    rng = np.random.default_rng(3)
    scenes = {}
    for name, shape in (("a", (40, 37)), ("b", (9, 50))):
        mir = 300 + rng.normal(0, 3, shape)
        mir[rng.random(shape) < 0.06] += 25
        mir[rng.random(shape) < 0.05] = np.nan
        scenes[name] = mir, 295 + rng.normal(0, 0.6, shape)
    wanted = {(n, *p) for n, s in scenes.items() for p in plain(*s)}
    assert len(wanted) > 20
    for side in (8, 16, 256):
        assert found(spark, scenes, side=side) == wanted


def scene():
    return np.full((40, 40), 300.5), np.full((40, 40), 295.0)


def test_scenes(spark):
    hot = scene()
    hot[0][20, 20] = 330
    corner = scene()
    corner[0][0, 0] = corner[0][39, 39] = 330
    deck = scene()  # cold cloud, with a pixel that is warm only against it
    deck[0][:, :], deck[1][:, :] = 250, 240
    deck[0][20, 20], deck[1][20, 20] = 290, 241
    plain_warm = scene()  # warm in both channels: no signature in the difference
    plain_warm[0][20, 20], plain_warm[1][20, 20] = 330, 324.5
    glint = scene()  # colder in the thermal channel than around
    glint[0][20, 20], glint[1][20, 20] = 330, 290
    gap = scene()
    gap[0][18:23, 18:23] = np.nan
    gap[0][20, 20] = 330
    scenes = {"uniform": scene(), "hot": hot, "corner": corner, "deck": deck, "warm": plain_warm, "glint": glint, "gap": gap}
    assert found(spark, scenes) == {("hot", 20, 20), ("corner", 0, 0), ("corner", 39, 39), ("gap", 20, 20)}


def test_edges_of_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert raster.detect(none).count() == 0
    hot = scene()
    hot[0][20, 20] = 330
    again = [*rows_of(*hot), ("g", 20, 20, 310.0, 295.0), ("g", 3, 3, float("nan"), 295.0), ("lone", 0, 0, 400.0, 200.0)]
    got = raster.detect(spark.createDataFrame(again, SCHEMA)).collect()
    assert [(r.granule, r.row, r.col, r.mir) for r in got] == [("g", 20, 20, 330.0)]
    assert got[0].bg_mir == pytest.approx(300.5) and got[0].bg_diff == pytest.approx(5.5)
