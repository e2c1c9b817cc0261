"""Contextual hot-spot detection on pixel rows (granule, row, col, mir, tir1).

Pixels are dealt into square blocks, each with a halo of ``radius`` pixels that its neighbours lend it, so one
shuffle brings every pixel's surroundings into its block's task: (1 + 2 radius / BLOCK) ** 2 rows a pixel, at any
radius. There a block is a dense array, missing pixels are NaN, and medians and median absolute deviations
are taken for candidates only (pixels above the floor), some thousands at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels a side of a block without its halo, and candidates whose surroundings are held at a time.
BLOCK, CANDIDATES = 256, 20_000


def _medians(values: np.ndarray) -> np.ndarray:
    """Median of each row without its NaNs; NaN if there are no others."""
    s, n = np.sort(values, axis=1), np.isfinite(values).sum(axis=1)[:, None]
    at = lambda i: np.take_along_axis(s, np.maximum(i, 0), axis=1)[:, 0]
    return (at((n - 1) // 2) + at(n // 2)) / 2.0


def _blocks_of(position: Column, radius: int, last: Column, side: int) -> Column:
    """Numbers of the blocks that hold a position or have it in their halo."""
    return F.sequence(F.floor(F.greatest(position - radius, F.lit(0)) / side), F.floor(F.least(position + radius, last) / side))


def stand_out(rows: np.ndarray, cols: np.ndarray, mir: np.ndarray, tir1: np.ndarray, first: tuple[int, int], last: tuple[int, int], floor: float, margin: float, spread: float, deficit: float, radius: int, block: int) -> tuple[np.ndarray, ...]:
    """(row, col, mir, bg_mir, bg_diff, bg_tir1) of a block's own pixels that stand out; ``first``: its corner, ``last``: the granule's."""
    side, corner = block + 2 * radius, (first[0] - radius, first[1] - radius)
    channel = np.full((2, side, side), np.nan)
    channel[:, rows - corner[0], cols - corner[1]] = mir, tir1
    own = (rows >= first[0]) & (rows < first[0] + block) & (cols >= first[1]) & (cols < first[1] + block) & (mir > floor)
    step, out = np.arange(-radius, radius + 1), []
    for i in range(0, int(own.sum()), CANDIDATES):
        r, c = rows[own][i : i + CANDIDATES], cols[own][i : i + CANDIDATES]
        near_r, near_c = (np.clip(x[:, None] + step, 0, end) - base for x, end, base in zip((r, c), last, corner, strict=True))
        m, t = (channel[k][near_r[:, :, None], near_c[:, None, :]].reshape(len(r), -1) for k in (0, 1))
        at_m, at_t = (channel[k][r - corner[0], c - corner[1]] for k in (0, 1))
        with np.errstate(invalid="ignore"):
            bg_m, bg_d, bg_t = _medians(m), _medians(m - t), _medians(t)
            over = lambda x, bg, near: x > bg + np.maximum(margin, spread * _medians(np.abs(near - bg[:, None])))
            kept = over(at_m, bg_m, m) & over(at_m - at_t, bg_d, m - t) & (at_t - bg_t >= deficit)
        out.append([x[kept] for x in (r, c, at_m, bg_m, bg_d, bg_t)])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0) for _ in range(6))


def detect(pixels: DataFrame, floor: float = 300.0, margin: float = 4.0, spread: float = 3.0, deficit: float = -1.0, radius: int = 5, side: int = BLOCK) -> DataFrame:
    """(granule, row, col, mir, bg_mir, bg_diff, bg_tir1) of pixels that stand out of their surroundings.

    mir and mir - tir1 must exceed their background by more than the margin and more than ``spread`` times
    the deviation; tir1 may be colder by -deficit at most. A background is the median over the (2 radius + 1) ** 2
    pixels around, those beyond the granule's end taken from its edge; null and NaN are missing. Values may be in
    any unit, so whole numbers (tenths, say) make comparisons exact. Of a pixel that is given twice
    the row with the largest mir counts. ``side``: pixels a side of a block.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    once = pixels.groupBy("granule", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(F.max(F.struct(number("mir").alias("mir"), number("tir1").alias("tir1"))).alias("p")).select("granule", "row", "col", "p.*")
    ends = pixels.groupBy("granule").agg(F.max("row").cast("long").alias("last_row"), F.max("col").cast("long").alias("last_col"))
    own = once.join(ends, "granule").withColumn("_r", F.explode(_blocks_of(F.col("row"), radius, F.col("last_row"), side))).withColumn("_c", F.explode(_blocks_of(F.col("col"), radius, F.col("last_col"), side)))
    kind = dict(pixels.dtypes)["granule"]

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        get = lambda c: rows.column(c).to_numpy()
        last = (rows.column("last_row")[0].as_py(), rows.column("last_col")[0].as_py())
        first = (key[1].as_py() * side, key[2].as_py() * side)
        found = stand_out(get("row"), get("col"), get("mir"), get("tir1"), first, last, floor, margin, spread, deficit, radius, side)
        same = pa.array([key[0].as_py()] * len(found[0]), key[0].type)
        return pa.table([same, *(pa.array(x.astype(np.int64)) for x in found[:2]), *(pa.array(x) for x in found[2:])], ["granule", "row", "col", "mir", "bg_mir", "bg_diff", "bg_tir1"])

    return own.groupBy("granule", "_r", "_c").applyInArrow(block, f"granule {kind}, row long, col long, mir double, bg_mir double, bg_diff double, bg_tir1 double")
