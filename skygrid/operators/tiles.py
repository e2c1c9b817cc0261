"""Sampling of rasters that are stored as pixel blocks, one row a (tile, block row, block column).

A point's tile, pixel and block follow from its coordinates, so sampling is an equi-join on the block in whose
sort order both sides are read; of a block's codes only the point's byte is taken, inside the join's own stage. A block
that very many points share is a skewed key of a sort-merge join, which Spark splits at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Square tiles of ``degrees`` and ``pixels`` a side, north up, cut into blocks of ``block`` pixels a side."""

    degrees: int = 3
    pixels: int = 36_000
    block: int = 1_024

    def tile(self, lon: Column, lat: Column) -> Column:
        """Name by the south-west corner, such as N30E072."""
        x, y = (F.floor(c / self.degrees) * self.degrees for c in (lon, lat))
        side = lambda v, plus, minus, width: F.concat(F.when(v >= 0, plus).otherwise(minus), F.lpad(F.abs(v).cast("string"), width, "0"))
        return F.concat(side(y, "N", "S", 2), side(x, "E", "W", 3))

    def pixel(self, west: Column, north: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(row, col) of a point in the tile with that corner; its far edges belong to it."""
        at = lambda d: F.least(F.floor(d * (self.pixels / self.degrees)), F.lit(self.pixels - 1)).cast("long")
        return at(north - lat), at(lon - west)

    def corner(self, tile: Column) -> tuple[Column, Column]:
        """(west, north) of a tile's name."""
        sign = lambda at, minus: F.when(F.substring(tile, at, 1) == minus, -1).otherwise(1)
        return sign(4, "W") * F.substring(tile, 5, 3).cast("int"), sign(1, "S") * F.substring(tile, 2, 2).cast("int") + self.degrees


def to_blocks(pixels: DataFrame, grid: Grid, nodata: int = 0) -> DataFrame:
    """Blocks (tile, block_row, block_col, codes) of pixels (tile, row, col, code from 0 to 255); unset ones are nodata.

    Of a pixel that is set twice the smallest code stays. A block's size is the grid's, whatever the input.
    """
    side = grid.block

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes = np.full(side * side, nodata, np.uint8)
        rows = rows.sort_values("code", ascending=False)
        codes[(rows["row"] % side * side + rows["col"] % side).to_numpy()] = rows["code"].to_numpy()
        return pd.DataFrame({"tile": [key[0]], "block_row": [key[1]], "block_col": [key[2]], "codes": [codes.tobytes()]})

    blocks = pixels.withColumn("block_row", F.floor(F.col("row") / side)).withColumn("block_col", F.floor(F.col("col") / side))
    once = blocks.groupBy("tile", "block_row", "block_col", "row", "col").agg(F.min("code").alias("code"))
    return once.groupBy("tile", "block_row", "block_col").applyInPandas(build, "tile string, block_row long, block_col long, codes binary")


def sample(points: DataFrame, blocks: DataFrame, grid: Grid, classes: list[int]) -> DataFrame:
    """points (id, lon, lat, tile) with ``code``: null outside of the point's tile, where the tile is not there, and for codes of no class.

    Raises if all points of a tile lie outside of it: their axes are swapped then, most likely.
    """
    west, north = grid.corner(F.col("tile"))
    inside = F.col("lon").between(west, west + grid.degrees) & F.col("lat").between(north - grid.degrees, north)
    lost = points.groupBy("tile").agg(F.bool_or(inside).alias("any"), F.count(F.lit(1)).alias("n")).where("not any").limit(5).collect()
    if lost:
        raise ValueError("; ".join(f"none of {r.n} points fall inside {r.tile}" for r in lost) + "; check the axis order")
    row, col = grid.pixel(west, north, F.col("lon"), F.col("lat"))
    own = points.withColumns({"_row": F.when(inside, row), "_col": F.when(inside, col)})
    own = own.withColumns({"block_row": F.floor(F.col("_row") / grid.block), "block_col": F.floor(F.col("_col") / grid.block), "_at": F.col("_row") % grid.block * grid.block + F.col("_col") % grid.block + 1})
    met = own.join(blocks.hint("merge"), ["tile", "block_row", "block_col"], "left")
    code = F.conv(F.hex(F.substring("codes", F.col("_at").cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.select(*points.columns, F.when(code.isin(classes), code).alias("code"))
