"""Samples that depend on ids only: the same rows whatever the partitioning. Order by md5, then id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.operators.spatial import inside
from skygrid.sources.scratch import written


def order(ident: str, seed: str = "") -> list[Column]:
    return [F.md5(F.concat(F.lit(seed), F.col(ident).cast("string")).cast("binary")), F.col(ident)]


def hash_sample(rows: DataFrame, ident: str, n: int, seed: str = "") -> DataFrame:
    """The n first rows in hash order (top-n by partition, then merged)."""
    return rows.orderBy(*order(ident, seed)).limit(n)


def ranked(rows: DataFrame, ident: str, stratum: str, seed: str = "") -> DataFrame:
    """rows with _r, the place (from 1) in hash order within the stratum.

    A stratum is cut into 4,096 ranges of the hash whose counts give each range its base, so a stratum
    with a third of all rows is not ranked in one task.
    """
    cut = rows.withColumn("_range", F.substring(order(ident, seed)[0], 1, 3))
    counts = cut.groupBy(stratum, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(stratum).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(stratum).alias("_s"), F.col("_range").alias("_g"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(stratum, "_range").orderBy(*order(ident, seed)))
    return cut.withColumn("_p", place).join(base, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_g"))).withColumn("_r", F.col("_p") + F.col("_base")).drop("_range", "_p", "_s", "_g", "_base")


def stratified(rows: DataFrame, ident: str, stratum: str, n: int, seed: str = "") -> DataFrame:
    """At most n rows of each stratum, the first in hash order."""
    return ranked(rows, ident, stratum, seed).where(F.col("_r") <= n).drop("_r")


def majority_cap(rows: DataFrame, ident: str, label: str, share: float) -> DataFrame:
    """rows in which the commonest label holds at most ``share``: as many of its rows, in hash order, as that allows."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    top = n.agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(label).alias("l"))).alias("b"), F.sum("_n").alias("t")).first()
    if top.b is None:
        return rows
    limit = int(share / (1 - share) * (top.t + top.b.m) + 1e-9)
    is_top = F.col(label).eqNullSafe(F.lit(top.b.l))
    return rows.where(~is_top).unionByName(ranked(rows.where(is_top), ident, label).where(F.col("_r") <= limit).drop("_r"))


def majority_kept(rows: DataFrame, ident: str, label: str, share: float) -> Column:
    """Whether ``majority_cap`` keeps a row of rows, told from the row alone: up to a place in hash order.

    Rows that share an ident are kept or left together, so at most as many rows of the commonest label are kept as the share allows.
    """
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    top = n.agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(label).alias("l"))).alias("b"), F.sum("_n").alias("t")).first()
    if top.b is None:
        return F.lit(True)
    left = int(share / (1 - share) * (top.t + top.b.m) + 1e-9)
    is_top = F.col(label).eqNullSafe(F.lit(top.b.l))
    spot, cut = F.struct(order(ident)[0].alias("h"), F.col(ident).alias("i")), F.substring(order(ident)[0], 1, 3)
    mine = rows.where(is_top).select(spot.alias("_s"), cut.alias("_range")).where("_range is not null")
    for r in mine.groupBy("_range").count().orderBy("_range").collect():  # at most 4,096
        if r["count"] > left:  # the last row kept is among this range's, ordered by themselves
            place = Window.orderBy("_s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
            last = mine.where(F.col("_range") == r["_range"]).withColumn("_n", F.count(F.lit(1)).over(place)).where(F.col("_n") <= left).agg(F.max("_s").alias("s")).first().s
            within = spot <= F.struct(F.lit(last.h).alias("h"), F.lit(last.i).alias("i")) if last else F.lit(False)
            return ~is_top | (cut < r["_range"]) | ((cut == r["_range"]) & within)
        left -= r["count"]
    return ~is_top | cut.isNotNull()


def bucket(ident: Column, seed: str, buckets: int) -> Column:
    """A bucket by md5 of seed and id: for calibration splits and folds."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), ident.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def uniform(seed: str, *parts: Column) -> Column:
    """A number from 0 up to 1 by md5 of seed and parts."""
    text = F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def probes(edges: DataFrame, quota: int, seed: str, bin_deg: float = 1.0, rounds: int = 40) -> DataFrame:
    """(poly_id, n, lon, lat): ``quota`` points of each polygon, uniform by area on the sphere, numbered from 0.

    Draw i of a polygon hangs on seed, polygon and i only: a point in its box that counts if it lies
    inside. The first ``quota`` that count are taken, whatever the partitions. A round makes twice the quota of
    draws for polygons that still lack points; after ``rounds`` of them those that lack any raise.
    """
    ends = [g(f(f"{x}1", f"{x}2")).alias(n) for n, g, f, x in (("w", F.min, F.least, "x"), ("e", F.max, F.greatest, "x"), ("s", F.min, F.least, "y"), ("n", F.max, F.greatest, "y"))]
    short, out = written(edges.groupBy("poly_id").agg(*ends).withColumn("lack", F.lit(quota))), None
    sine = lambda c: F.sin(F.radians(c))
    for r in range(rounds):
        if short.isEmpty():
            return out.select("poly_id", "n", "lon", "lat")
        i = F.explode(F.sequence(F.lit(2 * quota * r).cast("long"), F.lit(2 * quota * (r + 1) - 1).cast("long")))
        drawn = short.withColumn("i", i)
        lon = F.col("w") + uniform(seed, F.col("poly_id"), F.col("i"), F.lit("x")) * (F.col("e") - F.col("w"))
        lat = F.degrees(F.asin(sine("s") + uniform(seed, F.col("poly_id"), F.col("i"), F.lit("y")) * (sine("n") - sine("s"))))
        drawn = drawn.select(F.struct("poly_id", "i").alias("id"), "poly_id", "i", "lack", lon.alias("lon"), lat.alias("lat"))
        hit = inside(drawn, edges.join(short.select("poly_id"), "poly_id", "left_semi"), bin_deg).where("id.poly_id = poly_id").select("id")
        place = F.row_number().over(Window.partitionBy("poly_id").orderBy("i")) - 1
        took = written(drawn.join(hit, "id", "left_semi").withColumn("p", place).where("p < lack").select("poly_id", (F.lit(quota) - F.col("lack") + F.col("p")).alias("n"), "lon", "lat"))
        out = took if out is None else out.unionByName(took)
        got = took.groupBy("poly_id").agg(F.count(F.lit(1)).alias("got"))
        short = written(short.join(got, "poly_id", "left").withColumn("lack", F.col("lack") - F.coalesce("got", F.lit(0))).drop("got").where("lack > 0"))
    if short.isEmpty():
        return out.select("poly_id", "n", "lon", "lat")
    raise ValueError(f"polygons without {quota} points after {rounds} rounds: {[x.poly_id for x in short.select('poly_id').limit(10).collect()]}")
