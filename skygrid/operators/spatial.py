"""Spatial joins as equi-joins: grid bins for nearest and radius searches, edge parity for polygons.

One side is spread over the neighbouring bins (at most nine rows each), so the join has an equi key and
neither side needs to be small. Spark's estimate does not count those nine rows, nor what a written table holds once
it is unpacked, so joins are told to merge; AQE splits a hot bin. The nearest one is sought in cells that hold about one ref, then in wider ones for the
points that these leave open, so the pairs looked at grow with the points and not with the refs in the box.
Points without a partner stay, with nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrid.functions.geo import cell, conic, distance_m, haversine_m
from skygrid.sources.scratch import written

#: Points, spread over nine cells, that are sent to all tasks instead of being dealt (some 5 MB); halvings of the box at most.
FEW, HALVINGS = 10_000, 14


def in_box(points: DataFrame, refs: DataFrame, half: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points (id, lon, lat, ...) and refs (ref_id, rlon, rlat, ...) inside +-half degrees, with metres.

    ``extra``: columns that both have and that must be equal (a granule, say).
    """
    return _met(points, refs, half, half, extra)


def _spread(rows: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """rows in their own cell and the eight around it."""
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    out = rows.withColumn("_s", steps)
    return out.withColumn("_bx", cell(F.col(x), width) + F.col("_s.x")).withColumn("_by", cell(F.col(y), width) + F.col("_s.y")).drop("_s")


def _celled(rows: DataFrame, x: str, y: str, width: float) -> DataFrame:
    return rows.withColumn("_bx", cell(F.col(x), width)).withColumn("_by", cell(F.col(y), width))


def _met(points: DataFrame, refs: DataFrame, width: float, half: float, extra: tuple[str, ...], spread_points: bool = False, few: bool = False) -> DataFrame:
    """Pairs inside +-half degrees of points and the refs in the nine cells of ``width`` about them, with metres."""
    if spread_points:
        own, others = _spread(points, "lon", "lat", width), _celled(refs, "rlon", "rlat", width)
        near = others.join(F.broadcast(own) if few else own.hint("merge"), ["_bx", "_by", *extra])
    else:
        near = _celled(points, "lon", "lat", width).join(_spread(refs, "rlon", "rlat", width).hint("merge"), ["_bx", "_by", *extra])
    box = F.col("rlon").between(F.col("lon") - half, F.col("lon") + half) & F.col("rlat").between(F.col("lat") - half, F.col("lat") + half)
    return near.drop("_bx", "_by").where(box).withColumn("metres", distance_m(F.col("lon"), F.col("lat"), F.col("rlon"), F.col("rlat")))


def _widths(refs: DataFrame, half: float, extra: tuple[str, ...]) -> list[float]:
    """Cell widths up to ``half``, each twice the one before; in the first, a cell with refs holds about two or fewer."""
    widths = [half / 2**i for i in range(HALVINGS + 1)]
    held = (F.approx_count_distinct(F.xxhash64(cell(F.col("rlon"), w), cell(F.col("rlat"), w), *extra)).alias(f"c{i}") for i, w in enumerate(widths))
    got = refs.agg(F.count(F.lit(1)).alias("n"), *held).first()
    first = next((i for i in range(HALVINGS + 1) if got["n"] <= 2 * got[f"c{i}"]), HALVINGS)
    return widths[first::-1]


def _searched(points: DataFrame, refs: DataFrame, half: float, extra: tuple[str, ...], valid: Column | None, margin: float) -> list[tuple[float, DataFrame]]:
    """(width, found) by rounds; found: points' columns, ref_id, best, of those settled at that width.

    A point is settled once its best is nearer than whatever lies outside of its nine cells, by ``margin`` too.
    """
    places = written(refs.groupBy(*(c for c in refs.columns if c != "ref_id")).agg(F.min("ref_id").alias("ref_id")))
    open_, rounds, known = written(points.where("lon is not null and lat is not null")), [], [c for c in points.columns if c != "id" and c not in extra]
    refs_n, ident = places.count(), ["id", *extra]
    pick = F.struct("metres", "ref_id")
    for width in _widths(places, half, extra):
        n = open_.count()
        if not n:
            break
        pairs = _met(open_, places, width, half, extra, n < refs_n, n <= FEW)
        best = pairs.groupBy(*ident).agg(F.min(pick if valid is None else F.when(valid, pick)).alias("_b"), *(F.any_value(c).alias(c) for c in known)).where("_b is not null")
        # no degree of latitude is shorter than 110,500 m; one of longitude shrinks towards the pole
        east = F.lit(111_300 * width) * F.cos(F.radians(F.least(F.abs("lat") + width, F.lit(90.0))))
        sure = F.lit(True) if width == half else F.col("_b.metres") + margin < F.least(F.lit(110_500 * width), east)
        found = written(best.where(sure).select(*ident, *known, F.col("_b.ref_id").alias("ref_id"), F.col("_b.metres").alias("best")))
        rounds.append((width, found))
        if width < half:
            open_ = written(open_.join(found.select(*ident).hint("merge"), ident, "left_anti"))
    return rounds


def nearest(points: DataFrame, refs: DataFrame, half: float, extra: tuple[str, ...] = (), valid: Column | None = None) -> DataFrame:
    """(id, extra, ref_id, metres) of the nearest ref in the box (the smaller id if tied); points without one are left out.

    ``id`` and ``extra`` name a point once. ``valid``: a condition on columns of a pair other than ref_id.
    """
    out = [found.select("id", *extra, "ref_id", F.col("best").alias("metres")) for _, found in _searched(points, refs, half, extra, valid, 0.0)]
    empty = points.sparkSession.createDataFrame([], points.select("id", *extra).join(refs.select("ref_id")).withColumn("metres", F.lit(0.0)).schema)
    return reduce(DataFrame.unionByName, out, empty)


def nearest_ties(points: DataFrame, refs: DataFrame, half: float, within: float) -> DataFrame:
    """(id, ref_id, metres) of all refs in the box less than ``within`` metres further than the nearest."""
    out = []
    for width, found in _searched(points.select("id", "lon", "lat"), refs.select("ref_id", "rlon", "rlat"), half, (), None, 2 * within):
        pairs = _met(found.drop("ref_id"), refs.select("ref_id", "rlon", "rlat"), width, half, ())
        out.append(pairs.where(F.abs(F.col("metres") - F.col("best")) < within).select("id", "ref_id", "metres"))
    empty = points.sparkSession.createDataFrame([], points.select("id").join(refs.select("ref_id")).withColumn("metres", F.lit(0.0)).schema)
    return reduce(DataFrame.unionByName, out, empty)


def nearest_in_box(points: DataFrame, refs: DataFrame, half: float, valid: Column | None = None) -> DataFrame:
    """Each point's id, nearest ref (the smaller id if tied) and metres, and with ``valid`` also among valid refs."""
    out = points.select("id").join(nearest(points.select("id", "lon", "lat"), refs.select("ref_id", "rlon", "rlat"), half).hint("merge"), "id", "left")
    if valid is not None:
        also = nearest(points, refs, half, valid=valid).withColumnsRenamed({"ref_id": "valid_ref_id", "metres": "valid_metres"})
        out = out.join(also.hint("merge"), "id", "left")
    return out


def nearest_of_kinds(points: DataFrame, refs: DataFrame, half: float, kind: str) -> DataFrame:
    """(id, kind, metres): the nearest ref of each kind in the box; ``kind`` is a column of refs, null ones take no part."""
    kinds = refs.select(kind).where(F.col(kind).isNotNull()).distinct()
    each = points.select("id", "lon", "lat").crossJoin(F.broadcast(kinds))  # few kinds
    return nearest(each, refs.where(F.col(kind).isNotNull()).select("ref_id", "rlon", "rlat", kind), half, (kind,)).drop("ref_id")


def radius_counts(points: DataFrame, refs: DataFrame, radii: list[int], half: float) -> DataFrame:
    """Refs within each radius of each point, from one join at the largest; zero where there are none."""
    pairs = in_box(points, refs, half)
    found = pairs.groupBy("id").agg(*(F.count_if(F.col("metres") <= r).alias(f"n_{r}") for r in radii))
    return points.select("id").join(found.hint("merge"), "id", "left").select("id", *(F.nvl(f"n_{r}", F.lit(0)).alias(f"n_{r}") for r in radii))


def inside(points: DataFrame, edges: DataFrame, bin_deg: float) -> DataFrame:
    """(id, poly_id) of points inside polygons given by edges (poly_id, x1, y1, x2, y2), by parity; holes need no care.

    A point first meets the polygons whose box touches its bin (longitude and latitude), then of each only the
    edges that cross its latitude bin. A point on an edge counts by the half-open rule.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    binned = edges.where("y1 <> y2").withColumn("_by", F.explode(F.sequence(cell(low, bin_deg), cell(high, bin_deg))))
    box = edges.groupBy("poly_id").agg(*(g(f(f"{x}1", f"{x}2")).alias(n) for n, g, f, x in (("w", F.min, F.least, "x"), ("e", F.max, F.greatest, "x"), ("s", F.min, F.least, "y"), ("n", F.max, F.greatest, "y"))))
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), bin_deg), cell(F.col(b), bin_deg)))
    touched = box.withColumn("_bx", span("w", "e")).withColumn("_by", span("s", "n")).select("poly_id", "_bx", "_by")
    own = points.select("id", "lon", "lat", cell(F.col("lon"), bin_deg).alias("_bx"), cell(F.col("lat"), bin_deg).alias("_by"))
    near = own.join(touched, ["_bx", "_by"]).drop("_bx")
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = near.join(binned, ["poly_id", "_by"]).where(crosses).groupBy("id", "poly_id").agg(F.count(F.lit(1)).alias("_n"))
    return hits.where("_n % 2 = 1").select("id", "poly_id")


def segment_m(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres from a point to a segment, in the plane scaled at the point's latitude."""
    k = F.cos(F.radians(lat))
    ax, ay, bx, by = (x1 - lon) * k, y1 - lat, (x2 - lon) * k, y2 - lat
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    px, py = ax + t * dx, ay + t * dy
    return F.sqrt(px * px + py * py) * F.lit(111195.0797)


def matched_share(left: DataFrame, right: DataFrame, key: str, radii_m: list[int]) -> DataFrame:
    """Per radius, how many left points (id, key, lon, lat) have a right one of the same key within it (haversine)."""
    half = max(radii_m) / 111195.0797 / 0.5  # wide enough up to 60 degrees of latitude
    r = right.select(key, F.col("id").alias("ref_id"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    near = in_box(left, r, half, (key,)).withColumn("m", haversine_m(F.col("lon"), F.col("lat"), F.col("rlon"), F.col("rlat"))).groupBy("id").agg(F.min("m").alias("m"))
    covered = left.join(right.select(key).distinct(), key, "left_semi").join(near, "id", "left")
    wide = covered.agg(F.count(F.lit(1)).alias("covered"), *(F.count_if(F.col("m") <= x).alias(str(x)) for x in radii_m))
    return wide.unpivot(["covered"], [str(x) for x in radii_m], "radius", "matched").select(F.col("radius").cast("int").alias("radius"), "matched", "covered")


def edge_distance_sweep(points: DataFrame, edges: DataFrame, radii_m: list[int]) -> DataFrame:
    """Per radius, how many points (id, lon, lat) have a polygon edge within it.

    An edge goes to the one-degree bins within reach of the largest radius (up to 60 degrees of latitude).
    """
    reach = max(radii_m) / 111195.0797
    span = lambda a, b, r: F.explode(F.sequence(cell(F.least(a, b) - r, 1.0), cell(F.greatest(a, b) + r, 1.0)))
    binned = edges.withColumn("_bx", span("x1", "x2", 2 * reach)).withColumn("_by", span("y1", "y2", reach))
    near = points.withColumn("_bx", cell(F.col("lon"), 1.0)).withColumn("_by", cell(F.col("lat"), 1.0)).join(binned, ["_bx", "_by"])
    m = near.groupBy("id").agg(F.min(segment_m(*(F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")))).alias("m"))
    wide = points.select("id").join(m, "id", "left").agg(F.count(F.lit(1)).alias("orphans"), *(F.count_if(F.col("m") <= r).alias(str(r)) for r in radii_m))
    return wide.unpivot(["orphans"], [str(r) for r in radii_m], "metres", "within").select(F.col("metres").cast("int").alias("metres"), "within", "orphans")


def conic_segment_m(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres from a point to its closest point on a segment, all in metres of one plane."""
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(x - x1 - t * dx, y - y1 - t * dy)


def other_group_m(points: DataFrame, edges: DataFrame, reach: float, bin_deg: float = 1.0) -> DataFrame:
    """(id, metres) of points (id, grp, lon, lat): distance on the national conic to the nearest polygon of another group.

    Edges are (poly_id, grp, x1, y1, x2, y2) in degrees, straight on the conic. A point inside such a polygon is
    at 0; null: none within ``reach``. An edge is met by the squares of twice ``reach`` that its box, widened, touches.
    """
    side = 2 * reach
    ends = dict(zip(("_x1", "_y1", "_x2", "_y2"), (*conic(F.col("x1"), F.col("y1")), *conic(F.col("x2"), F.col("y2"))), strict=True))
    flat = edges.withColumns(ends).select(F.col("grp").alias("_grp"), *ends)
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - reach, side), cell(F.greatest(a, b) + reach, side)))
    flat = flat.withColumn("_bx", span("_x1", "_x2")).withColumn("_by", span("_y1", "_y2"))
    x, y = conic(F.col("lon"), F.col("lat"))
    own = points.withColumns({"_x": x, "_y": y}).withColumns({"_bx": cell(F.col("_x"), side), "_by": cell(F.col("_y"), side)})
    near = own.join(flat, ["_bx", "_by"]).where("grp <> _grp").withColumn("m", conic_segment_m(*(F.col(c) for c in ("_x", "_y", *ends)))).where(F.col("m") <= reach)
    groups = edges.select("poly_id", F.col("grp").alias("_grp")).distinct()
    within = inside(points, edges, bin_deg).join(groups, "poly_id").join(points.select("id", "grp"), "id").where("grp <> _grp").select("id", F.lit(0.0).alias("m"))
    best = near.select("id", "m").unionByName(within).groupBy("id").agg(F.min("m").alias("metres"))
    return points.select("id").join(best, "id", "left")


def region_distances(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """(id, poly_id, metres): each point (id, lon, lat) with every polygon that has an edge within ``reach``, and the distance to its nearest edge."""
    degrees = reach / 111195.0797
    span = lambda a, b, r: F.explode(F.sequence(cell(F.least(a, b) - r, 1.0), cell(F.greatest(a, b) + r, 1.0)))
    binned = edges.withColumn("_bx", span("x1", "x2", 2 * degrees)).withColumn("_by", span("y1", "y2", degrees))
    near = points.withColumn("_bx", cell(F.col("lon"), 1.0)).withColumn("_by", cell(F.col("lat"), 1.0)).join(binned, ["_bx", "_by"])
    m = near.groupBy("id", "poly_id").agg(F.min(segment_m(*(F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")))).alias("metres"))
    return m.where(F.col("metres") <= reach)
