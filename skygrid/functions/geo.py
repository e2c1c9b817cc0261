"""Geographic Column kernels: distances, cells, sun, projection, areas. Longitude comes first everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: WGS84 and the mean Earth radius.
A, E2, R = 6378137.0, 0.0066943799901413165, 6371008.8


def distance_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Metres on the ellipsoid by the radii of curvature at the mean latitude; for short ranges."""
    mid = F.radians((lat_a + lat_b) / 2)
    s = 1 - F.lit(E2) * F.sin(mid) * F.sin(mid)
    north = F.lit(A * (1 - E2)) / (s * F.sqrt(s)) * F.radians(lat_b - lat_a)
    east = F.lit(A) / F.sqrt(s) * F.cos(mid) * F.radians(lon_b - lon_a)
    return F.sqrt(north * north + east * east)


def haversine_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return F.lit(2 * R) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cell(x: Column, width: float) -> Column:
    """Grid cell by floor, also left of zero."""
    return F.floor(x / F.lit(float(width))).cast("long")


def local_solar_hour(hour: Column, lon: Column, meridian: float = 82.5) -> Column:
    return F.pmod(hour + (lon - F.lit(meridian)) / 15.0, F.lit(24.0))


def solar_zenith_deg(day: Column, hour: Column, lon: Column, lat: Column) -> Column:
    """Solar zenith angle from the day of the year and the UTC hour (Fourier series of Spencer 1971).

    Its coefficients are fixed values.
    """
    g = (day - 1 + (hour - 12) / 24.0) * F.lit(2 * math.pi / 365)
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    eqt = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    angle = F.radians((hour * 60 + eqt + 4 * lon) / 4 - 180)
    c = F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(angle)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def mercator(lon: Column, lat: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """Ellipsoidal Mercator (x, y) in metres, true at the equator."""
    e, s = math.sqrt(E2), F.sin(F.radians(lat))
    y = F.lit(A) * (F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) + F.lit(e / 2) * F.log((1 - e * s) / (1 + e * s)))
    return F.lit(A) * F.radians(lon - F.lit(lon0)), y


def mercator_inverse(x: Column, y: Column, lon0: float = 0.0, steps: int = 8) -> tuple[Column, Column]:
    """(lon, lat) of ellipsoidal Mercator by fixed-point steps, unrolled."""
    e = math.sqrt(E2)
    t = F.exp(-y / A)
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(steps):
        s = e * F.sin(phi)
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), e / 2))
    return F.degrees(x / A) + F.lit(lon0), F.degrees(phi)


def authalic_sine(lat: Column) -> Column:
    """q(lat) of the authalic latitude; the area of a band is A^2 / 2 times the difference of q times the angle."""
    e, s = math.sqrt(E2), F.sin(F.radians(lat))
    return (1 - E2) * (s / (1 - E2 * s * s) - F.lit(1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s)))


def edge_area_km2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Signed area under one polygon edge; the sum over a ring, made positive, is its area."""
    return F.lit(A * A / 2 / 1e6) * F.radians(x1 - x2) * (authalic_sine(y1) + authalic_sine(y2)) / 2


#: The national conic EPSG:7755 on WGS84 (standard parallels, origin, false easting and northing).
CONIC = {"parallels": (12.472955, 35.1728044444444), "lat": 24.0, "lon": 80.0, "x": 4_000_000.0, "y": 4_000_000.0}


def _conic_constants() -> tuple[float, float, float]:
    """(n, A F, radius at the origin) of the conformal conic."""
    e = math.sqrt(E2)
    m = lambda p: math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2 = map(math.radians, CONIC["parallels"])
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = A * m(p1) / (n * t(p1) ** n)
    return n, f, f * t(math.radians(CONIC["lat"])) ** n


def conic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres on the national conic."""
    n, f, origin = _conic_constants()
    e, s = math.sqrt(E2), F.sin(F.radians(lat))
    t = F.tan(F.lit(math.pi / 4) - F.radians(lat) / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
    r, angle = F.lit(f) * F.pow(t, F.lit(n)), F.radians(lon - F.lit(CONIC["lon"])) * n
    return F.lit(CONIC["x"]) + r * F.sin(angle), F.lit(CONIC["y"] + origin) - r * F.cos(angle)


def conic_sql(lon: str, lat: str) -> tuple[str, str]:
    """The same as SQL texts."""
    n, f, origin = _conic_constants()
    e = math.sqrt(E2)
    t = f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {e!r} * sin(radians({lat}))) / (1 + {e!r} * sin(radians({lat}))), {e / 2!r}))"
    r, angle = f"({f!r}::DOUBLE * pow({t}, {n!r}::DOUBLE))", f"(radians({lon} - 80) * {n!r}::DOUBLE)"
    return f"({CONIC['x']!r}::DOUBLE + {r} * sin({angle}))", f"({CONIC['y'] + origin!r}::DOUBLE - {r} * cos({angle}))"


def wkt_ring(text: Column) -> Column:
    """The outer ring of a WKT polygon as an array of (x, y)."""
    pairs = F.split(F.regexp_extract(text, r"\(\(([^)]*)\)", 1), ",")
    return F.transform(pairs, lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].try_cast("double").alias("y")))


def ring_edges(rings):
    """Edges (poly_id, x1, y1, x2, y2) of closed rings (poly_id, ring)."""
    n = F.size("ring")
    step = F.explode(F.arrays_zip(F.slice("ring", F.lit(1), n - 1).alias("a"), F.slice("ring", F.lit(2), n - 1).alias("b"))).alias("e")
    return rings.select("poly_id", step).select("poly_id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def wkt_rings(text: Column) -> Column:
    """All rings of a WKT POLYGON or MULTIPOLYGON: array of (opens, points), ``opens`` where a ring begins a part, else a hole.

    Null and EMPTY give no rings; a coordinate that is no number is null in its point.
    """
    clean = F.regexp_replace(text, r"\s*([(),])\s*", "$1")
    opens = F.regexp_extract_all(clean, F.lit(r"(\(+)([^()]+)\)"), F.lit(1))
    bodies = F.regexp_extract_all(clean, F.lit(r"(\(+)([^()]+)\)"), F.lit(2))
    point = lambda p: F.transform(F.array(F.split(p, r"\s+")), lambda xy: F.struct(F.try_element_at(xy, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(xy, F.lit(2)).try_cast("double").alias("y")))[0]
    rings = F.zip_with(opens, bodies, lambda o, b: F.struct((F.length(o) >= 2).alias("opens"), F.transform(F.split(b, ","), point).alias("points")))
    return F.coalesce(rings, F.array().cast("array<struct<opens:boolean,points:array<struct<x:double,y:double>>>>"))


def wkt_edges(areas, ident: str, text: str):
    """Edges (poly_id, part, ring, seq, x1, y1, x2, y2) of areas with WKT: outer rings counter-clockwise, holes clockwise.

    Parts, rings of a part and edges count from 0. A ring that is not closed, has fewer than four
    points or one that is no number raises, with the area's id.
    """
    ring = areas.select(F.col(ident).alias("poly_id"), F.posexplode(wkt_rings(F.col(text))).alias("_n", "_r")).select("poly_id", "_n", F.col("_r.opens").alias("opens"), F.col("_r.points").alias("p"))
    bad = (F.size("p") < 4) | F.exists("p", lambda q: q["x"].isNull() | q["y"].isNull()) | (F.element_at("p", 1) != F.element_at("p", -1))
    pairs = F.arrays_zip(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))).alias("a"), F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))).alias("b"))
    twice = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a closed ring in area "), F.col("poly_id").cast("string")))).otherwise(F.col("p"))
    ring = ring.select("poly_id", "_n", "opens", F.when((twice > 0) == F.col("opens"), checked).otherwise(F.reverse(checked)).alias("ring"))
    order = Window.partitionBy("poly_id").orderBy("_n")
    ring = ring.withColumn("part", F.sum(F.col("opens").cast("int")).over(order) - 1)
    ring = ring.withColumn("k", F.row_number().over(Window.partitionBy("poly_id", "part").orderBy("_n")) - 1)
    n = F.size("ring") - 1
    step = F.posexplode(F.arrays_zip(F.slice("ring", F.lit(1), n).alias("a"), F.slice("ring", F.lit(2), n).alias("b"))).alias("seq", "e")
    return ring.select("poly_id", "part", F.col("k").alias("ring"), step).select("poly_id", "part", "ring", "seq", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
