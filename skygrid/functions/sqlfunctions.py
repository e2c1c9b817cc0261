"""The geographic kernels as SQL functions. Spark inlines their bodies, so they are columns like any other.

Distances are of any length: Lambert's formula on the ellipsoid (a great circle through reduced latitudes and a
first-order correction by the flattening), within a few parts in 100,000 of the geodesic.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from skygrid.functions.geo import E2, A

_F = 1 - math.sqrt(1 - E2)  # flattening
_E = math.sqrt(E2)


def geodesic_sql(lon_a: str, lat_a: str, lon_b: str, lat_b: str) -> str:
    reduced = lambda lat: f"atan({1 - _F!r}e0 * tan(radians({lat})))"
    p, q = f"(({reduced(lat_a)} + {reduced(lat_b)}) / 2)", f"(({reduced(lat_b)} - {reduced(lat_a)}) / 2)"
    half = f"(radians({lon_b} - {lon_a}) / 2)"
    h = f"least(1e0, pow(sin({q}), 2) + cos({reduced(lat_a)}) * cos({reduced(lat_b)}) * pow(sin({half}), 2))"
    s = f"(2 * asin(sqrt({h})))"
    near = f"(({s} - sin({s})) * coalesce(pow(sin({p}) * cos({q}), 2) / nullif(pow(cos({s} / 2), 2), 0e0), 0e0))"
    far = f"(({s} + sin({s})) * coalesce(pow(cos({p}) * sin({q}), 2) / nullif(pow(sin({s} / 2), 2), 0e0), 0e0))"
    return f"{A!r}e0 * ({s} - {_F / 2!r}e0 * ({near} + {far}))"


def _q(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"({1 - E2!r}D * ({s} / (1 - {E2!r}D * {s} * {s}) - {1 / (2 * _E)!r}D * ln((1 - {_E!r}D * {s}) / (1 + {_E!r}D * {s}))))"


def area_sql(wkt: str) -> str:
    """km2 of a WKT polygon: outer rings less holes, each by its edges' areas, made positive."""
    clean = rf"regexp_replace({wkt}, '\\s*([(),])\\s*', '$1')"
    part = lambda i: rf"regexp_extract_all({clean}, '(\\(+)([^()]+)\\)', {i})"
    xy = lambda p, i: rf"CAST(split({p}, '\\s+')[{i}] AS DOUBLE)"
    edge = f"radians({xy('a', 0)} - {xy('b', 0)}) * ({_q(xy('a', 1))} + {_q(xy('b', 1))}) / 2"
    ring = f"abs(aggregate(zip_with(slice(split(r, ','), 1, size(split(r, ',')) - 1), slice(split(r, ','), 2, size(split(r, ',')) - 1), (a, b) -> {edge}), 0.0D, (s, x) -> s + x))"
    return f"{A * A / 2 / 1e6!r}D * aggregate(zip_with({part(1)}, {part(2)}, (o, r) -> IF(length(o) >= 2, 1, -1) * {ring}), 0.0D, (s, x) -> s + x)"


POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
#: name: (arguments, result, body). Longitude comes first everywhere.
FUNCTIONS = {
    "geo_point": ("lon DOUBLE, lat DOUBLE", POINT, "named_struct('x', lon, 'y', lat)"),
    "geo_distance_m": ("lon_a DOUBLE, lat_a DOUBLE, lon_b DOUBLE, lat_b DOUBLE", "DOUBLE", geodesic_sql("lon_a", "lat_a", "lon_b", "lat_b")),
    "geo_distance_geom_m": (f"a {POINT}, b {POINT}", "DOUBLE", geodesic_sql("a.x", "a.y", "b.x", "b.y")),
    "geo_area_km2": ("wkt STRING", "DOUBLE", area_sql("wkt")),
    "geo_cell": ("v DOUBLE, width DOUBLE", "BIGINT", "CAST(floor(v / width) AS BIGINT)"),
}


def install(spark: SparkSession) -> None:
    """Define the functions for the session; ``spark.sql(text, args={...})`` binds values by name to ``:name``."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
