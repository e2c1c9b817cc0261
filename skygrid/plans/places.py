"""Queries on raster tiles, WKT areas, seeded probes, SQL functions, named tables and typed JSON, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skygrid.functions import geo, matrix, scalars, sqlfunctions
from skygrid.operators import cluster, sampling, spatial, temporal, tiles
from skygrid.plans import catalog
from skygrid.plans.catalog import AREA, BOXES, INSIDE, POINTS, _q, edges, points, query, rounded
from skygrid.sources import named, strict_json
from skygrid.sources import tables as T

#: 16 pixels a degree, from orders; a pixel that no order falls on has no data.
GRID = tiles.Grid(degrees=3, pixels=48, block=16)
CLASSES = [10, 20, 30, 40]


def pixels(t):
    x, y = F.col("o_orderkey") * 7919 % (30 * 16), F.col("o_orderkey") * 104729 % (31 * 16)
    lon, lat = 68 + (x + 0.5) / 16, 6.5 + (y + 0.5) / 16
    tile = GRID.tile(lon, lat)
    west, north = GRID.corner(tile)
    row, col = GRID.pixel(west, north, lon, lat)
    return t("orders").select(tile.alias("tile"), row.alias("row"), col.alias("col"), (10 * (1 + F.col("o_orderkey") % 5)).cast("int").alias("code"))


@query(f"""WITH px AS (SELECT o_orderkey*7919 % 480 AS x, o_orderkey*104729 % 496 AS y, CAST(min(10 * (1 + o_orderkey % 5)) AS INTEGER) AS code FROM orders GROUP BY 1, 2),
p AS (SELECT id, lon, lat, CAST(floor((lon - 68) * 16) AS BIGINT) AS x, CASE WHEN lat * 16 = floor(lat * 16) AND lat / 3 <> floor(lat / 3) THEN CAST(lat * 16 AS BIGINT) - 105 ELSE CAST(floor((lat - 6.5) * 16) AS BIGINT) END AS y, CAST(floor(lat / 3) * 3 AS BIGINT) AS s, CAST(floor(lon / 3) * 3 AS BIGINT) AS w FROM {POINTS})
SELECT id, 'N' || lpad(CAST(s AS VARCHAR), 2, '0') || 'E' || lpad(CAST(w AS VARCHAR), 3, '0') AS tile, CASE WHEN code < 50 THEN code END AS code FROM p LEFT JOIN px USING (x, y)""")
def tile_samples(t):
    """Classes of tiled pixel blocks under points; pixels without data or of no class are null."""
    at = points(t).select("id", "lon", "lat").withColumn("tile", GRID.tile(F.col("lon"), F.col("lat")))
    return tiles.sample(at, tiles.to_blocks(pixels(t), GRID), GRID, CLASSES).select("id", "tile", "code")


def regions(t):
    """Nations as MULTIPOLYGON texts: a box with a hole, and a box of half a degree beside it."""
    k = F.col("n_nationkey")
    x, y = 68 + (k % 5) * 5.5, 7 + F.floor(k / 5) * 6.0

    def ring(*corners):
        return F.concat(F.lit("("), F.concat_ws(", ", *(F.concat_ws(" ", (x + a).cast("string"), (y + b).cast("string")) for a, b in corners)), F.lit(")"))

    outer, hole = ring((0, 0), (5, 0), (5, 5.5), (0, 5.5), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
    beside = ring((5, 0), (5, 0.5), (5.5, 0.5), (5.5, 0), (5, 0))
    return t("nation").select(k.alias("poly_id"), F.concat(F.lit("MULTIPOLYGON (("), outer, F.lit(" , "), hole, F.lit("), ( "), beside, F.lit("))")).alias("wkt"))


_REGION_KM2 = f"{AREA.format(w='5.0e0', q2=_q('y0 + 5.5'), q1=_q('y0'))} - {AREA.format(w='1.0e0', q2=_q('y0 + 2'), q1=_q('y0 + 1'))} + {AREA.format(w='0.5e0', q2=_q('y0 + 0.5'), q1=_q('y0'))}"
_BESIDE = "lon >= x0 + 5 AND lon < x0 + 5.5 AND lat >= y0 AND lat < y0 + 0.5"


@query(f"SELECT poly_id, 3 AS rings, round({_REGION_KM2}, 3) AS km2, count(id) AS n FROM {BOXES} LEFT JOIN {POINTS} ON ({INSIDE}) OR ({_BESIDE}) GROUP BY poly_id, y0")
def wkt_regions(t):
    """Whole WKT areas as oriented edges: rings, area and points inside."""
    e = geo.wkt_edges(regions(t), "poly_id", "wkt")
    size = e.groupBy("poly_id").agg(F.countDistinct("part", "ring").cast("int").alias("rings"), F.sum(geo.edge_area_km2(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))).alias("km2"))
    n = spatial.inside(points(t), e, 1.0).groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"))
    return size.join(n, "poly_id", "left").select("poly_id", "rings", F.round("km2", 3).alias("km2"), F.coalesce("n", F.lit(0)).alias("n"))


_UNIFORM = "CAST('0x' || substr(md5('probe:' || poly_id || ':' || i || ':{}'), 1, 8) AS BIGINT) / 4294967296e0"


@query(f"""WITH d AS (SELECT *, x0 + {_UNIFORM.format("x")} * 5 AS lon, degrees(asin(sin(radians(y0)) + {_UNIFORM.format("y")} * (sin(radians(y0 + 5.5)) - sin(radians(y0))))) AS lat FROM {BOXES}, range(0, 300) r(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY poly_id ORDER BY i) - 1 AS n FROM d WHERE {INSIDE}) SELECT poly_id, CAST(n AS INTEGER) AS n, round(lon, 6) AS lon, round(lat, 6) AS lat FROM k WHERE n < 40""")
def seeded_probes(t):
    """Forty points of each nation outside of its hole."""
    return rounded(sampling.probes(edges(t), 40, "probe"))


@query(f"SELECT id, round({sqlfunctions.geodesic_sql('lon', 'lat', '77.209', '28.6139')} / 1000, 3) AS km FROM {POINTS} WHERE lat BETWEEN 28 AND 30")
def distance_by_name(t):
    """``geo_distance_m`` in SQL text with bound parameters."""
    frame = points(t).select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    spark = frame.sparkSession
    sqlfunctions.install(spark)
    frame.createOrReplaceTempView("located_points")
    return spark.sql("SELECT id, round(geo_distance_m(lon, lat, :lon, :lat) / 1000, 3) AS km FROM located_points WHERE lat BETWEEN :low AND :high", args={"lon": 77.209, "lat": 28.6139, "low": 28.0, "high": 30.0})


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value IS NOT NULL GROUP BY 1")
def named_release(t):
    """A table replaced as a whole under its name, its shares checked in the pass that writes it, and read by name."""
    e = t("events").where("value is not null").select("event_id", "user_id", "event_type")
    share = lambda kind: F.sum((F.col("event_type") == kind).cast("long")) / F.count(F.lit(1))
    expect = {f"share of {k}": (share(k), lambda m: m <= 0.6) for k in ("click", "view", "purchase")} | {"rows": (F.count(F.lit(1)), lambda m: m > 0)}
    named.replace_table(e, "skygrid_events", expect)
    return e.sparkSession.sql("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM skygrid_events GROUP BY 1")


SHAPE = {"k": "integer", "tags?": ["string"], "at": ({"x": "number", "kind": {"click", "view", "error"}}, None)}
_JSON = """(SELECT event_id, CASE WHEN event_id % 11 = 0 THEN props || '}' WHEN event_id % 13 = 0 THEN NULL ELSE '{"k":' || CASE WHEN event_id % 5 = 0 THEN '"' || user_id || '"' WHEN event_id % 5 = 1 THEN CAST(value AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END
|| CASE WHEN event_id % 3 = 0 THEN ',"tags":["a",' || CASE WHEN event_id % 2 = 0 THEN '1' ELSE '"b"' END || ']' ELSE '' END || CASE event_id % 4 WHEN 0 THEN ',"at":null' WHEN 1 THEN '' WHEN 2 THEN ',"at":{"x":' || event_id || ',"kind":"' || event_type || '"}' ELSE ',"at":{"x":"1","kind":7,"zz":[]},"more":true' END || '}' END AS doc FROM events)"""


@query(f"""WITH d AS (SELECT event_id, CASE WHEN doc IS NOT NULL AND json_valid(doc) THEN doc END AS doc FROM {_JSON}),
f AS (SELECT event_id, doc,
 list_transform(list_filter(list_sort(json_keys(doc)), lambda k: k NOT IN ('k', 'tags', 'at')), lambda k: '$.' || k || ': unknown key')
 || CASE WHEN json_type(doc, '$.k') IS NULL THEN ['$.k: missing'] WHEN json_type(doc, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN ['$.k: expected integer, found ' || CASE json_type(doc, '$.k') WHEN 'VARCHAR' THEN 'string' ELSE 'number' END] ELSE [] END
 || CASE WHEN json_type(doc, '$.tags') IS NULL THEN [] ELSE list_filter(list_transform(range(CAST(json_array_length(doc, '$.tags') AS BIGINT)), lambda i: CASE WHEN json_type(doc, '$.tags[' || i || ']') <> 'VARCHAR' THEN '$.tags[' || i || ']: expected string, found integer' END), lambda x: x IS NOT NULL) END
 || CASE WHEN json_type(doc, '$.at') IS NULL THEN ['$.at: missing'] WHEN json_type(doc, '$.at') = 'NULL' THEN [] ELSE
   list_transform(list_filter(list_sort(json_keys(doc, '$.at')), lambda k: k NOT IN ('x', 'kind')), lambda k: '$.at.' || k || ': unknown key')
   || CASE WHEN json_type(doc, '$.at.x') = 'VARCHAR' THEN ['$.at.x: expected number, found string'] ELSE [] END
   || CASE WHEN json_type(doc, '$.at.kind') <> 'VARCHAR' THEN ['$.at.kind: expected string, found integer'] WHEN json_extract_string(doc, '$.at.kind') NOT IN ('click', 'view', 'error') THEN ['$.at.kind: expected one of click, error, view'] ELSE [] END END AS faults FROM d)
SELECT event_id, CASE WHEN doc IS NULL THEN '$: not JSON' ELSE array_to_string(faults, '; ') END AS faults FROM f""")
def typed_json(t):
    """Every document's faults by path: wrong kinds, missing and unknown keys, items of lists, text that is no JSON."""
    t("events").createOrReplaceTempView("typed_json_events")
    spark = t("events").sparkSession
    docs = spark.sql(f"SELECT * FROM {_JSON.replace('FROM events)', 'FROM typed_json_events)').replace('CAST(value AS VARCHAR)', 'CAST(value AS STRING)').replace('CAST(user_id AS VARCHAR)', 'CAST(user_id AS STRING)')}")
    return strict_json.checked(docs, "doc", SHAPE).select("event_id", F.array_join("faults", "; ").alias("faults"))


_GROUPED = f"(SELECT id, lon, lat, min(poly_id) % 3 AS grp FROM {POINTS} JOIN {BOXES} ON {INSIDE} GROUP BY 1, 2, 3)"
_RINGS = f"""(SELECT poly_id, poly_id % 3 AS grp, unnest([[x0, y0, x0 + 5, y0], [x0 + 5, y0, x0 + 5, y0 + 5.5], [x0 + 5, y0 + 5.5, x0, y0 + 5.5], [x0, y0 + 5.5, x0, y0], [x0 + 1, y0 + 1, x0 + 1, y0 + 2], [x0 + 1, y0 + 2, x0 + 2, y0 + 2], [x0 + 2, y0 + 2, x0 + 2, y0 + 1], [x0 + 2, y0 + 1, x0 + 1, y0 + 1]]) AS c FROM {BOXES})"""
_RADII = (2000, 10000, 30000, 60000)


def _on_conic(lon: str, lat: str, x: str, y: str) -> str:
    return f"{geo.conic_sql(lon, lat)[0]} AS {x}, {geo.conic_sql(lon, lat)[1]} AS {y}"


@query(f"""WITH p AS (SELECT id, grp, {_on_conic("lon", "lat", "x", "y")} FROM {_GROUPED}), e AS (SELECT grp AS g, {_on_conic("c[1]", "c[2]", "x1", "y1")}, {_on_conic("c[3]", "c[4]", "x2", "y2")} FROM {_RINGS}),
d AS (SELECT id, x - x1 AS px, y - y1 AS py, x2 - x1 AS dx, y2 - y1 AS dy FROM p JOIN e ON grp <> g), m AS (SELECT id, sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) AS m FROM (SELECT *, greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM d)),
b AS (SELECT p.id, p.grp, min(m) AS m FROM p LEFT JOIN m ON m.id = p.id GROUP BY 1, 2)
SELECT CAST(v AS INTEGER) AS metres, grp AS "group", count(*) FILTER (WHERE m <= v) AS within, count(*) AS points FROM b, (VALUES {", ".join(f"({r})" for r in _RADII)}) x(v) GROUP BY 1, 2""")
def boundary_exposure(t):
    """Per group, how many of its points lie within each of four distances of a polygon of another group, on the conic."""
    e = edges(t).withColumn("grp", F.col("poly_id") % 3)
    own = spatial.inside(points(t), e, 1.0).groupBy("id").agg((F.min("poly_id") % 3).alias("grp"))
    p = points(t).select("id", "lon", "lat").join(own, "id")
    near = spatial.other_group_m(p, e, max(_RADII)).join(own, "id")
    wide = near.groupBy("grp").agg(F.count(F.lit(1)).alias("points"), *(F.count_if(F.col("metres") <= r).alias(str(r)) for r in _RADII))
    return wide.unpivot(["grp", "points"], [str(r) for r in _RADII], "metres", "within").select(F.col("metres").cast("int").alias("metres"), F.col("grp").alias("group"), "within", "points")


@query(f"""WITH p AS (SELECT id, lon, lat FROM {POINTS} WHERE NOT EXISTS (SELECT 1 FROM {BOXES} WHERE {INSIDE})), e AS (SELECT poly_id, c[1] AS x1, c[2] AS y1, c[3] AS x2, c[4] AS y2 FROM {_RINGS}),
d AS (SELECT id, poly_id, (x1 - lon) * cos(radians(lat)) AS ax, y1 - lat AS ay, (x2 - x1) * cos(radians(lat)) AS dx, y2 - y1 AS dy FROM p, e WHERE greatest(x1, x2) > lon - 1 AND least(x1, x2) < lon + 1 AND greatest(y1, y2) > lat - 1 AND least(y1, y2) < lat + 1),
m AS (SELECT id, poly_id, min(111195.0797e0 * sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS m FROM (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM d) GROUP BY 1, 2)
SELECT id, poly_id, round(m, 2) AS metres FROM m WHERE m <= 50000""")
def orphan_regions(t):
    """Each point outside of all polygons with every region in reach and the distance to it."""
    outside = points(t).select("id", "lon", "lat").join(spatial.inside(points(t), edges(t), 1.0), "id", "left_anti")
    return spatial.region_distances(outside, edges(t), 50000).select("id", "poly_id", F.round("metres", 2).alias("metres"))


_SPOTS = f"(SELECT id, lon + 0.0000012e0 AS lon, lat + 0.0000012e0 AS lat, CAST(floor(lon) * 100 + floor(lat) AS BIGINT) AS cluster, CASE WHEN user_id % 4 > 0 THEN event_type END AS state, user_id AS priors, hour(ts) < 6 AS night, CASE WHEN user_id % 3 = 0 THEN value * 10 END AS asset_m FROM {POINTS})"


@query(f"""WITH p AS (SELECT * FROM {_SPOTS}), c AS (SELECT cluster, avg(lon) AS x, avg(lat) AS y, count(*) AS n, max(priors) AS pr, avg(CAST(night AS INTEGER)) AS nf, min(asset_m) AS m FROM p GROUP BY 1 HAVING count(*) >= 5),
s AS (SELECT cluster, state, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, state) AS r FROM p WHERE state IS NOT NULL GROUP BY 1, 2),
f AS (SELECT cluster, max(6371008.8e0 * sqrt(pow(radians(lat - y), 2) + pow(radians(lon - x), 2))) AS f FROM p JOIN c USING (cluster) GROUP BY 1)
SELECT cluster, round(x, 5) AS lon, round(y, 5) AS lat, state, n AS detections, pr AS max_priors, round(nf, 3) AS night_fraction, CAST(round(m) AS BIGINT) AS nearest_asset_m, coalesce(m <= 100, false) AS registered, CAST(round(f) AS BIGINT) AS spread_m FROM c JOIN f USING (cluster) LEFT JOIN s ON s.cluster = c.cluster AND r = 1""")
def persistent_sources(t):
    """All columns of a cluster's summary; clusters are squares of a degree here. Points are moved by a millionth, as many centres would lie on a tie at five places."""
    u = F.col("user_id")
    p = points(t).select("id", (F.col("lon").cast("double") + 0.0000012).alias("lon"), (F.col("lat").cast("double") + 0.0000012).alias("lat"), (F.floor("lon") * 100 + F.floor("lat")).cast("long").alias("cluster"), F.when(u % 4 > 0, F.col("event_type")).alias("state"), u.alias("priors"), (F.hour("ts") < 6).alias("night"), F.when(u % 3 == 0, F.col("value") * 10).alias("asset_m"))
    return cluster.summary(p, 5, 100)


FEATURES = "frp scan track bright_primary bright_secondary bright_ratio confidence_ordinal hour_sin hour_cos doy_sin doy_cos is_night prior_count_90d prior_count_30d night_fraction_90d frp_variance_90d mean_gap_days is_viirs".split()


@query(f"""WITH r AS ({catalog.oracle_sql()["recurrence_features"]}), e AS (SELECT *, event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND value IS NOT NULL AND night_fraction IS NOT NULL AND value_variance IS NOT NULL AND mean_gap_days IS NOT NULL AS whole FROM events JOIN r USING (event_id))
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE whole) AS assessable, count(*) FILTER (WHERE value_variance IS NULL) AS without_history, 18 AS features FROM e GROUP BY 1""")
def training_matrix(t):
    """Eighteen whitelisted features with their missing values kept; rows that lack any are counted, not filled."""
    k = F.col("event_id")
    e = t("events").withColumns({"hour": F.date_trunc("hour", F.col("ts").cast("timestamp")), "night": catalog.is_night()})
    r = temporal.recurrence(e, "user_id", F.col("hour"), F.col("value"), F.hour("hour").isin(*range(6), *range(18, 24)), 7, 2)
    sin_h, cos_h = scalars.cyclic(F.hour("ts"), 24)
    sin_d, cos_d = scalars.cyclic(F.dayofyear("ts"), 366)
    primary, secondary = 300 + k % 50, F.when(k % 13 > 0, 290 + k % 20)
    rows = r.select("event_id", "event_type", F.col("value").alias("frp"), F.when(k % 7 > 0, k % 5).alias("scan"), F.when(k % 11 > 0, k % 3).alias("track"), primary.alias("bright_primary"), secondary.alias("bright_secondary"), scalars.safe_ratio(primary, secondary).alias("bright_ratio"), (k % 3).alias("confidence_ordinal"), sin_h.alias("hour_sin"), cos_h.alias("hour_cos"), sin_d.alias("doy_sin"), cos_d.alias("doy_cos"), F.col("night").alias("is_night"), F.col("prior_count").alias("prior_count_90d"), F.col("prior_count_short").alias("prior_count_30d"), F.col("night_fraction").alias("night_fraction_90d"), F.col("value_variance").alias("frp_variance_90d"), "mean_gap_days", (k % 2 == 0).alias("is_viirs"))
    m = matrix.whitelisted(rows.withColumn("is_night", F.col("is_night").cast("int")).withColumn("is_viirs", F.col("is_viirs").cast("int")), ["event_type"], FEATURES, ["flare_m", "industrial_m", "weak_label"], ["latitude", "longitude", "state_name"])
    return m.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(matrix.observed(FEATURES)).alias("assessable"), F.count_if(F.col("frp_variance_90d").isNull()).alias("without_history"), F.lit(len(FEATURES)).alias("features"))


@query("""WITH s AS (SELECT l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem)
SELECT p_partkey, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, '') AS status FROM part LEFT JOIN s ON l_partkey = p_partkey AND r = 1""")
def sheet_first_status(t):
    """The status in the key's first row of another sheet, '' where there is none."""
    sheet = t("lineitem").select("l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return T.first_row_status(t("part").select("p_partkey"), "p_partkey", sheet, "l_partkey", "flag", "line").select("p_partkey", "status")


@query("""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), s AS (SELECT event_type, n * 1.0e0 / sum(n) OVER () AS share, CASE event_type WHEN 'click' THEN 0.2e0 WHEN 'view' THEN 0.0e0 WHEN 'error' THEN 0.05e0 END AS b FROM n)
SELECT event_type, CASE WHEN b IS NULL THEN 'n/a' ELSE printf('%.2f%%', b * 100) END AS background, CASE WHEN b IS NULL THEN 'n/a' WHEN b = 0 THEN 'unbounded' ELSE printf('%.2fx', share / b) END AS lift FROM s""")
def lift_texts(t):
    """Lift over a background as text, also where the background is 0 or unknown."""
    n = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("n")).scalar()
    kind = F.col("event_type")
    background, lift = matrix.lift_text(F.col("n") / total, F.when(kind == "click", 0.2).when(kind == "view", 0.0).when(kind == "error", 0.05))
    return n.select("event_type", background.alias("background"), lift.alias("lift"))


_TIERS = {"viirs": ["1-URGENT", "2-HIGH"], "modis": ["3-MEDIUM", "none of them"]}


@query(f"""WITH w AS (SELECT * FROM {catalog._WINS}), a AS (SELECT * FROM {catalog._AVAIL}), k(sensor, source) AS (VALUES {", ".join(f"('{s}', '{x}')" for s, xs in _TIERS.items() for x in xs)}),
m AS (SELECT win, s, e, sensor, source, f, CASE WHEN f IS NULL THEN 0 ELSE greatest(0, datediff('day', greatest(s, f), least(e, l)) + 1) END AS d FROM w CROSS JOIN k LEFT JOIN a USING (source)),
c AS (SELECT win, s, e, sensor, sum(coalesce(d, 0)) AS d, datediff('day', s, e) + 1 AS days FROM m GROUP BY ALL)
SELECT win, sensor, source || ' absent from the availability response' AS warning FROM m WHERE f IS NULL
UNION ALL SELECT win, sensor, CASE WHEN d = 0 THEN sensor || ' covers none of ' || s || ' to ' || e ELSE sensor || ' covers ' || d || ' of ' || days || ' days in ' || s || ' to ' || e END FROM c WHERE d < days""")
def coverage_warnings(t):
    """What a plan of windows does not cover, as text."""
    d = F.to_date("o_orderdate")
    w = t("orders").groupBy(F.col("o_custkey").alias("win")).agg(F.min(d).alias("start")).withColumn("end", F.date_add("start", 60))
    a = t("orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.min(d).alias("d")).select("source", F.date_add("d", 30).alias("first"), F.date_add("d", 400).alias("last"))
    return T.window_warnings(w, _TIERS, a)


@query(f"""WITH RECURSIVE p AS (SELECT ref_id AS id, rlon AS lon, rlat AS lat FROM {catalog.PARTS}), e AS (SELECT a.id AS a, b.id AS b, {catalog._distance("a.lon", "a.lat", "b.lon", "b.lat")} AS m FROM p a JOIN p b ON a.id <> b.id AND b.lon BETWEEN a.lon - 0.4e0 AND a.lon + 0.4e0 AND b.lat BETWEEN a.lat - 0.4e0 AND a.lat + 0.4e0),
g(r, k) AS (VALUES (15000, 2), (15000, 4), (30000, 2), (30000, 4)), core AS (SELECT r, k, a AS id FROM e JOIN g ON m <= r GROUP BY 1, 2, 3 HAVING count(*) + 1 >= max(k)), ce AS (SELECT x.r, x.k, e.a, e.b FROM e JOIN core x ON x.id = e.a AND m <= x.r JOIN core y ON y.id = e.b AND y.r = x.r AND y.k = x.k),
w AS (SELECT r, k, id AS v, id AS c FROM core UNION SELECT w.r, w.k, ce.b, w.c FROM w JOIN ce ON ce.a = w.v AND ce.r = w.r AND ce.k = w.k), own AS (SELECT r, k, v AS id, min(c) AS c FROM w GROUP BY 1, 2, 3),
border AS (SELECT own.r, own.k, e.a AS id, min(own.c) AS c FROM e JOIN own ON own.id = e.b AND m <= own.r GROUP BY 1, 2, 3), l AS (SELECT g.r, g.k, p.id, coalesce(own.c, border.c) AS c FROM g CROSS JOIN p LEFT JOIN own ON own.id = p.id AND own.r = g.r AND own.k = g.k LEFT JOIN border ON border.id = p.id AND border.r = g.r AND border.k = g.k)
SELECT CAST(r AS INTEGER) AS metres, CAST(k AS INTEGER) AS least, count(DISTINCT c) AS clusters, count(c) AS clustered, count(*) FILTER (WHERE c IS NULL) AS noise FROM l GROUP BY 1, 2""")
def density_sweep(t):
    """Density clusters at two radii and two least neighbourhoods."""
    s = catalog.sites(t)
    return cluster.density_sweep(s, lambda r: cluster.on_earth(r, 0.4 * r / 30000), [15000, 30000], [2, 4])
