"""All queries of the engine, each with the SQL that must give the same rows.

``query(name, sql)`` registers a function of (tables); tables reads a table of the data folder. The
SQL takes another way than the operator where there is one (self-joins for windows, theta joins for grid
bins, arithmetic for polygons), so the two check each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skygrid.functions import geo, scalars
from skygrid.operators import cluster, raster, sampling, spatial, stats, temporal, vectors
from skygrid.sources import tables as T

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f, name: str | None = None):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _QUERIES[name or f.__name__] = run
        if sql:
            _ORACLES[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, minus zero made zero, for comparison."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Derived inputs: events as points, parts and suppliers as reference points, nations as polygons with a hole.
POINTS = "(SELECT event_id AS id, ts, user_id, event_type, value, 68 + (event_id*7919 % 29500)/1000.0 AS lon, 6.5 + (event_id*104729 % 31000)/1000.0 AS lat FROM events)"
PARTS = "(SELECT p_partkey AS ref_id, 68 + (p_partkey*15013 % 29500)/1000.0 AS rlon, 6.5 + (p_partkey*30011 % 31000)/1000.0 AS rlat, 2020 + p_size % 6 AS start_year, CASE WHEN p_size % 3 = 0 THEN 2020 + p_size % 7 END AS retired_year FROM part)"
BOXES = "(SELECT n_nationkey AS poly_id, 68 + (n_nationkey % 5)*5.5 AS x0, 7 + (n_nationkey // 5)*6.0 AS y0 FROM nation)"
INSIDE = "lon >= x0 AND lon < x0 + 5 AND lat >= y0 AND lat < y0 + 5.5 AND NOT (lon >= x0 + 1 AND lon < x0 + 2 AND lat >= y0 + 1 AND lat < y0 + 2)"
DIST = "(SELECT sqrt(pow({n}, 2) + pow({e}, 2)))"


def _distance(a: str, b: str, c: str, d: str) -> str:
    s = f"(1 - 0.0066943799901413165e0 * pow(sin(radians(({b} + {d}) / 2)), 2))"
    north = f"(6378137.0e0 * (1 - 0.0066943799901413165e0) / ({s} * sqrt({s})) * radians({d} - {b}))"
    east = f"(6378137.0e0 / sqrt({s}) * cos(radians(({b} + {d}) / 2)) * radians({c} - {a}))"
    return f"sqrt(pow({north}, 2) + pow({east}, 2))"


def _haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371008.8e0 * asin(least(1.0e0, sqrt(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2)))))"


METRES = _distance("lon", "lat", "rlon", "rlat")


def points(t) -> DataFrame:
    e = F.col("event_id")
    return t("events").select(e.alias("id"), "ts", "user_id", "event_type", "value", (68 + (e * 7919 % 29500) / 1000.0).alias("lon"), (6.5 + (e * 104729 % 31000) / 1000.0).alias("lat"))


def parts(t) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    return t("part").select(k.alias("ref_id"), (68 + (k * 15013 % 29500) / 1000.0).alias("rlon"), (6.5 + (k * 30011 % 31000) / 1000.0).alias("rlat"), (2020 + z % 6).alias("start_year"), F.when(z % 3 == 0, 2020 + z % 7).alias("retired_year"))


def edges(t) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = 68 + (k % 5) * 5.5, 7 + F.floor(k / 5) * 6.0

    def ring(a, b, w, h, hole=False):
        corner = [(a, b), (a + w, b), (a + w, b + h), (a, b + h)]
        corner = corner[::-1] if hole else corner  # a hole runs the other way, so that its area is taken off
        return [F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")) for p, q in zip(corner, corner[1:] + corner[:1], strict=True)]

    all_edges = F.array(*ring(x, y, F.lit(5.0), F.lit(5.5)), *ring(x + 1, y + 1, F.lit(1.0), F.lit(1.0), True))
    return t("nation").select(k.cast("long").alias("poly_id"), F.explode(all_edges).alias("e")).select("poly_id", "e.*")


def areas(t) -> DataFrame:
    return edges(t).groupBy("poly_id").agg(F.abs(F.sum(geo.edge_area_km2(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))).alias("km2"))


def located(t) -> DataFrame:
    return spatial.inside(points(t), edges(t), 1.0)


def is_night() -> Column:
    return F.hour("ts").isin(0, 1, 2, 3, 4, 5, 18, 19, 20, 21, 22, 23)


NIGHT = "(hour(ts) < 6 OR hour(ts) >= 18)"
HOUR = "(hour(ts) + minute(ts) / 60.0e0)"


def hours() -> Column:
    return F.hour("ts") + F.minute("ts") / 60.0


# ---- history in time -------------------------------------------------------------------------------------


@query(f"""
WITH e AS (SELECT event_id, user_id, date_trunc('hour', ts) AS ts, value, {NIGHT} AS night FROM events),
r AS (SELECT a.event_id, count(b.event_id) AS prior_count, count(b.event_id) FILTER (WHERE b.ts >= a.ts - INTERVAL 2 DAY) AS prior_count_short,
  avg(CASE WHEN b.night THEN 1.0e0 WHEN NOT b.night THEN 0.0e0 END) AS night_fraction, CASE WHEN count(b.value) >= 2 THEN var_pop(b.value) END AS value_variance
  FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 7 DAY GROUP BY 1),
f AS (SELECT a.event_id, CASE WHEN count(b.event_id) >= 2 THEN (epoch_us(max(b.ts)) - epoch_us(min(b.ts))) / 86400000000.0e0 / (count(b.event_id) - 1) END AS mean_gap_days
  FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.ts < a.ts GROUP BY 1)
SELECT event_id, prior_count, prior_count_short, round(night_fraction, 6) AS night_fraction, round(value_variance, 4) AS value_variance, round(mean_gap_days, 6) AS mean_gap_days FROM r JOIN f USING (event_id)""")
def recurrence_features(t):
    e = t("events").select("event_id", "user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "value", is_night().alias("night"))
    out = temporal.recurrence(e, "user_id", F.col("ts"), F.col("value"), F.col("night"), 7, 2)
    return rounded(out.select("event_id", "prior_count", "prior_count_short", "night_fraction", "value_variance", "mean_gap_days")).withColumn("value_variance", F.round("value_variance", 4))


@query("""SELECT a.event_id, EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.ts >= a.ts - INTERVAL 9 DAY AND b.ts <= a.ts - INTERVAL 5 DAY) AS returned FROM events a""")
def returned_prior_period(t):
    return temporal.returned(t("events"), "user_id", F.col("ts"), 7, 2).select("event_id", "returned")


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), g AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS island FROM d),
r AS (SELECT user_id, island, min(d) AS "start", count(*) AS days FROM g GROUP BY 1, 2)
SELECT user_id, "start", days, CAST("start" - lag("start" + CAST(days AS INTEGER)) OVER (PARTITION BY user_id ORDER BY "start") AS BIGINT) AS quiet_before FROM r""")
def gaps_islands_runs(t):
    return temporal.active_runs(t("events"), "user_id", F.to_date("ts")).withColumn("quiet_before", F.col("quiet_before").cast("long"))


@query("""
WITH d AS (SELECT user_id, count(*) AS events, count(DISTINCT CAST(ts AS DATE)) AS active_days, datediff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS span_days FROM events GROUP BY 1)
SELECT user_id, events, active_days, span_days, round(active_days * 1.0e0 / span_days, 6) AS duty_cycle FROM d WHERE events >= 6 AND active_days >= 3""")
def duty_cycle(t):
    d = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct(F.to_date("ts")).alias("active_days"), (F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1).cast("long").alias("span_days"))
    return rounded(d.where("events >= 6 and active_days >= 3").withColumn("duty_cycle", F.col("active_days") / F.col("span_days")))


@query("""
WITH g AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts))) / 86400000000.0e0 AS gap FROM events),
s AS (SELECT event_type, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS sd, median(gap) AS md FROM g WHERE gap > 0 GROUP BY 1)
SELECT event_type, n, CASE WHEN n >= 2 THEN round((sd - m) / (sd + m), 6) END AS burstiness, CASE WHEN n > 2 AND m > 0 THEN round(sd / m, 6) END AS variation, CASE WHEN n >= 12 THEN round(md, 6) END AS median_gap FROM s""")
def burstiness_by_class(t):
    g = temporal.gaps(t("events"), ["event_type", "user_id"], F.col("ts"))
    s = g.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("gap_days").alias("m"), F.stddev_pop("gap_days").alias("sd"), F.median("gap_days").alias("md"))
    n, m, sd = F.col("n"), F.col("m"), F.col("sd")
    return rounded(s.select("event_type", "n", F.when(n >= 2, (sd - m) / (sd + m)).alias("burstiness"), F.when((n > 2) & (m > 0), sd / m).alias("variation"), F.when(n >= 12, F.col("md")).alias("median_gap")))


@query("""SELECT user_id, bool_or(ts < TIMESTAMP '2024-01-11') AS early, bool_or(ts >= TIMESTAMP '2024-01-21') AS late, bool_or(ts < TIMESTAMP '2024-01-11') AND bool_or(ts >= TIMESTAMP '2024-01-21') AS both_seasons FROM events GROUP BY 1""")
def active_both_seasons(t):
    early, late = F.bool_or(F.to_date("ts") < "2024-01-11"), F.bool_or(F.to_date("ts") >= "2024-01-21")
    return t("events").groupBy("user_id").agg(early.alias("early"), late.alias("late"), (early & late).alias("both_seasons"))


@query("""
WITH c AS (SELECT event_id AS id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS ref_id, ts AS rts FROM events WHERE event_type = 'purchase'),
j AS (SELECT id, ref_id, abs(epoch_us(ts) - epoch_us(rts)) AS gap, row_number() OVER (PARTITION BY id ORDER BY abs(epoch_us(ts) - epoch_us(rts)), rts, ref_id) AS r FROM c JOIN p ON rts BETWEEN ts - INTERVAL 15 MINUTE AND ts + INTERVAL 15 MINUTE)
SELECT c.id, j.ref_id, round(j.gap / 1000000.0e0, 6) AS gap_s FROM c LEFT JOIN j ON c.id = j.id AND j.r = 1""")
def asof_nearest_tolerance(t):
    kind = lambda k, *c: t("events").where(F.col("event_type") == k).select(*c)
    left, right = kind("click", F.col("event_id").alias("id"), F.col("ts").alias("at")), kind("purchase", F.col("event_id").alias("ref_id"), F.col("ts").alias("rat"))
    return rounded(temporal.asof_nearest(left, right, 900))


# ---- space -------------------------------------------------------------------------------------------------


@query(f"""
WITH j AS (SELECT id, ref_id, {METRES} AS m FROM {POINTS} JOIN {PARTS} ON rlon BETWEEN lon - 0.25e0 AND lon + 0.25e0 AND rlat BETWEEN lat - 0.25e0 AND lat + 0.25e0),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, ref_id) AS r FROM j)
SELECT p.id, b.ref_id, round(b.m, 3) AS metres FROM {POINTS} p LEFT JOIN b ON p.id = b.id AND b.r = 1""")
def nearest_ref_in_box(t):
    return rounded(spatial.nearest_in_box(points(t), parts(t), 0.25), 3)


@query(f"""
WITH j AS (SELECT id, ref_id, {METRES} AS m, (start_year IS NULL OR 2024 >= start_year) AND (retired_year IS NULL OR 2024 <= retired_year) AS v FROM {POINTS} JOIN {PARTS} ON rlon BETWEEN lon - 0.25e0 AND lon + 0.25e0 AND rlat BETWEEN lat - 0.25e0 AND lat + 0.25e0),
n AS (SELECT id, ref_id, m, row_number() OVER (PARTITION BY id ORDER BY m, ref_id) AS r FROM j), w AS (SELECT id, ref_id, m, row_number() OVER (PARTITION BY id ORDER BY m, ref_id) AS r FROM j WHERE v)
SELECT p.id, n.ref_id, round(n.m, 3) AS metres, w.ref_id AS valid_ref_id, round(w.m, 3) AS valid_metres FROM {POINTS} p LEFT JOIN n ON p.id = n.id AND n.r = 1 LEFT JOIN w ON p.id = w.id AND w.r = 1""")
def nearest_valid_ref(t):
    valid = scalars.operating(F.year("ts"), F.col("start_year"), F.col("retired_year"))
    return rounded(spatial.nearest_in_box(points(t).select("id", "lon", "lat", "ts"), parts(t), 0.25, valid), 3)


@query(f"""
SELECT ref_id AS id, {", ".join(f"count(*) FILTER (WHERE m <= {r}) AS n_{r}" for r in (1000, 5000, 10000, 20000))} FROM (SELECT s.ref_id, {_distance("s.rlon", "s.rlat", "q.rlon", "q.rlat")} AS m FROM {PARTS} s LEFT JOIN {PARTS} q ON q.rlon BETWEEN s.rlon - 0.25e0 AND s.rlon + 0.25e0 AND q.rlat BETWEEN s.rlat - 0.25e0 AND s.rlat + 0.25e0) GROUP BY 1""")
def radius_count_sweep(t):
    p = parts(t)
    own = p.select(F.col("ref_id").alias("id"), F.col("rlon").alias("lon"), F.col("rlat").alias("lat"))
    return spatial.radius_counts(own, p.select("ref_id", "rlon", "rlat"), [1000, 5000, 10000, 20000], 0.25)


@query(f"SELECT id, min(poly_id) AS poly_id, count(*) AS n_polygons FROM {POINTS}, {BOXES} WHERE {INSIDE} GROUP BY 1")
def point_in_polygon(t):
    return located(t).groupBy("id").agg(F.min("poly_id").alias("poly_id"), F.count(F.lit(1)).alias("n_polygons"))


@query(f"SELECT id, lon, lat FROM {POINTS} p WHERE NOT EXISTS (SELECT 1 FROM {BOXES} WHERE {INSIDE})")
def orphan_points(t):
    return points(t).select("id", "lon", "lat").join(located(t), "id", "left_anti")


@query(f"SELECT id, user_id FROM {POINTS} p WHERE EXISTS (SELECT 1 FROM {BOXES} WHERE {INSIDE})")
def points_inside_any(t):
    return points(t).select("id", "user_id").join(located(t), "id", "left_semi")


AREA = "(6378137.0e0 * 6378137.0e0 / 2 / 1e6 * radians({w}) * ({q2} - {q1}))"


def _q(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"((1 - 0.0066943799901413165e0) * ({s} / (1 - 0.0066943799901413165e0 * {s} * {s}) - 1 / (2 * 0.0818191908426215e0) * ln((1 - 0.0818191908426215e0 * {s}) / (1 + 0.0818191908426215e0 * {s}))))"


_BOX_AREA = AREA.format(w="5.0e0", q2=_q("y0 + 5.5"), q1=_q("y0"))
_HOLE_AREA = AREA.format(w="1.0e0", q2=_q("y0 + 2"), q1=_q("y0 + 1"))


@query(f"SELECT poly_id, round({_BOX_AREA} - {_HOLE_AREA}, 2) AS km2 FROM {BOXES}")
def area_km2(t):
    return areas(t).select("poly_id", F.round("km2", 2).alias("km2"))


@query(f"SELECT poly_id, count(id) AS n, round(1000.0e0 * count(id) / ({_BOX_AREA} - {_HOLE_AREA}), 3) AS per_1000_km2 FROM {BOXES} LEFT JOIN {POINTS} ON {INSIDE} GROUP BY poly_id, y0")
def region_density(t):
    n = located(t).groupBy("poly_id").agg(F.count("id").alias("n"))
    out = areas(t).join(n, "poly_id", "left").select("poly_id", F.nvl("n", F.lit(0)).alias("n"), F.col("km2").alias("a"))
    return out.select("poly_id", "n", F.round(1000.0 * F.col("n") / F.nullif("a", F.lit(0.0)), 3).alias("per_1000_km2"))


@query(f"""
WITH d AS (SELECT id, poly_id, poly_id % 3 AS grp, 111195.0797e0 * sqrt(pow(greatest(x0 - lon, lon - x0 - 5, 0) * cos(radians(lat)), 2) + pow(greatest(y0 - lat, lat - y0 - 5.5, 0), 2)) AS m FROM {POINTS}, {BOXES} WHERE lon BETWEEN x0 - 0.5 AND x0 + 5.5 AND lat BETWEEN y0 - 0.5 AND y0 + 6),
own AS (SELECT id, min(poly_id) % 3 AS grp FROM {POINTS}, {BOXES} WHERE lon >= x0 AND lon < x0 + 5 AND lat >= y0 AND lat < y0 + 5.5 GROUP BY 1)
SELECT own.id, {", ".join(f"coalesce(bool_or(own.grp <> {g} AND d.grp = {g} AND d.m <= 20000), false) AS near_{g}" for g in range(3))} FROM own LEFT JOIN d ON own.id = d.id GROUP BY 1""")
def buffer_flags(t):
    """Whether a point lies within 20 km of a polygon of each group other than its own."""
    outer = edges(t).where("not (abs(x1 - x2) = 1.0 or abs(y1 - y2) = 1.0)")
    own = spatial.inside(points(t), outer, 1.0).groupBy("id").agg((F.min("poly_id") % 3).alias("grp"))
    # an edge is met by the one-degree bins within half a degree of it
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    bins = outer.withColumn("_bx", F.explode(F.sequence(F.floor(low - 0.5), F.floor(high + 0.5)))).withColumn("_by", F.explode(F.sequence(F.floor(F.least("y1", "y2") - 0.5), F.floor(F.greatest("y1", "y2") + 0.5))))
    near = points(t).join(own, "id").withColumn("_bx", F.floor("lon")).withColumn("_by", F.floor("lat")).join(bins, ["_bx", "_by"])
    m = spatial.segment_m(*(F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")))
    flags = near.withColumn("m", m).groupBy("id").agg(*(F.bool_or((F.col("grp") != g) & (F.col("poly_id") % 3 == g) & (F.col("m") <= 20000)).alias(f"near_{g}") for g in range(3)))
    return own.select("id").join(flags, "id", "left").select("id", *(F.nvl(f"near_{g}", F.lit(False)).alias(f"near_{g}") for g in range(3)))


@query(f"""
WITH a AS (SELECT id, CAST(ts AS DATE) AS day, lon, lat FROM {POINTS} WHERE event_type = 'click'), b AS (SELECT CAST(ts AS DATE) AS day, lon AS rlon, lat AS rlat FROM {POINTS} WHERE event_type = 'view'),
m AS (SELECT a.id, min({_haversine("lon", "lat", "rlon", "rlat")}) AS m FROM a JOIN b USING (day) GROUP BY 1)
SELECT r AS radius, count(*) FILTER (WHERE m <= r) AS matched, count(*) AS covered FROM m, (VALUES (5000), (10000), (20000), (40000)) v(r) GROUP BY 1""")
def space_time_match_curve(t):
    p = points(t).withColumn("day", F.to_date("ts"))
    return spatial.matched_share(p.where("event_type = 'click'").select("id", "day", "lon", "lat"), p.where("event_type = 'view'").select("id", "day", "lon", "lat"), "day", [5000, 10000, 20000, 40000])


SUN_HOUR = "(hour(ts) + minute(ts) / 60.0e0 + CAST(floor(second(ts)) AS BIGINT) / 3600.0e0)"
_G = f"(2 * pi() / 365 * (dayofyear(ts) - 1 + ({SUN_HOUR} - 12) / 24.0e0))"
_DECL = "(0.006918e0 - 0.399912e0*cos(g) + 0.070257e0*sin(g) - 0.006758e0*cos(2*g) + 0.000907e0*sin(2*g) - 0.002697e0*cos(3*g) + 0.00148e0*sin(3*g))"
_EQT = "(229.18e0 * (0.000075e0 + 0.001868e0*cos(g) - 0.032077e0*sin(g) - 0.014615e0*cos(2*g) - 0.040849e0*sin(2*g)))"


@query(f"""SELECT id, round(degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin({_DECL}) + cos(radians(lat)) * cos({_DECL}) * cos(radians(({SUN_HOUR} * 60 + {_EQT} + 4 * lon) / 4 - 180)))))), 4) AS zenith FROM (SELECT *, {_G} AS g FROM {POINTS})""")
def solar_zenith(t):
    return points(t).select("id", F.round(geo.solar_zenith_deg(F.dayofyear("ts"), F.hour("ts") + F.minute("ts") / 60.0 + F.second("ts") / 3600.0, F.col("lon"), F.col("lat")), 4).alias("zenith"))


@query(f"""SELECT id, round(6378137.0e0 * radians(lon - 82.5), 3) AS x, round(6378137.0e0 * (ln(tan(radians(lat) / 2 + pi() / 4)) + 0.0818191908426215e0 / 2 * ln((1 - 0.0818191908426215e0 * sin(radians(lat))) / (1 + 0.0818191908426215e0 * sin(radians(lat))))), 3) AS y, round(lon, 6) AS lon_again, round(lat, 6) AS lat_again FROM {POINTS}""")
def mercator_round_trip(t):
    p = points(t)
    x, y = geo.mercator(F.col("lon"), F.col("lat"), 82.5)
    lon, lat = geo.mercator_inverse(F.col("x"), F.col("y"), 82.5)
    return p.select("id", x.alias("x"), y.alias("y")).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon_again"), F.round(lat, 6).alias("lat_again"))


@query(f"""SELECT CAST(floor(lon / 0.005e0) AS BIGINT) AS cell_x, CAST(floor(lat / 0.005e0) AS BIGINT) AS cell_y, concat('N', CAST(floor(lat / 3) * 3 AS INTEGER), 'E', CAST(floor(lon / 3) * 3 AS INTEGER)) AS tile, count(*) AS n FROM {POINTS} GROUP BY 1, 2, 3""")
def cell_and_tile_keys(t):
    tile = F.concat(F.lit("N"), (F.floor(F.col("lat") / 3) * 3).cast("string"), F.lit("E"), (F.floor(F.col("lon") / 3) * 3).cast("string"))
    return points(t).groupBy(geo.cell(F.col("lon"), 0.005).alias("cell_x"), geo.cell(F.col("lat"), 0.005).alias("cell_y"), tile.alias("tile")).agg(F.count(F.lit(1)).alias("n"))


# tenths of a kelvin as whole numbers, so that every comparison is exact
_GRID = """px AS (SELECT l_linenumber AS granule, CAST(l_orderkey // 40 AS BIGINT) AS "row", CAST(l_orderkey % 40 AS BIGINT) AS "col", 2800 + (l_orderkey * 7919 + l_linenumber * 31) % 400 AS mir, 2800 + (l_orderkey * 104729 + l_linenumber * 17) % 300 AS tir1 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"""


def pixels(t) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    own = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    return own.select(n.alias("granule"), F.floor(k / 40).alias("row"), (k % 40).alias("col"), (2800 + (k * 7919 + n * 31) % 400).alias("mir"), (2800 + (k * 104729 + n * 17) % 300).alias("tir1"))


def _bg(name: str, expr: str) -> str:
    return f"""m_{name} AS (SELECT granule, "row", "col", median({expr}) AS bg FROM near GROUP BY ALL), b_{name} AS (SELECT granule, "row", "col", bg, median(abs({expr} - bg)) AS mad FROM near JOIN m_{name} USING (granule, "row", "col") GROUP BY ALL)"""


_DETECTED = f"""
WITH {_GRID}, ext AS (SELECT granule, max("row") AS rows, max("col") AS cols FROM px GROUP BY 1),
cand AS (SELECT px.granule, px."row", px."col", greatest(0, least(rows, px."row" + a.i)) AS r, greatest(0, least(cols, px."col" + b.i)) AS c FROM px JOIN ext USING (granule), range(-5, 6) a(i), range(-5, 6) b(i) WHERE mir > 3000),
near AS (SELECT c.granule, c."row", c."col", p.mir AS m, p.tir1 AS t FROM cand c JOIN px p ON p.granule = c.granule AND p."row" = c.r AND p."col" = c.c),
{_bg("mir", "m")}, {_bg("diff", "(m - t)")}, {_bg("tir", "t")}
SELECT px.granule, px."row", px."col", round(px.mir / 10, 6) AS mir, round(b_mir.bg / 10, 6) AS bg_mir, round(b_diff.bg / 10, 6) AS bg_diff, round(b_tir.bg / 10, 6) AS bg_tir1 FROM px JOIN b_mir USING (granule, "row", "col") JOIN b_diff USING (granule, "row", "col") JOIN b_tir USING (granule, "row", "col")
WHERE mir > 3000 AND mir > b_mir.bg + greatest(40, 3 * b_mir.mad) AND mir - tir1 > b_diff.bg + greatest(40, 3 * b_diff.mad) AND tir1 - b_tir.bg >= -10"""


@query(_DETECTED)
def contextual_detector(t):
    out = raster.detect(pixels(t), floor=3000, margin=40.0, spread=3.0, deficit=-10.0, radius=5)
    return rounded(out.select("granule", "row", "col", *((F.col(c) / 10).alias(c) for c in ("mir", "bg_mir", "bg_diff", "bg_tir1"))))


query(_DETECTED)(lambda t: contextual_detector(t), "contextual_detector_whole")  # the name of the same query in the round before


# ---- labels, bands, features ----------------------------------------------------------------------------------

_NEAR = f"""near AS (SELECT id, event_type, min(CASE WHEN ref_id % 5 = 0 THEN m END) AS flare_m, min(CASE WHEN ref_id % 5 = 1 THEN m END) AS industrial_m, min(CASE WHEN ref_id % 5 = 2 THEN m END) AS asset_m FROM (SELECT p.id, event_type, ref_id, {METRES} AS m FROM {POINTS} p LEFT JOIN {PARTS} r ON rlon BETWEEN lon - 0.25e0 AND lon + 0.25e0 AND rlat BETWEEN lat - 0.25e0 AND lat + 0.25e0) GROUP BY 1, 2),
labelled AS (SELECT id, event_type, flare_m, industrial_m, CASE WHEN flare_m <= 8000 THEN 'flare' WHEN industrial_m <= 12000 OR asset_m <= 12000 THEN 'industrial' WHEN event_type = 'click' THEN 'agricultural' ELSE 'unlabelled' END AS label FROM near)"""


def kinds_m(t, names: list[str]) -> DataFrame:
    """(id, names): metres to the nearest reference of each of three kinds; null: none in the box."""
    kind = F.when(F.col("ref_id") % 5 < 3, F.col("ref_id") % 5)
    found = spatial.nearest_of_kinds(points(t), parts(t).withColumn("kind", kind), 0.25, "kind")
    return found.groupBy("id").agg(*(F.min(F.when(F.col("kind") == k, F.col("metres"))).alias(c) for k, c in enumerate(names)))


def labelled(t) -> DataFrame:
    m = kinds_m(t, ["flare_m", "industrial_m", "asset_m"])
    cover = F.when(F.col("event_type") == "click", "cropland")
    return points(t).select("id", "event_type").join(m.hint("merge"), "id", "left").withColumn("label", scalars.weak_label(F.col("flare_m"), F.col("industrial_m"), F.col("asset_m"), cover, 8000, 12000))


@query(f"WITH {_NEAR} SELECT id, label FROM labelled")
def weak_label_case(t):
    return labelled(t).select("id", "label")


@query(f"WITH {_NEAR} SELECT label, count(*) AS n, round(count(*) * 1.0e0 / sum(count(*)) OVER (), 6) AS share, label <> 'unlabelled' AND count(*) * 1.0e0 / sum(count(*)) OVER () > 0.6 AS over_ceiling, count(*) < 300 AS under_floor FROM labelled GROUP BY 1")
def weak_label_shares(t):
    n = labelled(t).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    return rounded(n.withColumn("over_ceiling", (F.col("label") != "unlabelled") & (F.col("share") > 0.6)).withColumn("under_floor", F.col("n") < 300))


@query(f"""WITH {_NEAR}, s AS (SELECT event_type, label, count(*) AS n FROM labelled GROUP BY 1, 2), x AS (SELECT event_type, label, n * 1.0e0 / sum(n) OVER (PARTITION BY event_type) AS share, sum(n) OVER (PARTITION BY label) * 1.0e0 / sum(n) OVER () AS background FROM s)
SELECT event_type, label, round(share, 6) AS share, round(background, 6) AS background, round(share / nullif(background, 0), 6) AS lift FROM x""")
def label_lift(t):
    s = labelled(t).groupBy("event_type", "label").agg(F.count(F.lit(1)).alias("n"))
    total = lambda *k: F.sum("n").over(Window.partitionBy(*(k or (F.lit(1),))))
    x = s.select("event_type", "label", (F.col("n") / total("event_type")).alias("share"), (total("label") / total()).alias("background"))
    return rounded(x.withColumn("lift", scalars.safe_ratio(F.col("share"), F.col("background"))))


@query(f"""WITH {_NEAR} SELECT CASE WHEN flare_m < 1000 THEN 'under 1 km' WHEN flare_m < 5000 THEN '1 to 5 km' WHEN flare_m IS NULL THEN 'none in reach' ELSE '5 km or more' END AS dataset_band, CASE WHEN round_even(industrial_m, 0) < 1000 THEN '<1 km' WHEN round_even(industrial_m, 0) < 5000 THEN '1-5 km' WHEN round_even(industrial_m, 0) < 20000 THEN '5-20 km' WHEN industrial_m IS NOT NULL THEN '>=20 km' END AS console_band, count(*) AS n FROM labelled GROUP BY 1, 2""")
def distance_bands(t):
    return labelled(t).groupBy(scalars.dataset_band(F.col("flare_m")).alias("dataset_band"), scalars.console_band(F.col("industrial_m")).alias("console_band")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderdate BETWEEN DATE '1995-11-01' AND DATE '1995-11-30' THEN 'window_1' WHEN o_orderdate BETWEEN DATE '1996-05-01' AND DATE '1996-05-31' THEN 'window_2' END AS win, NOT (o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') AS in_population, count(*) AS n, count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM (SELECT CAST(o_orderdate AS DATE) AS o_orderdate FROM orders) GROUP BY 1, 2""")
def windows_and_population(t):
    d = F.to_date("o_orderdate")
    win = F.when(d.between("1995-11-01", "1995-11-30"), "window_1").when(d.between("1996-05-01", "1996-05-31"), "window_2")
    return t("orders").groupBy(win.alias("win"), (~d.between("1997-01-01", "1997-12-31")).alias("in_population")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.trunc(d, "month")).alias("months"))


@query("""SELECT n_nationkey, CASE WHEN n_name IN ('FRANCE', 'GERMANY') THEN 'group_a' WHEN n_name IN ('INDIA', 'CHINA') THEN 'group_b' WHEN n_name IS NULL THEN NULL ELSE 'train' END AS split_group, CASE WHEN n_nationkey BETWEEN 0 AND 4 THEN 'first' WHEN n_nationkey BETWEEN 3 AND 12 THEN 'second' END AS extent FROM nation""")
def split_groups(t):
    n, k = F.col("n_name"), F.col("n_nationkey")
    group = F.when(n.isin("FRANCE", "GERMANY"), "group_a").when(n.isin("INDIA", "CHINA"), "group_b").when(n.isNotNull(), "train")
    return t("nation").select("n_nationkey", group.alias("split_group"), F.when(k.between(0, 4), "first").when(k.between(3, 12), "second").alias("extent"))


@query("""SELECT l_orderkey, l_linenumber, c_mktsegment, coalesce(nullif(p_brand, 'Brand#11'), p_type) AS brand, round(l_extendedprice / nullif(l_quantity, 0), 6) AS unit_price, round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS month_sin, round(cos(2 * pi() * dayofyear(o_orderdate) / 366), 6) AS day_cos, CASE l_returnflag WHEN 'R' THEN l_discount ELSE l_tax END AS picked
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey WHERE l_quantity IS NOT NULL""")
def feature_matrix(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left").where("l_quantity is not null")
    month, day = scalars.cyclic(F.month("o_orderdate"), 12)[0], scalars.cyclic(F.dayofyear("o_orderdate"), 366)[1]
    return j.select("l_orderkey", "l_linenumber", "c_mktsegment", F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), "p_type").alias("brand"), F.round(scalars.safe_ratio(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("unit_price"), F.round(month, 6).alias("month_sin"), F.round(day, 6).alias("day_cos"), F.when(F.col("l_returnflag") == "R", F.col("l_discount")).otherwise(F.col("l_tax")).alias("picked"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND CAST(ts AS DATE) <> DATE '2024-01-05' AND (value IS NULL OR value > 20) AND user_id NOT IN (1, 2, 3) GROUP BY 1 HAVING count(*) >= 25""")
def console_filter(t):
    kept = t("events").where(F.col("event_type").isin("click", "view") & (F.to_date("ts") != "2024-01-05") & (F.col("value").isNull() | (F.col("value") > 20)) & ~F.col("user_id").isin(1, 2, 3))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).where("n >= 25")


_RAW = "(SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' Operating - inferred 4y ' WHEN 1 THEN 'RETIRED' WHEN 2 THEN '' WHEN 3 THEN 'mothballed' END AS st, CASE event_id % 4 WHEN 0 THEN CAST(1700 + event_id % 500 AS VARCHAR) WHEN 1 THEN '1999.0' WHEN 2 THEN 'unknown' END AS yr, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 120 AS VARCHAR) WHEN 1 THEN 'h' ELSE 'l' END AS conf FROM events)"


@query(f"""SELECT CASE WHEN trim(regexp_replace(lower(trim(st)), ' - inferred.*$', '')) = '' THEN 'blank' ELSE trim(regexp_replace(lower(trim(st)), ' - inferred.*$', '')) END AS status, CASE WHEN CAST(try_cast(yr AS DOUBLE) AS INTEGER) BETWEEN 1800 AND 2100 THEN CAST(try_cast(yr AS DOUBLE) AS INTEGER) END AS start_year,
CASE WHEN try_cast(conf AS INTEGER) BETWEEN 0 AND 29 OR conf = 'l' THEN 'low' WHEN try_cast(conf AS INTEGER) BETWEEN 30 AND 79 THEN 'nominal' WHEN try_cast(conf AS INTEGER) BETWEEN 80 AND 100 OR conf = 'h' THEN 'high' END AS confidence, count(*) AS n FROM {_RAW} GROUP BY 1, 2, 3""")
def status_year_confidence(t):
    e = F.col("event_id")
    st = F.when(e % 5 == 0, " Operating - inferred 4y ").when(e % 5 == 1, "RETIRED").when(e % 5 == 2, "").when(e % 5 == 3, "mothballed")
    yr = F.when(e % 4 == 0, (1700 + e % 500).cast("string")).when(e % 4 == 1, "1999.0").when(e % 4 == 2, "unknown")
    conf = F.when(e % 3 == 0, (e % 120).cast("string")).when(e % 3 == 1, "h").otherwise("l")
    return t("events").groupBy(scalars.status(st).alias("status"), scalars.year(yr).alias("start_year"), scalars.confidence_band(conf).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN hm BETWEEN 0 AND 2359 AND hm % 100 < 60 THEN CAST(d AS TIMESTAMP) + to_minutes(hm // 100 * 60 + hm % 100) END AS utc, CASE WHEN hm BETWEEN 0 AND 2359 AND hm % 100 < 60 THEN CAST(d AS TIMESTAMP) + to_minutes(hm // 100 * 60 + hm % 100 + 330) END AS local FROM (SELECT event_id, CAST(ts AS DATE) AS d, CAST(event_id * 37 % 2500 AS INTEGER) AS hm FROM events)""")
def acquisition_times(t):
    utc = scalars.acquisition_instant(F.to_date("ts"), (F.col("event_id") * 37 % 2500).cast("string"))
    return t("events").select("event_id", utc.cast("timestamp_ntz").alias("utc"), scalars.local_clock(utc).alias("local"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 10 + event_id % 20 + 0.5e0 WHEN 1 THEN 12.25e0 END AS lat, CASE event_id % 3 WHEN 0 THEN 70.0e0 WHEN 1 THEN 77.5e0 END AS lon FROM events""")
def coordinate_parse(t):
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, F.concat((10 + e % 20).cast("string"), F.lit(".5, 70"))).when(e % 3 == 1, "12.25,77.5; 1,2").otherwise("95, 10")
    pair = scalars.coordinate_pair(raw)
    return t("events").select("event_id", pair[0].alias("lat"), pair[1].alias("lon"))


# ---- profiles and statistics ------------------------------------------------------------------------------------


@query("""SELECT CAST(h.hour AS INTEGER) AS hour, count(event_id) AS n FROM range(24) h(hour) LEFT JOIN (SELECT event_id, hour(ts) AS hour FROM events WHERE event_type = 'click' AND hour(ts) <> 3) e ON h.hour = e.hour GROUP BY 1""")
def hourly_profile(t):
    e = t("events").where("event_type = 'click'").select(F.hour("ts").alias("hour")).where("hour <> 3").groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    return e.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(e, "hour", "left").select("hour", F.nvl("n", F.lit(0)).alias("n"))


@query("""WITH c AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT hour(ts) AS h, count(DISTINCT CAST(ts AS DATE)) AS g FROM events GROUP BY 1), r AS (SELECT event_type, c.h, n, n * 1.0e0 / g AS rate FROM c JOIN d ON c.h = d.h)
SELECT event_type, sum(n) AS n, round(sum(rate) FILTER (WHERE h BETWEEN 15 AND 20) / sum(rate), 6) AS evening_share, CAST(split_part(max(lpad(CAST(CAST(round(rate * 1000000) AS BIGINT) AS VARCHAR), 16, '0') || ':' || CAST(99 - h AS VARCHAR)), ':', 2) AS INTEGER) AS peak FROM r GROUP BY 1""")
def normalised_rate(t):
    c = t("events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    d = t("events").groupBy(F.hour("ts").alias("h")).agg(F.countDistinct(F.to_date("ts")).alias("g"))
    r = c.join(d, "h").withColumn("rate", F.col("n") / F.col("g"))
    peak = F.max_by(99 - F.col("h"), F.struct(F.round(F.col("rate") * 1000000).cast("long"), 99 - F.col("h")))
    return rounded(r.groupBy("event_type").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("h").between(15, 20), F.col("rate"))) / F.sum("rate")).alias("evening_share"), peak.cast("int").alias("peak")))


@query("""SELECT hour(ts) AS hour, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS after FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16'), count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') FROM events""")
def before_after(t):
    early = F.to_date("ts") < "2024-01-16"
    return t("events").withColumn("hour", F.hour("ts")).rollup("hour").agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after"))


@query(f"""WITH s AS (SELECT event_type, count(*) AS n, sum(sin(2*pi()*{HOUR}/24)) AS s, sum(cos(2*pi()*{HOUR}/24)) AS c, sum(sin(4*pi()*{HOUR}/24)) AS s2, sum(cos(4*pi()*{HOUR}/24)) AS c2 FROM events GROUP BY 1)
SELECT event_type, n, round(CASE WHEN atan2(s, c) < 0 THEN degrees(atan2(s, c)) / 15 + 24 ELSE degrees(atan2(s, c)) / 15 END, 6) AS mean_hour, round(sqrt(s*s + c*c) / n, 6) AS resultant, round(sqrt(s2*s2 + c2*c2) / n, 6) AS axial FROM s""")
def circular_stats(t):
    return rounded(stats.circular(t("events"), "event_type", hours()))


@query(f"""WITH h AS (SELECT DISTINCT user_id, {HOUR} AS h FROM events), g AS (SELECT user_id, h, coalesce(lead(h) OVER (PARTITION BY user_id ORDER BY h), min(h) OVER (PARTITION BY user_id) + 24) - h AS gap FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, h) AS r FROM g)
SELECT user_id, round(gap, 6) AS gap FROM r WHERE r = 1""")
def ring_gap(t):
    return rounded(stats.widest_gap(t("events"), "user_id", hours())).select("user_id", "gap")


@query(f"""SELECT event_type, count(*) FILTER (WHERE least(abs({HOUR} - 13.5), 24 - abs({HOUR} - 13.5)) <= 1.0) AS within, round(avg(least(abs({HOUR} - 13.5), 24 - abs({HOUR} - 13.5))), 6) AS mean_distance, round(stddev_pop({HOUR}), 6) AS spread FROM events GROUP BY 1""")
def ring_tolerance(t):
    d = stats.ring_distance(hours(), F.lit(13.5))
    return rounded(t("events").groupBy("event_type").agg(F.count_if(d <= 1.0).alias("within"), F.avg(d).alias("mean_distance"), F.stddev_pop(hours()).alias("spread")))


@query(f"""SELECT id, round(mod({HOUR} + (lon - 82.5e0) / 15 + 48, 24), 6) AS local_hour FROM {POINTS}""")
def local_solar_time(t):
    return rounded(points(t).select("id", geo.local_solar_hour(hours(), F.col("lon")).alias("local_hour")))


@query("""WITH c AS (SELECT event_type AS a, hour(ts) AS b, count(*) AS o FROM events GROUP BY 1, 2), g AS (SELECT x.a, y.b, coalesce(o, 0) AS o, r, k, n FROM (SELECT a, sum(o) AS r FROM c GROUP BY 1) x, (SELECT b, sum(o) AS k FROM c GROUP BY 1) y, (SELECT sum(o) AS n FROM c) z LEFT JOIN c ON c.a = x.a AND c.b = y.b)
SELECT CAST(max(n) AS BIGINT) AS n, round(sum(pow(o - r * k * 1.0e0 / n, 2) / (r * k * 1.0e0 / n)), 6) AS chi2, round(sqrt(sum(pow(o - r * k * 1.0e0 / n, 2) / (r * k * 1.0e0 / n)) / max(n) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS v FROM g""")
def cramers_v(t):
    return rounded(stats.cramers_v(t("events").withColumn("hour", F.hour("ts")), "event_type", "hour"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(quantile_cont(value, 0.9), 6) AS linear, round(max(value) FILTER (WHERE r = ceil(0.9e0 * (n - 1))), 6) AS higher, round(max(value) FILTER (WHERE r = n // 2), 6) AS upper_median, round(median(value), 6) AS middle FROM r GROUP BY 1""")
def quantile_rules(t):
    q = stats.quantiles(t("events"), "event_type", "value", {"linear": lambda n: 0.9 * (n - 1), "higher": lambda n: F.ceil(0.9 * (n - 1)), "upper_median": lambda n: F.floor(n / 2), "middle": lambda n: (n - 1) / 2})
    return rounded(q)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) SELECT user_id, event_type, votes FROM c WHERE r = 1""")
def majority_label(t):
    return stats.vote(t("events"), "user_id", "event_type")


@query("""WITH p AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY n DESC, k) AS i, sum(n) OVER (ORDER BY n DESC, k ROWS UNBOUNDED PRECEDING) * 1.0e0 / sum(n) OVER () AS s FROM p)
SELECT x AS share, CAST(min(i) AS INTEGER) AS keys FROM r, (VALUES (0.8e0), (0.95e0)) v(x) WHERE s >= x - 1e-12 GROUP BY 1""")
def greedy_coverage(t):
    return stats.greedy_coverage(t("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")), "l_partkey", "n", [0.8, 0.95])


_JUDGED = "(SELECT l.doc_id, l.quality AS truth, CASE WHEN d.n_chars >= 600 THEN 1 ELSE 0 END AS guess, d.n_chars AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL)"


def judged(t) -> DataFrame:
    d = t("documents").select("doc_id", "n_chars")
    return t("labels").where("quality is not null").join(d, "doc_id").select("doc_id", F.col("quality").alias("truth"), F.when(F.col("n_chars") >= 600, 1).otherwise(0).alias("guess"), F.col("n_chars").alias("s"))


@query(f"""WITH k AS (SELECT label, count(*) FILTER (WHERE truth = label AND guess = label) AS tp, count(*) FILTER (WHERE truth = label) AS support, count(*) FILTER (WHERE guess = label) AS guessed FROM {_JUDGED}, (VALUES (0), (1)) v(label) GROUP BY 1)
SELECT CAST(label AS INTEGER) AS label, support, CASE WHEN guessed > 0 THEN round(tp * 1.0e0 / guessed, 6) ELSE 0 END AS "precision", CASE WHEN support > 0 THEN round(tp * 1.0e0 / support, 6) ELSE 0 END AS recall, CASE WHEN support + guessed > 0 THEN round(2.0e0 * tp / (support + guessed), 6) ELSE 0 END AS f1 FROM k""")
def confusion_report(t):
    return rounded(stats.classification(judged(t), "truth", "guess")).withColumn("label", F.col("label").cast("int"))


@query(f"""WITH b AS (SELECT s, count(*) FILTER (WHERE truth = 1) AS p, count(*) AS n FROM {_JUDGED} GROUP BY 1), r AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS k FROM b) SELECT round(sum(p * tp * 1.0e0 / k) / nullif(sum(p), 0), 6) AS average_precision FROM r""")
def average_precision(t):
    return rounded(stats.average_precision(judged(t), F.col("truth") == 1, F.col("s")))


@query("""WITH s AS (SELECT event_id, abs(value - 100) / 100 AS a, (event_id % 5 = 0) AS cal FROM events), k AS (SELECT count(*) AS n, least(1.0e0, ceil((count(*) + 1) * 0.9e0) / count(*)) AS level FROM s WHERE cal), o AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS r, level * (n - 1) AS p, n, level FROM s, k WHERE cal),
c AS (SELECT n, level, sum(CASE WHEN r = floor(p) THEN a * (1 - (p - floor(p))) WHEN r = floor(p) + 1 THEN a * (p - floor(p)) ELSE 0 END) AS threshold FROM o GROUP BY 1, 2)
SELECT c.n, round(threshold, 6) AS threshold, round(c.level, 6) AS level, round(avg(CASE WHEN a <= threshold THEN 1.0e0 ELSE 0 END), 6) AS coverage FROM s, c WHERE NOT cal GROUP BY c.n, threshold, c.level""")
def conformal_threshold(t):
    s = t("events").select("event_id", (F.abs(F.col("value") - 100) / 100).alias("a"))
    return rounded(stats.conformal(s, F.col("event_id") % 5 == 0, "a", 0.1))


@query()
def permutation_null(t):
    """Chance level of the association from 300 shuffles; another engine's draws cannot be equal."""
    return rounded(stats.permutation_null(t("events").withColumn("hour", F.hour("ts")), "event_type", "hour", 300))


# ---- samples, sets, planning ---------------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 500")
def hash_sample(t):
    return sampling.hash_sample(t("events"), "event_id", 500).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('s' || CAST(event_id AS VARCHAR)), event_id) AS r FROM events) WHERE r <= 40")
def stratified_sample(t):
    return sampling.stratified(t("events"), "event_id", "event_type", 40, "s").select("event_id", "event_type")


@query("""WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), top AS (SELECT o_orderstatus AS l, n FROM n ORDER BY n DESC, o_orderstatus LIMIT 1), r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders)
SELECT o_orderkey, o_orderstatus FROM r, top WHERE o_orderstatus <> l OR r <= floor(0.2e0 / 0.8e0 * ((SELECT count(*) FROM orders) - top.n) + 1e-9)""")
def majority_cap(t):
    return sampling.majority_cap(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.2).select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, CAST(CAST('0x' || substr(md5('f' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS BIGINT) AS fold FROM events")
def hash_folds(t):
    return t("events").select("event_id", sampling.bucket(F.col("event_id"), "f", 5).alias("fold"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM a FULL JOIN b ON a.k = b.k""")
def set_alignment(t):
    side = lambda s, f: t("orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct().withColumn(f, F.lit(True))
    return side("F", "l").join(side("O", "r"), "k", "full_outer").select("k", F.col("l").isNotNull().alias("in_left"), F.col("r").isNotNull().alias("in_right"))


@query("""SELECT k, 'both' AS part FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT k, 'only' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def set_operations(t):
    side = lambda s: t("orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return side("F").intersect(side("O")).withColumn("part", F.lit("both")).unionByName(side("F").subtract(side("O")).withColumn("part", F.lit("only")))


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY event_id % 700 ORDER BY event_id) AS r FROM events) SELECT event_id % 700 AS k, event_id AS arrival, value FROM b WHERE r = 1 AND event_id % 700 NOT IN (SELECT event_id % 700 FROM events WHERE event_id % 700 < 200)""")
def idempotent_insert(t):
    batch = t("events").select((F.col("event_id") % 700).alias("k"), F.col("event_id").alias("arrival"), "value")
    return T.keyed_insert(batch.where("k < 200").select("k").distinct(), batch, "k", "arrival")


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def schema_union(t):
    s = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return T.both_families(s, c)


@query("""SELECT c AS win, CAST(s AS DATE) AS chunk_start, CAST(least(s + INTERVAL 4 DAY, e) AS DATE) AS chunk_end FROM (SELECT o_custkey AS c, min(CAST(o_orderdate AS DATE)) AS a, CAST(min(CAST(o_orderdate AS DATE)) + INTERVAL 17 DAY AS DATE) AS e FROM orders GROUP BY 1), LATERAL (SELECT unnest(generate_series(a, e, INTERVAL 5 DAY)) AS s)""")
def date_chunks(t):
    w = t("orders").groupBy(F.col("o_custkey").alias("win")).agg(F.min(F.to_date("o_orderdate")).alias("a")).withColumn("e", F.date_add("a", 17))
    return T.date_chunks(w, "a", "e", 5).select("win", "chunk_start", "chunk_end")


_WINS = "(SELECT o_custkey AS win, min(CAST(o_orderdate AS DATE)) AS s, CAST(min(CAST(o_orderdate AS DATE)) + INTERVAL 60 DAY AS DATE) AS e FROM orders GROUP BY 1)"
_AVAIL = "(SELECT o_orderpriority AS source, CAST(min(CAST(o_orderdate AS DATE)) + INTERVAL 30 DAY AS DATE) AS f, CAST(min(CAST(o_orderdate AS DATE)) + INTERVAL 400 DAY AS DATE) AS l FROM orders GROUP BY 1)"


@query(f"""SELECT win, source, greatest(s, f) AS "start", least(e, l) AS "end", datediff('day', greatest(s, f), least(e, l)) + 1 AS days FROM {_WINS} JOIN {_AVAIL} ON s <= l AND e >= f""")
def interval_plan(t):
    d = F.to_date("o_orderdate")
    w = t("orders").groupBy(F.col("o_custkey").alias("win")).agg(F.min(d).alias("start")).withColumn("end", F.date_add("start", 60))
    a = t("orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.min(d).alias("d")).select("source", F.date_add("d", 30).alias("first"), F.date_add("d", 400).alias("last"))
    return T.plan_windows(w, F.broadcast(a)).select("win", "source", "start", "end", F.col("days").cast("long").alias("days"))  # a row a source


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + INTERVAL 20 DAY AS DATE) AS e FROM orders) SELECT o_orderkey FROM (SELECT o_orderkey, s, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM o) WHERE p >= s""")
def overlap_check(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), 20).alias("e"))
    return T.overlaps(o, "o_custkey", "s", "e", "o_orderkey").select("o_orderkey")


# ---- clusters, vectors, text ------------------------------------------------------------------------------------------

_SUB = f"(SELECT ref_id AS id, rlon AS lon, rlat AS lat FROM {PARTS})"


def sites(t) -> DataFrame:
    return parts(t).select(F.col("ref_id").alias("id"), F.col("rlon").alias("lon"), F.col("rlat").alias("lat"))


@query(f"""WITH RECURSIVE p AS (SELECT * FROM {_SUB}), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND b.lon BETWEEN a.lon - 0.2e0 AND a.lon + 0.2e0 AND b.lat BETWEEN a.lat - 0.2e0 AND a.lat + 0.2e0 AND {_distance("a.lon", "a.lat", "b.lon", "b.lat")} <= 15000),
w AS (SELECT id AS v, id AS c FROM p UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.v) SELECT v AS id, min(c) AS cluster FROM w GROUP BY 1""")
def eps_components(t):
    return cluster.single_link(sites(t), cluster.on_earth(15000, 0.2))


@query(f"""WITH RECURSIVE p AS (SELECT * FROM {_SUB}), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND b.lon BETWEEN a.lon - 0.8e0 AND a.lon + 0.8e0 AND b.lat BETWEEN a.lat - 0.8e0 AND a.lat + 0.8e0 AND {_distance("a.lon", "a.lat", "b.lon", "b.lat")} <= 60000),
w AS (SELECT id AS v, id AS c FROM p UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.v), own AS (SELECT v AS id, min(c) AS cluster FROM w GROUP BY 1),
m AS (SELECT cluster, count(*) AS size, avg(lon) AS mid_lon, avg(lat) AS mid_lat FROM own JOIN p USING (id) GROUP BY 1 HAVING count(*) >= 5)
SELECT cluster, size, round(mid_lon, 6) AS mid_lon, round(mid_lat, 6) AS mid_lat, round(max({_haversine("lon", "lat", "mid_lon", "mid_lat")}), 3) AS spread_m FROM own JOIN p USING (id) JOIN m USING (cluster) GROUP BY ALL""")
def cluster_summary(t):
    """Clusters of five or more with their size, centre and spread (m)."""
    own = cluster.single_link(sites(t), cluster.on_earth(60000, 0.8)).join(sites(t), "id")
    mid = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("lon").alias("mid_lon"), F.avg("lat").alias("mid_lat")).where("size >= 5")
    far = own.join(mid, "cluster").groupBy("cluster", "size", "mid_lon", "mid_lat").agg(F.max(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("mid_lon"), F.col("mid_lat"))).alias("spread_m"))
    return rounded(far).withColumn("spread_m", F.round("spread_m", 3))


@query(f"""WITH RECURSIVE p AS (SELECT * FROM {_SUB}), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND b.lon BETWEEN a.lon - 0.4e0 AND a.lon + 0.4e0 AND b.lat BETWEEN a.lat - 0.4e0 AND a.lat + 0.4e0 AND {_distance("a.lon", "a.lat", "b.lon", "b.lat")} <= 30000),
core AS (SELECT a AS id FROM e GROUP BY 1 HAVING count(*) + 1 >= 4), ce AS (SELECT e.a, e.b FROM e JOIN core x ON x.id = e.a JOIN core y ON y.id = e.b),
w AS (SELECT id AS v, id AS c FROM core UNION SELECT ce.b, w.c FROM w JOIN ce ON ce.a = w.v), own AS (SELECT v AS id, min(c) AS cluster FROM w GROUP BY 1),
border AS (SELECT e.a AS id, min(own.cluster) AS near FROM e JOIN own ON own.id = e.b GROUP BY 1)
SELECT p.id, coalesce(own.cluster, border.near) AS cluster FROM p LEFT JOIN own ON own.id = p.id LEFT JOIN border ON border.id = p.id""")
def dbscan_clusters(t):
    return cluster.dbscan(sites(t), cluster.on_earth(30000, 0.4), 4)


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS square, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS first FROM embeddings""")
def l2_normalise(t):
    v = F.col("embedding").cast("array<double>")
    return t("embeddings").select("vec_id", F.round(vectors.dot(v, v), 4).alias("square"), F.round(vectors.unit(v)[0], 6).alias("first"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL), f AS (SELECT * FROM v WHERE vec_id % 2 = 0),
u AS (SELECT vec_id, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM f), m AS (SELECT list(a ORDER BY i) AS mean, list(CASE WHEN d = 0 THEN 1 ELSE d END ORDER BY i) AS sd FROM (SELECT i, avg(y) AS a, stddev_pop(y) AS d FROM u GROUP BY 1)),
z AS (SELECT vec_id, list_transform(range(1, len(x) + 1), lambda i: (x[i] - mean[i]) / sd[i]) AS z FROM v, m),
own AS (SELECT a.vec_id, min(list_distance(a.z, b.z)) AS d FROM z a JOIN z b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 0 AND a.vec_id <> b.vec_id GROUP BY 1), k AS (SELECT quantile_cont(d, 0.95) AS t FROM own),
far AS (SELECT a.vec_id, min(list_distance(a.z, b.z)) AS d FROM z a JOIN z b ON a.vec_id % 2 <> 0 AND b.vec_id % 2 = 0 GROUP BY 1)
SELECT e.vec_id, round(d, 6) AS distance, round(t, 6) AS threshold, d > t AS outside FROM embeddings e CROSS JOIN k LEFT JOIN far ON far.vec_id = e.vec_id WHERE e.vec_id % 2 <> 0""")
def knn_applicability(t):
    return rounded(vectors.applicability(t("embeddings"), "vec_id", "embedding", F.col("vec_id") % 2 == 0))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, substr(md5(CAST(event_id AS VARCHAR)), 1, 12) AS short_id FROM events")
def json_and_prefix(t):
    return t("events").select("event_id", T.json_paths(F.col("props"), ["k"])["k"].alias("k"), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 12).alias("short_id"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS links, regexp_extract_all(html, '<li><a href="([^"]*)"', 1)[1] AS first_link FROM pages""")
def regex_scan(t):
    found = F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), 1)
    return t("pages").select("page_id", F.size(found).cast("long").alias("links"), F.get(found, F.lit(0)).alias("first_link"))


@query("""SELECT event_type, coalesce(CAST(max(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END) AS VARCHAR), 'not measured') AS top, coalesce(CAST(bool_or(CASE WHEN event_type = 'view' THEN NULL ELSE value > 20 END) AS VARCHAR), 'not assessable') AS high FROM events GROUP BY 1""")
def console_export(t):
    e = t("events").groupBy("event_type").agg(F.max(F.when(F.col("event_id") % 7 != 0, F.col("event_id"))).alias("top"), F.bool_or(F.when(F.col("event_type") != "view", F.col("value") > 20)).alias("high"))
    return T.console_rows(e, ["event_type", "top", "high"])
