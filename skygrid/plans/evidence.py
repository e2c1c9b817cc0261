"""Queries on labels with evidence, splits, matches, profiles, metrics, clusters and text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygrid.functions import geo, scalars
from skygrid.operators import cluster, labels, spatial, stats, temporal
from skygrid.plans.catalog import _NEAR, BOXES, INSIDE, METRES, PARTS, POINTS, _distance, edges, kinds_m, labelled, located, parts, points, query, rounded, sites
from skygrid.sources import tables as T

# ---- labels and splits ------------------------------------------------------------------------------------------


@query(f"""WITH {_NEAR}, d AS (SELECT id, event_type, min(CASE WHEN ref_id % 5 = 0 THEN m END) AS f, min(CASE WHEN ref_id % 5 = 1 THEN m END) AS i, min(CASE WHEN ref_id % 5 = 2 THEN m END) AS a FROM (SELECT p.id, event_type, ref_id, {METRES} AS m FROM {POINTS} p LEFT JOIN {PARTS} r ON rlon BETWEEN lon - 0.25e0 AND lon + 0.25e0 AND rlat BETWEEN lat - 0.25e0 AND lat + 0.25e0) GROUP BY 1, 2),
k AS (SELECT id, CASE WHEN f <= 8000 THEN 1 WHEN i <= 12000 THEN 2 WHEN a <= 12000 THEN 3 WHEN event_type = 'click' THEN 4 WHEN event_type = 'view' THEN 5 ELSE 6 END AS k FROM d)
SELECT id, ['flare', 'industrial', 'industrial', 'agricultural', 'unlabelled', 'unlabelled'][k] AS label, ['flare catalogue', 'industrial map', 'asset register', 'land cover', 'land cover', 'none'][k] AS source, ['within 8000 m of a flare', 'within 12000 m of an industrial feature', 'within 12000 m of an operating asset', 'cropland and nothing nearer', 'vegetation and nothing nearer', 'no rule holds'][k] AS rule, [0.9e0, 0.7e0, 0.7e0, 0.5e0, 0.0e0, 0.0e0][k] AS confidence FROM k""")
def weak_label_evidence(t):
    m = kinds_m(t, ["f", "i", "a"])
    cover = F.when(F.col("event_type") == "click", "cropland").when(F.col("event_type") == "view", "grassland")
    out = points(t).select("id", "event_type").join(m.hint("merge"), "id", "left")
    return out.select("id", labels.evidence(F.col("f"), F.col("i"), F.col("a"), cover, 8000, 12000).alias("e")).select("id", "e.*")


@query("""SELECT c_custkey, CASE WHEN n_name IN ('FRANCE', 'GERMANY') THEN 'test' WHEN n_name IS NOT NULL AND c_custkey % 7 <> 0 THEN 'train' END AS part FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('FRANCE', 'GERMANY') OR c_custkey % 7 <> 0""")
def mask_split(t):
    """Test rows lie in the group; train rows lie in no group and not near it; the others are in neither."""
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", (F.col("c_custkey") % 7 == 0).alias("near_group"))
    return labels.mask_split(rows, "n_name", ["FRANCE", "GERMANY"], "near_group").select("c_custkey", "part")


@query(f"""WITH {_NEAR} SELECT label, count(*) AS n FROM labelled WHERE industrial_m IS NULL OR industrial_m > 15000 GROUP BY 1""")
def survival_filter(t):
    """Rows that a larger radius would leave as they are: the distance is missing or beyond it."""
    return labelled(t).where(F.col("industrial_m").isNull() | (F.col("industrial_m") > 15000)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT n_name AS state, CASE WHEN n_nationkey % 4 = 0 THEN 'a' WHEN n_nationkey % 4 = 1 THEN 'b' END AS grp FROM nation UNION ALL SELECT n_name, 'b' FROM nation WHERE n_nationkey = 8 UNION ALL SELECT NULL, 'c'),
names AS (SELECT DISTINCT grp FROM g WHERE grp IS NOT NULL)
SELECT 'in two groups' AS fault, state AS what FROM g WHERE grp IS NOT NULL AND state IS NOT NULL GROUP BY state HAVING count(DISTINCT grp) > 1 UNION ALL SELECT 'empty', grp FROM names WHERE grp NOT IN (SELECT grp FROM g WHERE state IS NOT NULL AND grp IS NOT NULL)""")
def group_faults(t):
    """What would make a split by groups invalid."""
    k = F.col("n_nationkey")
    n = t("nation").select(F.col("n_name").alias("state"), F.when(k % 4 == 0, "a").when(k % 4 == 1, "b").alias("grp"))
    more = t("nation").where("n_nationkey = 8").select(F.col("n_name").alias("state"), F.lit("b").alias("grp"))
    none = t("region").limit(1).select(F.lit(None).cast("string").alias("state"), F.lit("c").alias("grp"))
    return labels.group_faults(n.unionByName(more).unionByName(none), "state", "grp")


@query("""SELECT o_orderkey, CASE WHEN r <= floor(0.6e0 * n) THEN 'fit' WHEN r <= floor(0.8e0 * n) THEN 'calibrate' ELSE 'test' END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('p' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER () AS n FROM orders)""")
def three_way_split(t):
    return labels.three_way(t("orders").select("o_orderkey"), "o_orderkey", "p", (0.6, 0.2)).select("o_orderkey", "part")


# ---- matches ----------------------------------------------------------------------------------------------------


@query(f"""SELECT id, poly_id, name, true AS inside FROM (SELECT id, poly_id, CASE WHEN poly_id % 3 > 0 THEN 'P' || poly_id END AS name, row_number() OVER (PARTITION BY id ORDER BY poly_id % 3 = 0, poly_id) AS r FROM (SELECT id, poly_id FROM {POINTS}, {BOXES} WHERE {INSIDE} UNION SELECT id, poly_id + 30 FROM {POINTS}, {BOXES} WHERE {INSIDE})) WHERE r = 1
UNION ALL SELECT id, NULL, NULL, false FROM {POINTS} WHERE NOT EXISTS (SELECT 1 FROM {BOXES} WHERE {INSIDE})""")
def first_polygon(t):
    """The polygon of a point: named ones first, then the smaller id; whether there is one stands apart from its name."""
    both = located(t).unionByName(located(t).withColumn("poly_id", F.col("poly_id") + 30))
    named = both.withColumn("name", F.when(F.col("poly_id") % 3 > 0, F.concat(F.lit("P"), F.col("poly_id"))))
    best = named.groupBy("id").agg(F.min(F.struct(F.col("name").isNull().alias("unnamed"), "poly_id", "name")).alias("b"))
    return points(t).select("id").join(best, "id", "left").select("id", F.col("b.poly_id").alias("poly_id"), F.col("b.name").alias("name"), F.col("b").isNotNull().alias("inside"))


_ORPHANS = f"(SELECT id, lon, lat FROM {POINTS} WHERE NOT EXISTS (SELECT 1 FROM {BOXES} WHERE {INSIDE}))"
_TO_BOX = "111195.0797e0 * sqrt(pow(greatest(x0 - lon, lon - x0 - 5, 0) * cos(radians(lat)), 2) + pow(greatest(y0 - lat, lat - y0 - 5.5, 0), 2))"


@query(f"""WITH m AS (SELECT id, min(CASE WHEN lon > x0 + 1 AND lon < x0 + 2 AND lat > y0 + 1 AND lat < y0 + 2 THEN 111195.0797e0 * least((lon - x0 - 1) * cos(radians(lat)), (x0 + 2 - lon) * cos(radians(lat)), lat - y0 - 1, y0 + 2 - lat) ELSE {_TO_BOX} END) AS m FROM {_ORPHANS}, {BOXES} GROUP BY 1)
SELECT v AS metres, count(*) FILTER (WHERE m <= v) AS within, count(*) AS orphans FROM m, (VALUES (1000), (5000), (20000), (50000)) x(v) GROUP BY 1""")
def orphan_distance_sweep(t):
    """How many points outside all polygons lie within each distance of an edge."""
    outside = points(t).select("id", "lon", "lat").join(located(t), "id", "left_anti")
    return spatial.edge_distance_sweep(outside, edges(t), [1000, 5000, 20000, 50000])


@query(f"""WITH j AS (SELECT id, ref_id, {METRES} AS m FROM {POINTS} JOIN {PARTS} ON rlon BETWEEN lon - 0.25e0 AND lon + 0.25e0 AND rlat BETWEEN lat - 0.25e0 AND lat + 0.25e0), n AS (SELECT id, min(m) AS best FROM j GROUP BY 1)
SELECT j.id, count(*) AS tied, min(ref_id) AS first_ref, max(p_brand) AS brand FROM j JOIN n ON j.id = n.id AND abs(j.m - best) < 0.001 JOIN part ON p_partkey = ref_id GROUP BY 1""")
def rejoin_matched(t):
    """Attributes of the matched reference: all that lie within a millimetre of the nearest."""
    tied = spatial.nearest_ties(points(t), parts(t), 0.25, 0.001)
    return tied.join(t("part").hint("merge"), F.col("ref_id") == F.col("p_partkey")).groupBy("id").agg(F.count(F.lit(1)).alias("tied"), F.min("ref_id").alias("first_ref"), F.max("p_brand").alias("brand"))


@query(f"""WITH a AS (SELECT id, CAST(ts AS DATE) AS day, lon, lat FROM {POINTS} WHERE event_type = 'purchase'), b AS (SELECT CAST(ts AS DATE) AS day, lon AS rlon, lat AS rlat FROM {POINTS} WHERE event_type = 'click'),
m AS (SELECT a.id, min({_distance("lon", "lat", "rlon", "rlat")}) AS m FROM a LEFT JOIN b ON a.day = b.day AND rlon BETWEEN lon - 1 AND lon + 1 AND rlat BETWEEN lat - 1 AND lat + 1 GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (WHERE m <= 100000) AS checkable, count(*) FILTER (WHERE m <= 20000) AS hit, round(count(*) FILTER (WHERE m <= 20000) * 1.0e0 / nullif(count(*) FILTER (WHERE m <= 100000), 0), 6) AS rate FROM m""")
def reverse_match(t):
    """Points with any partner of the day in reach are checkable; those with a near one are hits."""
    p = points(t).withColumn("day", F.to_date("ts"))
    right = p.where("event_type = 'click'").select("day", F.col("id").alias("ref_id"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    left = p.where("event_type = 'purchase'").select("id", "day", "lon", "lat")
    near = spatial.in_box(left, right, 1.0, ("day",)).groupBy("id").agg(F.min("metres").alias("m"))
    out = left.join(near, "id", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("m") <= 100000).alias("checkable"), F.count_if(F.col("m") <= 20000).alias("hit"))
    return rounded(out.withColumn("rate", F.col("hit") / F.nullif("checkable", F.lit(0))))


@query("""SELECT p_partkey, coalesce(max(CASE WHEN ps > 9000 THEN 'active' END), '') AS status FROM part LEFT JOIN (SELECT l_partkey, l_extendedprice AS ps FROM lineitem WHERE l_returnflag = 'A') ON l_partkey = p_partkey GROUP BY 1""")
def side_sheet_status(t):
    """The status of a key in another sheet, '' where it has none."""
    sheet = t("lineitem").where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.max(F.when(F.col("l_extendedprice") > 9000, "active")).alias("status"))
    return t("part").join(sheet, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("status", F.lit("")).alias("status"))


_RING = "POLYGON ((72.5 12.0, 90.25 14.5, 80.0 30.0, 72.5 12.0))"


@query(f"""WITH c AS (SELECT [[72.5e0, 12.0e0], [90.25e0, 14.5e0], [80.0e0, 30.0e0], [72.5e0, 12.0e0]] AS r), e AS (SELECT r[i][1] AS x1, r[i][2] AS y1, r[i + 1][1] AS x2, r[i + 1][2] AS y2 FROM c, range(1, 4) t(i))
SELECT id FROM {POINTS}, e WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1 HAVING count(*) % 2 = 1""")
def footprint_filter(t):
    """Points inside one footprint given as WKT."""
    ring = t("region").limit(1).select(F.lit(0).cast("long").alias("poly_id"), geo.wkt_ring(F.lit(_RING)).alias("ring"))
    return spatial.inside(points(t), geo.ring_edges(ring), 1.0).select("id")


@query("""SELECT page_id, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, n FROM (SELECT page_id, list_min(list_transform(c, lambda p: p[1])) AS min_x, list_min(list_transform(c, lambda p: p[2])) AS min_y, CAST(len(c) AS BIGINT) AS n FROM (SELECT page_id, [[70.0e0 + page_id % 9, 10.0e0], [75.5e0, 8.25e0 + page_id % 5], [72.0e0, 20.0e0], [70.0e0 + page_id % 9, 10.0e0]] AS c FROM pages))""")
def wkt_corner(t):
    """South-west corner of a footprint in WKT with a service prefix."""
    p = F.col("page_id")
    first = F.concat((70 + p % 9).cast("string"), F.lit(" 10"))
    wkt = F.concat(F.lit("geography'SRID=4326;POLYGON (("), first, F.lit(", 75.5 "), (p % 5 + 8.25).cast("string"), F.lit(", 72.0 20, "), first, F.lit("))'"))
    ring = t("pages").select("page_id", geo.wkt_ring(T.footprint(wkt)).alias("r"))
    return ring.select("page_id", F.array_min(F.transform("r", lambda x: x["x"])).alias("min_x"), F.array_min(F.transform("r", lambda x: x["y"])).alias("min_y"), F.size("r").cast("long").alias("n"))


# ---- profiles ---------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT year(o_orderdate) AS y, o_orderstatus AS k, count(*) AS v FROM orders GROUP BY 1, 2), w AS (SELECT year(o_orderdate) AS y, count(DISTINCT o_custkey) AS w FROM orders GROUP BY 1) SELECT k, round(sum(w * v) * 1.0e0 / sum(w), 6) AS background FROM d JOIN w USING (y) GROUP BY 1""")
def weighted_background(t):
    """Counts of a class a year, averaged with the years' weights."""
    o = t("orders").withColumn("y", F.year("o_orderdate"))
    d = o.groupBy("y", F.col("o_orderstatus").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    w = o.groupBy("y").agg(F.countDistinct("o_custkey").alias("w"))
    return rounded(d.join(w, "y").groupBy("k").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("background")))


@query("""WITH s AS (SELECT event_type, CAST(ts AS DATE) AS d, hour(ts) * 2 + minute(ts) // 30 AS slot, count(*) AS n FROM events WHERE hour(ts) NOT IN (2, 3) GROUP BY 1, 2, 3), h AS (SELECT event_type, slot // 2 AS hour, avg(n) AS mean FROM s GROUP BY 1, 2), c AS (SELECT event_type, count(DISTINCT slot) AS slots, count(*) AS seen, count(DISTINCT d) AS days FROM s GROUP BY 1)
SELECT c.event_type, CAST(x.h AS INTEGER) AS hour, round(mean, 6) AS mean, slots, round(seen / (48.0e0 * days), 6) AS completeness FROM c CROSS JOIN range(24) x(h) LEFT JOIN h ON h.event_type = c.event_type AND h.hour = x.h""")
def hourly_coverage(t):
    """Mean events a half-hour slot by hour, null for an hour never observed; slots seen of 48 and share of all slots of the days."""
    e = t("events").where(~F.hour("ts").isin(2, 3))
    s = e.groupBy("event_type", F.to_date("ts").alias("d"), (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    h = s.groupBy("event_type", F.floor(F.col("slot") / 2).cast("int").alias("hour")).agg(F.avg("n").alias("mean"))
    c = s.groupBy("event_type").agg(F.countDistinct("slot").alias("slots"), F.count(F.lit(1)).alias("seen"), F.countDistinct("d").alias("days"))
    grid = c.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return rounded(grid.join(h, ["event_type", "hour"], "left").select("event_type", "hour", "mean", "slots", (F.col("seen") / (48.0 * F.col("days"))).alias("completeness")))


@query("""WITH d AS (SELECT DISTINCT user_id, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-10' THEN 'w1' WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-16' AND DATE '2024-01-25' THEN 'w2' END AS w, CAST(ts AS DATE) AS day FROM events),
g AS (SELECT w, datediff('day', lag(day) OVER (PARTITION BY user_id, w ORDER BY day), day) AS gap FROM d WHERE w IS NOT NULL) SELECT w, CAST(gap AS INTEGER) AS gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2""")
def day_gaps_in_windows(t):
    """Gaps between active days of a user, within each named window only, pooled."""
    d = F.to_date("ts")
    win = F.when(d.between("2024-01-01", "2024-01-10"), "w1").when(d.between("2024-01-16", "2024-01-25"), "w2")
    return temporal.day_gaps(t("events").withColumn("w", win).where("w is not null"), ["user_id", "w"], d).groupBy("w", "gap").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), g AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS island FROM d), r AS (SELECT user_id, island, count(*) AS days FROM g GROUP BY 1, 2)
SELECT user_id, count(*) AS runs, max(days) AS longest, round(median(days), 6) AS median_run FROM r GROUP BY 1""")
def run_lengths(t):
    runs = temporal.active_runs(t("events"), "user_id", F.to_date("ts"))
    return rounded(runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max("days").alias("longest"), F.median("days").alias("median_run")))


@query("""SELECT n_name AS state, coalesce(n, 0) AS n, coalesce(late, 0) AS late FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS late FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000 AND o_totalprice > 250000 GROUP BY 1) ON c_nationkey = n_nationkey""")
def seeded_crosstab(t):
    """Counts by nation, with a row of zeros where there is nothing to count."""
    j = t("customer").where("c_acctbal > 9000").join(t("orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"))
    c = j.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("late"))
    return t("nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("state"), F.nvl("n", F.lit(0)).alias("n"), F.nvl("late", F.lit(0)).alias("late"))


# ---- metrics ----------------------------------------------------------------------------------------------------

_JUDGED = "(SELECT event_id, event_type AS truth, CASE WHEN event_id % 4 = 0 THEN 'click' WHEN event_id % 9 = 0 THEN 'other' ELSE event_type END AS guess, user_id % 3 AS grp, ((event_id * 7919) % 1000) / 1000.0e0 AS p FROM events)"


def judged(t) -> DataFrame:
    e = F.col("event_id")
    guess = F.when(e % 4 == 0, "click").when(e % 9 == 0, "other").otherwise(F.col("event_type"))
    return t("events").select("event_id", F.col("event_type").alias("truth"), guess.alias("guess"), (F.col("user_id") % 3).alias("grp"), ((e * 7919 % 1000) / 1000.0).alias("p"))


_REPORT = f"k AS (SELECT label, count(*) FILTER (WHERE truth = label AND guess = label) AS tp, count(*) FILTER (WHERE truth = label) AS support, count(*) FILTER (WHERE guess = label) AS guessed FROM {_JUDGED}, (SELECT truth AS label FROM {_JUDGED} UNION SELECT guess FROM {_JUDGED}) GROUP BY 1), r AS (SELECT label, support, CASE WHEN guessed > 0 THEN tp * 1.0e0 / guessed ELSE 0 END AS p, CASE WHEN support > 0 THEN tp * 1.0e0 / support ELSE 0 END AS r, CASE WHEN support + guessed > 0 THEN 2.0e0 * tp / (support + guessed) ELSE 0 END AS f FROM k)"


@query(f"""WITH {_REPORT} SELECT label, support, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1 FROM r UNION ALL SELECT 'macro', CAST(sum(support) AS BIGINT), round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM r""")
def macro_report(t):
    """The report by class with a row of unweighted means."""
    each = stats.classification(judged(t), "truth", "guess")
    macro = each.agg(F.lit("macro").alias("label"), F.sum("support").alias("support"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
    return rounded(each.unionByName(macro))


@query(f"""SELECT truth, {", ".join(f"round(count(*) FILTER (WHERE guess = '{c}') * 1.0e0 / count(*), 6) AS to_{c}" for c in ("click", "other", "purchase", "view"))} FROM {_JUDGED} GROUP BY 1""")
def confusion_pivot(t):
    """Shares of the guesses in each true class: rows add up to one over all classes."""
    names = ["click", "other", "purchase", "view"]
    wide = judged(t).groupBy("truth").pivot("guess", names).count()
    total = judged(t).groupBy("truth").agg(F.count(F.lit(1)).alias("_n"))
    return rounded(wide.join(total, "truth").select("truth", *((F.nvl(c, F.lit(0)) / F.col("_n")).alias(f"to_{c}") for c in names)))


@query(f"""WITH g AS (SELECT grp, count(*) AS support, round(avg(CASE WHEN truth = guess THEN 1.0e0 ELSE 0 END), 4) AS share FROM {_JUDGED} GROUP BY 1) SELECT round(sum(support * share) / sum(support), 6) AS weighted, round(avg(share), 6) AS mean, round(max(share) - min(share), 6) AS spread, round(max(share) / nullif(min(share), 0), 6) AS ratio, count(*) FILTER (WHERE share < 0.9) AS under FROM g""")
def group_spread(t):
    """Shares of groups, rounded to four places: mean weighted by support, mean, spread, ratio, groups under 0.9."""
    g = judged(t).groupBy("grp").agg(F.count(F.lit(1)).alias("support"), F.round(F.avg((F.col("truth") == F.col("guess")).cast("double")), 4).alias("share"))
    top, low = F.max("share"), F.min("share")
    return rounded(g.agg((F.sum(F.col("support") * F.col("share")) / F.sum("support")).alias("weighted"), F.avg("share").alias("mean"), (top - low).alias("spread"), (top / F.nullif(low, F.lit(0.0))).alias("ratio"), F.count_if(F.col("share") < 0.9).alias("under")))


_POSTERIOR = "(SELECT event_id, event_id % 3 + 1 AS truth, [((event_id * 7919) % 997) + 1, ((event_id * 104729) % 991) + 1, ((event_id * 31) % 983) + 1] AS w FROM events)"


def posterior(t) -> DataFrame:
    e = F.col("event_id")
    w = F.array(e * 7919 % 997 + 1, e * 104729 % 991 + 1, e * 31 % 983 + 1)
    return t("events").select("event_id", (e % 3 + 1).cast("int").alias("truth"), F.transform(w, lambda x: x / F.aggregate(w, F.lit(0).cast("long"), lambda a, b: a + b)).alias("p"))


@query(f"""WITH p AS (SELECT event_id, truth, list_transform(w, lambda x: x / (w[1] + w[2] + w[3])) AS p, event_id % 5 = 0 AS cal FROM {_POSTERIOR}), k AS (SELECT count(*) AS n, least(1.0e0, ceil((count(*) + 1) * 0.9e0) / count(*)) AS lev FROM p WHERE cal),
o AS (SELECT 1 - p[truth] AS a, row_number() OVER (ORDER BY 1 - p[truth]) - 1 AS r, lev * (n - 1) AS pos FROM p, k WHERE cal), c AS (SELECT sum(CASE WHEN r = floor(pos) THEN a * (1 - (pos - floor(pos))) WHEN r = floor(pos) + 1 THEN a * (pos - floor(pos)) ELSE 0 END) AS t FROM o),
s AS (SELECT truth, list_filter([1, 2, 3], lambda i: p[i] >= 1 - t) AS s FROM p, c WHERE NOT cal)
SELECT round(avg(CASE WHEN list_contains(s, truth) THEN 1.0e0 ELSE 0 END), 6) AS coverage, round(avg(len(s)), 6) AS size, round(avg(CASE WHEN len(s) = 1 THEN 1.0e0 ELSE 0 END), 6) AS single, round(avg(CASE WHEN len(s) = 0 THEN 1.0e0 ELSE 0 END), 6) AS empty FROM s""")
def conformal_sets(t):
    """Prediction sets at 0.9: coverage, mean size, shares of sets of one class and of none."""
    return rounded(labels.conformal_sets(posterior(t), "p", "truth", F.col("event_id") % 5 == 0, 0.1))


@query(f"""SELECT event_id, list_position(p, list_max(p)) AS top, round(list_max(p), 4) AS top_p, array_to_string(list_filter([1, 2, 3], lambda i: p[i] >= 0.3), ' ') AS likely, array_to_string(list_transform([1, 2, 3], lambda i: 'c' || i || '=' || CAST(CAST(round(p[i] * 10000) AS BIGINT) AS VARCHAR)), ' ') AS posterior FROM (SELECT event_id, list_transform(w, lambda x: x / (w[1] + w[2] + w[3])) AS p FROM {_POSTERIOR})""")
def top_of_posterior(t):
    """The likeliest class (the first if tied), the likely ones, and the posterior in ten-thousandths."""
    p = F.col("p")
    ids = F.array(*map(F.lit, (1, 2, 3)))
    shown = F.transform(ids, lambda i: F.concat(F.lit("c"), i.cast("string"), F.lit("="), F.round(F.element_at(p, i) * 10000).cast("long").cast("string")))
    likely = F.filter(ids, lambda i: F.element_at(p, i) >= 0.3)
    return posterior(t).select("event_id", F.array_position(p, F.array_max(p)).cast("int").alias("top"), F.round(F.array_max(p), 4).alias("top_p"), F.array_join(likely.cast("array<string>"), " ").alias("likely"), F.array_join(shown, " ").alias("posterior"))


# ---- clusters ---------------------------------------------------------------------------------------------------


def _linked(metres: int, half: str) -> str:
    return f"""p AS (SELECT ref_id AS id, rlon AS lon, rlat AS lat FROM {PARTS}), e AS (SELECT a.id AS a, b.id AS b, {_distance("a.lon", "a.lat", "b.lon", "b.lat")} AS m FROM p a JOIN p b ON a.id <> b.id AND b.lon BETWEEN a.lon - {half}e0 AND a.lon + {half}e0 AND b.lat BETWEEN a.lat - {half}e0 AND a.lat + {half}e0 WHERE {_distance("a.lon", "a.lat", "b.lon", "b.lat")} <= {metres})"""


@query(f"""WITH RECURSIVE {_linked(60000, "0.8")}, {", ".join(f"w{r} AS (SELECT id AS v, id AS c FROM p UNION SELECT e.b, w{r}.c FROM w{r} JOIN e ON e.a = w{r}.v AND m <= {r}), c{r} AS (SELECT c, count(*) AS n FROM (SELECT v, min(c) AS c FROM w{r} GROUP BY 1) GROUP BY 1)" for r in (20000, 40000, 60000))}
{" UNION ALL ".join(f"SELECT {r} AS metres, count(*) AS clusters, count(*) FILTER (WHERE n >= 2) AS linked, max(n) AS largest FROM c{r}" for r in (20000, 40000, 60000))}""")
def radius_sweep(t):
    """Clusters at several radii."""
    return cluster.sweep(sites(t), lambda r: cluster.on_earth(r, 0.8 * r / 60000), [20000, 40000, 60000])


_AT = f"(SELECT id, event_type, user_id, lon * 0.011e0 AS x, lat * 0.011e0 AS y, day(ts) * 0.01e0 AS z FROM {POINTS} WHERE event_type <> 'view')"


@query(f"""WITH RECURSIVE p AS (SELECT * FROM {_AT}), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= 0.0151e0 AND abs(a.y - b.y) <= 0.0151e0 AND abs(a.z - b.z) <= 0.0151e0 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 0.000225e0),
core AS (SELECT a AS id FROM e GROUP BY 1 HAVING count(*) + 1 >= 8), ce AS (SELECT e.a, e.b FROM e JOIN core x ON x.id = e.a JOIN core y ON y.id = e.b),
w AS (SELECT id AS v, id AS c FROM core UNION SELECT ce.b, w.c FROM w JOIN ce ON ce.a = w.v), own AS (SELECT v AS id, min(c) AS cluster FROM w GROUP BY 1),
border AS (SELECT e.a AS id, min(own.cluster) AS near FROM e JOIN own ON own.id = e.b GROUP BY 1), l AS (SELECT p.id, coalesce(own.cluster, border.near) AS cluster FROM p LEFT JOIN own ON own.id = p.id LEFT JOIN border ON border.id = p.id), n AS (SELECT cluster, count(*) AS n FROM l WHERE cluster IS NOT NULL GROUP BY 1)
SELECT l.id, l.cluster, coalesce(n.n >= 20, false) AS industrial FROM l LEFT JOIN n USING (cluster)""")
def space_time_density(t):
    """Density clusters in (longitude, latitude, day), scaled; a cluster of 20 or more counts as industrial."""
    p = points(t).where("event_type <> 'view'").select("id", (F.col("lon") * 0.011).alias("x"), (F.col("lat") * 0.011).alias("y"), (F.day("ts") * 0.01).alias("z"))
    found = cluster.dbscan(p, cluster.euclidean(["x", "y", "z"], 0.015), 8)
    size = found.where("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return found.join(size, "cluster", "left").select("id", "cluster", F.coalesce(F.col("n") >= 20, F.lit(False)).alias("industrial"))


# ---- order, text, display ---------------------------------------------------------------------------------------


@query("""SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END NULLS LAST, c_custkey) AS r FROM customer) WHERE r = 1""")
def least_cloudy(t):
    """The first product of each group by a measure that may be missing; missing ones come last."""
    m = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    return t("customer").groupBy("c_mktsegment").agg(F.min(F.struct(m.isNull().alias("none"), m.alias("m"), "c_custkey")).alias("b")).select("c_mktsegment", F.col("b.c_custkey").alias("c_custkey"))


@query("""SELECT n_name, r FROM (SELECT n_name, CAST(row_number() OVER (ORDER BY x DESC NULLS LAST, n_name) AS BIGINT) AS r FROM (SELECT n_name, nullif(count(c_custkey) FILTER (WHERE c_acctbal > 9500), 0) AS x FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)) WHERE r <= 12""")
def ordered_listing(t):
    """A listing in a total order: the measure descending, missing ones last, the name where tied."""
    n = t("customer").where("c_acctbal > 9500").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("x"))
    j = t("nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    listed = j.orderBy(F.desc_nulls_last("x"), "n_name").limit(12)  # the listing's length
    return listed.select("n_name", F.row_number().over(Window.orderBy(F.desc_nulls_last("x"), "n_name")).cast("long").alias("r"))


@query("""SELECT event_id, translate(translate('a' || chr(8211) || event_id || chr(8217) || 's' || chr(160) || '"x"', chr(8211) || chr(8217) || chr(160), '-'' '), '"', '''') AS name FROM events""")
def folded_names(t):
    """Dashes, quotes and spaces of many kinds as plain ones."""
    name = F.concat(F.lit("a–"), F.col("event_id").cast("string"), F.lit('’s "x"'))
    return t("events").select("event_id", scalars.folded(name).alias("name"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS BIGINT) WHEN 1 THEN NULL WHEN 2 THEN NULL END AS n FROM events""")
def json_integer(t):
    """A whole number at a JSON path; a boolean, a text or a missing value is none."""
    e = F.col("event_id")
    value = F.when(e % 4 == 0, e.cast("string")).when(e % 4 == 1, "true").when(e % 4 == 2, '"12"').otherwise("1.5")
    text = F.concat(F.lit('{"status": {"count": '), value, F.lit("}}"))
    return t("events").select("event_id", T.json_integer(text, "$.status.count").alias("n"))


@query("""SELECT event_id, path, v FROM (SELECT event_id, unnest(['a', 'b.0', 'b.1.c', 'd.e']) AS path, unnest([event_id * 1.0e0, 2.5e0, event_id % 7, -1.0e0]) AS v FROM events)""")
def json_numbers(t):
    """All numbers of a JSON tree with their dotted paths."""
    e = F.col("event_id").cast("string")
    text = F.concat(F.lit('{"a": '), e, F.lit(', "b": [2.5, {"c": '), (F.col("event_id") % 7).cast("string"), F.lit(', "t": "x"}], "d": {"e": -1, "f": true, "g": null}}'))
    return T.json_numbers(t("events").select("event_id", text.alias("j")), "event_id", "j").select("event_id", "path", F.col("value").alias("v"))


@query("""WITH c AS (SELECT user_id % 50 AS claim, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS rank, min(event_id) AS src FROM events GROUP BY 1, 2), b AS (SELECT claim, arg_min(rank, CAST(rank AS BIGINT) * 1000000000 + src) AS rank, arg_min(src, CAST(rank AS BIGINT) * 1000000000 + src) AS src FROM c GROUP BY 1), old AS (SELECT claim FROM b WHERE claim % 6 <> 0 UNION ALL SELECT 99)
SELECT coalesce(b.claim, old.claim) AS claim, b.rank, b.src, CASE WHEN old.claim IS NULL THEN 'new' WHEN b.claim IS NULL THEN 'gone' ELSE 'same' END AS state FROM b FULL JOIN old ON b.claim = old.claim""")
def claim_provenance(t):
    """The best source of each claim, and what is new or gone against a baseline."""
    kind = F.col("event_type")
    rank = F.when(kind == "purchase", 1).when(kind == "view", 2).when(kind == "click", 3).otherwise(4)
    b = t("events").groupBy((F.col("user_id") % 50).alias("claim")).agg(F.min(F.struct(rank.alias("rank"), "event_id")).alias("m")).select("claim", F.col("m.rank").alias("rank"), F.col("m.event_id").alias("src"))
    old = b.where("claim % 6 <> 0").select("claim").unionByName(t("region").limit(1).select(F.lit(99).cast("long").alias("claim")))
    return labels.against_baseline(b, old, "claim")


@query("""SELECT event_id, CASE WHEN v IS NULL THEN 'not measured' WHEN v < 1000 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) || ' m' ELSE printf('%.1f', v / 1000) || ' km' END AS distance, CASE WHEN v IS NULL THEN 'not measured' ELSE printf('%.1f', (event_id % 999) / 10.0e0) || '%' END AS share,
CASE WHEN length(x) <= 3 THEN x ELSE reverse(rtrim(regexp_replace(reverse(substr(x, 1, length(x) - 3)), '([0-9][0-9]?)', '\\1,', 'g'), ',')) || ',' || substr(x, -3) END AS grouped FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN (event_id * 37 % 4000) // 100 * 100 END AS v, CAST(event_id * 7919 AS VARCHAR) AS x FROM events)""")
def shown_values(t):
    """Metres or kilometres, per cent, and whole numbers grouped as in India; a missing value says so."""
    e = F.col("event_id")
    v = F.when(e % 5 > 0, F.floor(e * 37 % 4000 / 100) * 100)
    share = F.when(v.isNotNull(), (e % 999) / 10.0)
    return t("events").select("event_id", scalars.shown_metres(v).alias("distance"), scalars.shown_percent(share).alias("share"), scalars.grouped_indian(e * 7919).alias("grouped"))


# ---- sources ----------------------------------------------------------------------------------------------------


@query("""SELECT source, first, last FROM (SELECT 'S' || n_nationkey AS source, DATE '2020-01-01' + CAST(n_nationkey AS INTEGER) AS first, DATE '2021-03-01' AS last, n_nationkey AS k FROM nation) WHERE k % 4 NOT IN (2, 3)""")
def availability_lines(t):
    """Availability of sources from text lines; lines that are not 'source,date,date' are skipped."""
    k = F.col("n_nationkey")
    day = F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")).cast("string")
    line = F.when(k % 4 == 2, "broken line").when(k % 4 == 3, F.concat(F.lit("S,"), day, F.lit(",not a date"))).otherwise(F.concat(F.lit("S"), k.cast("string"), F.lit(","), day, F.lit(",2021-03-01")))
    return T.availability(t("nation").select(line.alias("line")), "line")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-11-02 07:41:00' + to_days(CAST(event_id % 20 AS INTEGER)) END AS instant FROM events""")
def granule_times(t):
    e = F.col("event_id")
    day = F.date_add(F.lit("2024-11-02").cast("date"), (e % 20).cast("int"))
    name = F.when(e % 3 == 0, F.concat(F.lit("3SIMG_"), F.upper(F.date_format(day, "ddMMMyyyy")), F.lit("_0741_L1B.h5"))).otherwise("readme.txt")
    return t("events").select("event_id", T.granule_instant(name).cast("timestamp_ntz").alias("instant"))


@query("""SELECT page_id, CAST(2 AS BIGINT) AS n, '70.5,' || (page_id % 20) || '.25' AS first FROM pages""")
def placemark_coordinates(t):
    kml = F.concat(F.lit("<Placemark><coordinates> 70.5,"), (F.col("page_id") % 20).cast("string"), F.lit(".25,0 </coordinates><x/><coordinates>1.5,2</coordinates></Placemark>"))
    found = T.coordinates(kml)
    return t("pages").select("page_id", F.size(found).cast("long").alias("n"), found[0].alias("first"))


@query(f"""SELECT count(*) FILTER (WHERE lon BETWEEN 70 AND 80 AND lat BETWEEN 10 AND 20) AS closed, count(*) FILTER (WHERE lon > 70 AND lon < 80 AND lat > 10 AND lat < 20) AS open FROM {POINTS}""")
def box_bounds(t):
    box = (70.0, 10.0, 80.0, 20.0)
    lon, lat = F.col("lon"), F.col("lat")
    return points(t).agg(F.count_if(T.within(lon, lat, box)).alias("closed"), F.count_if(T.within(lon, lat, box, closed=False)).alias("open"))


@query("""SELECT k, v FROM (SELECT event_id % 300 AS k, max(event_id) AS v FROM events WHERE event_id % 300 < 120 GROUP BY 1) UNION ALL SELECT k, v FROM (SELECT event_id % 300 AS k, min(event_id) AS v FROM events WHERE event_id % 300 >= 120 GROUP BY 1)""")
def provenance_upsert(t):
    k = (F.col("event_id") % 300).alias("k")
    target = t("events").groupBy(k).agg(F.min("event_id").alias("v"))
    return T.upsert(target, t("events").groupBy(k).agg(F.max("event_id").alias("v")).where("k < 120"), "k")


@query(f"""SELECT id, CASE WHEN c >= 1023 THEN NULL ELSE round(180 + least(c, 999) * 0.125e0, 6) END AS kelvin FROM (SELECT id, CAST(id * 31 % 1100 AS INTEGER) AS c FROM {POINTS})""")
def counts_to_kelvin(t):
    """Detector counts through a table of temperatures; the index is clipped to the table, the fill count is missing."""
    table = [180 + i * 0.125 for i in range(1000)]
    return rounded(points(t).select("id", scalars.looked_up((F.col("id") * 31 % 1100).cast("int"), table, 1023).alias("kelvin")))


@query(f"""WITH q AS (SELECT id, sqrt(pow(xa - xb, 2) + pow(ya - yb, 2)) AS m, {_distance("lon", "lat", "lon + 0.05e0", "lat + 0.04e0")} AS g FROM (SELECT id, lon, lat, {geo.conic_sql("lon", "lat")[0]} AS xa, {geo.conic_sql("lon", "lat")[1]} AS ya, {geo.conic_sql("(lon + 0.05e0)", "(lat + 0.04e0)")[0]} AS xb, {geo.conic_sql("(lon + 0.05e0)", "(lat + 0.04e0)")[1]} AS yb FROM {POINTS}))
SELECT id, round(m, 2) AS metres, m <= 7000 AS within, abs(m / g - 1) < 0.03 AS near_ellipsoid FROM q""")
def conic_within(t):
    """Planar distances on the national conic (EPSG:7755), and how they agree with the ellipsoid."""
    lon, lat = F.col("lon"), F.col("lat")
    (ax, ay), (bx, by) = geo.conic(lon, lat), geo.conic(lon + 0.05, lat + 0.04)
    m, g = F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2)), geo.distance_m(lon, lat, lon + 0.05, lat + 0.04)
    return points(t).select("id", F.round(m, 2).alias("metres"), (m <= 7000).alias("within"), (F.abs(m / g - 1) < 0.03).alias("near_ellipsoid"))
