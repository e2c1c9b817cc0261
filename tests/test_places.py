"""Tiles, WKT areas, probes, SQL functions, named tables and typed JSON on hand-made cases."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skygrid.functions import geo, sqlfunctions
from skygrid.operators import sampling, spatial, tiles
from skygrid.sources import named, strict_json

GRID = tiles.Grid(degrees=3, pixels=12, block=4)
HOLED = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)),\n ( (10 10,10 12,12 12,12 10,10 10) ))"


def test_tile_names_and_corners(spark):
    got = spark.createDataFrame([(72.5, 30.0), (-0.1, -0.1), (-179.5, 8.9)], "lon double, lat double").select(GRID.tile(F.col("lon"), F.col("lat")).alias("t")).select("t", *(c.alias(n) for c, n in zip(GRID.corner(F.col("t")), "wn")))
    assert [tuple(r) for r in got.collect()] == [("N30E072", 72, 33), ("S03W003", -3, 0), ("N06W180", -180, 9)]


def test_samples_equal_brute_force(spark):
    rng = random.Random(8)
    cells = {("N00E000", r, c): rng.choice([10, 20, 99]) for r in range(12) for c in range(12) if rng.random() < 0.7}
    cells[("N03W003", 0, 0)] = 10
    pixels = spark.createDataFrame([(*k, v) for k, v in cells.items()] + [("N03W003", 0, 0, 200)], "tile string, row long, col long, code int")
    pts = [(i, rng.uniform(0, 3), rng.uniform(0, 3), "N00E000") for i in range(300)] + [(900, 3.0, 0.0, "N00E000"), (901, -1.0, 1.0, "N00E000"), (902, 5.0, 5.0, "N03E003"), (903, -3.0, 6.0, "N03W003")]
    got = {r.id: r.code for r in tiles.sample(spark.createDataFrame(pts, "id long, lon double, lat double, tile string"), tiles.to_blocks(pixels, GRID), GRID, [10, 20]).collect()}
    for i, lon, lat, tile in pts[:300]:
        code = cells.get((tile, min(int((3 - lat) * 4), 11), min(int(lon * 4), 11)))
        assert got[i] == (code if code in (10, 20) else None)
    last = cells.get(("N00E000", 11, 11))
    assert got[900] == (last if last in (10, 20) else None)  # the far corner belongs to the tile
    assert got[901] is None and got[902] is None and got[903] == 10
    assert len(got) == len(pts)


def test_swapped_axes_raise(spark):
    swapped = spark.createDataFrame([(1, 30.5, 72.5, "N30E072"), (2, 31.0, 73.0, "N30E072"), (3, 0.5, 0.5, "N00E000")], "id long, lon double, lat double, tile string")
    blocks = spark.createDataFrame([], "tile string, block_row long, block_col long, codes binary")
    with pytest.raises(ValueError, match="none of 2 points fall inside N30E072; check the axis order"):
        tiles.sample(swapped, blocks, GRID, [10])


def test_wkt_edges_of_parts_and_holes(spark):
    areas = spark.createDataFrame([(1, HOLED), (2, "POLYGON((0 0, 0 1, 1 1, 1 0, 0 0))"), (3, "POLYGON EMPTY"), (4, None)], "osm long, wkt string")
    rows = geo.wkt_edges(areas, "osm", "wkt").collect()
    assert Counter((r.poly_id, r.part, r.ring) for r in rows) == {(1, 0, 0): 4, (1, 0, 1): 4, (1, 1, 0): 4, (2, 0, 0): 4}
    turn = lambda own: sum(r.x1 * r.y2 - r.x2 * r.y1 for r in own)
    for poly, part, ring in {(r.poly_id, r.part, r.ring) for r in rows}:
        own = sorted((r for r in rows if (r.poly_id, r.part, r.ring) == (poly, part, ring)), key=lambda r: r.seq)
        assert (turn(own) > 0) == (ring == 0)
        assert all((a.x2, a.y2) == (b.x1, b.y1) for a, b in zip(own, own[1:] + own[:1]))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 11.0, 11.0), (4, 9.0, 9.0), (5, 3.5, 2.0)], "id long, lon double, lat double")
    inside = {(r.id, r.poly_id) for r in spatial.inside(pts, geo.wkt_edges(areas, "osm", "wkt"), 1.0).collect()}
    assert inside == {(1, 1), (1, 2), (3, 1), (5, 1)}
    for bad in ("POLYGON((0 0, 1 0, 1 1, 0 1))", "POLYGON((0 0, 1 x, 1 1, 0 0))", "POLYGON((0 0, 1 1, 0 0))"):
        with pytest.raises(Exception, match="not a closed ring in area 7"):
            geo.wkt_edges(spark.createDataFrame([(7, bad)], "osm long, wkt string"), "osm", "wkt").collect()


def test_long_wkt_lines_are_read(spark, tmp_path):
    from skygrid.sources import tables

    ring = ", ".join(f"{math.cos(2 * math.pi * i / 150_000):.9f} {math.sin(2 * math.pi * i / 150_000):.9f}" for i in range(150_000))
    ring += ", " + ring.split(", ")[0]
    assert len(ring) > 3_000_000
    (tmp_path / "a.csv").write_text(f'osm_id,admin_level,name,name_en,wkt\n5,4,One,,"POLYGON(({ring}))"\n5,4,Again,,"POLYGON((0 0, 1 0, 1 1, 0 0))"\n6,4,Two,Two,"POLYGON((0 0, 1 0, 1 1, 0 0))"\n')
    got = tables.read_areas(spark, str(tmp_path / "a.csv"))
    assert {(r.osm_id, r.name) for r in got.collect()} == {(5, "One"), (6, "Two")}  # the first row of an area counts
    assert geo.wkt_edges(got, "osm_id", "wkt").where("poly_id = 5").count() == 150_000


def vincenty(lon_a, lat_a, lon_b, lat_b):
    """The iterative geodesic on the ellipsoid."""
    a, f = 6378137.0, 1 / 298.257223563
    b, length = a * (1 - f), math.radians(lon_b - lon_a)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat_a, lat_b))
    lam = length
    for _ in range(200):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if not s:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma, sin_alpha = math.atan2(s, c), math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        cos2 = 1 - sin_alpha**2
        mid = c - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        old, lam = lam, length + (1 - k) * f * sin_alpha * (sigma + k * s * (mid + k * c * (2 * mid * mid - 1)))
        if abs(lam - old) < 1e-13:
            break
    u = cos2 * (a * a - b * b) / (b * b)
    big, small = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768)), u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
    delta = small * s * (mid + small / 4 * (c * (2 * mid * mid - 1) - small / 6 * mid * (4 * s * s - 3) * (4 * mid * mid - 3)))
    return b * big * (sigma - delta)


def test_sql_functions(spark):
    sqlfunctions.install(spark)
    metres = lambda *p: spark.sql("SELECT geo_distance_m(:a, :b, :c, :d) AS m", args=dict(zip("abcd", map(float, p)))).first().m
    assert metres(77.2090, 28.6139, 72.8777, 19.0760) == pytest.approx(1_148_000, rel=0.01)
    assert metres(88.3639, 22.5726, 80.2707, 13.0827) == pytest.approx(1_366_000, rel=0.01)
    assert 110_000 < metres(0, 0, 1, 0) < 112_000 and 55_000 < metres(0, 60, 1, 60) < 56_500
    assert abs(metres(68, 20, 68, 21) - metres(97, 20, 97, 21)) < 1e-6
    assert metres(5, 5, 5, 5) == 0.0
    rng = random.Random(6)
    pairs = [(rng.uniform(-180, 180), rng.uniform(-80, 80)) for _ in range(100)]
    pairs = [(x, y, x + rng.uniform(-1, 1) * w, max(-85.0, min(85.0, y + rng.uniform(-1, 1) * w))) for (x, y), w in zip(pairs, [0.001, 0.1, 5, 40] * 25)]
    spark.createDataFrame(pairs, "a double, b double, c double, d double").createOrReplaceTempView("pairs")
    for r in spark.sql("SELECT *, geo_distance_m(a, b, c, d) AS m, geo_distance_geom_m(geo_point(a, b), geo_point(c, d)) AS g FROM pairs").collect():
        assert r.m == pytest.approx(vincenty(r.a, r.b, r.c, r.d), rel=5e-5, abs=1e-3) and r.m == r.g
        assert geo_short(spark, r) if abs(r.a - r.c) < 0.001 else True
    area = lambda w: spark.sql("SELECT geo_area_km2(:w) AS a", args={"w": w}).first().a
    assert 12_200 < area("POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))") < 12_400
    assert 11_000 < area("POLYGON((92 23, 93 23, 93 24, 92 24, 92 23))") < 12_000
    parts = ["POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON((10 10, 12 10, 12 12, 10 12, 10 10))"]
    assert area(HOLED) == pytest.approx(area(parts[0]) - area(parts[1]) + area(parts[2]), rel=1e-12)
    e = geo.wkt_edges(spark.createDataFrame([(1, HOLED)], "i long, w string"), "i", "w")
    assert e.agg(F.sum(geo.edge_area_km2(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))).first()[0] == pytest.approx(area(HOLED), rel=1e-12)
    p = spark.sql("SELECT geo_point(77.2090, 28.6139) AS p").first().p
    assert (p.x, p.y) == (77.2090, 28.6139)
    hostile = spark.sql("SELECT count(*) AS n FROM pairs WHERE cast(a AS STRING) = :v", args={"v": "1' OR '1'='1"}).first().n
    assert hostile == 0  # a bound value is never SQL


def geo_short(spark, r):
    m = spark.range(1).select(geo.distance_m(*(F.lit(v) for v in (r.a, r.b, r.c, r.d)))).first()[0]
    return m == pytest.approx(vincenty(r.a, r.b, r.c, r.d), rel=1e-4, abs=1e-3)


def test_probes_fill_their_quota_by_area_whatever_the_partitions(spark):
    thin = "POLYGON((20 0, 30 0, 30 10, 20 10, 20 0),(20.5 0.5, 29.5 0.5, 29.5 9.5, 20.5 9.5, 20.5 0.5))"
    edges = geo.wkt_edges(spark.createDataFrame([(1, HOLED), (2, thin)], "i long, w string"), "i", "w")
    got = {parts: sorted(map(tuple, sampling.probes(edges.repartition(parts), 300, "s").collect())) for parts in (1, 8)}
    assert got[1] == got[8]
    assert Counter(r[0] for r in got[1]) == {1: 300, 2: 300} and sorted(r[1] for r in got[1] if r[0] == 2) == list(range(300))
    ok = spatial.inside(spark.createDataFrame([(i, r[2], r[3], r[0]) for i, r in enumerate(got[1])], "id long, lon double, lat double, own long"), edges, 1.0)
    assert {r.id for r in ok.collect()} == set(range(600))
    small = sum(r[0] == 1 and r[2] > 5 for r in got[1]) / 300  # the part of 4 of some 19 square degrees
    assert abs(small - 4 / 19) < 0.08
    with pytest.raises(ValueError, match="without 300 points after 1 rounds"):
        sampling.probes(edges, 300, "s", rounds=1)


def test_replace_keeps_the_old_rows_until_the_swap(spark):
    named.replace_table(spark.range(3), "swap_me")
    before = spark.table("swap_me")
    assert before.count() == 3
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        named.replace_table(broken, "swap_me")
    assert spark.table("swap_me").count() == 3
    assert len(named.versions(spark, "swap_me")) == 1
    named.replace_table(spark.range(5).withColumn("more", F.lit(1)), "swap_me")
    assert spark.table("swap_me").count() == 5 and before.count() == 3  # the version before stays for its readers
    named.replace_table(spark.table("swap_me").where("id > 2"), "swap_me")
    assert spark.table("swap_me").count() == 2 and len(named.versions(spark, "swap_me")) == 2
    columns = {(r.table, r.column) for r in named.listing(spark, "default").collect()}
    assert ("swap_me", "more") in columns and not any("__v" in t for t, _ in columns)


def test_expectations_fail_the_write_in_one_job(spark, tmp_path):
    share = F.sum((F.col("kind") == "a").cast("long")) / F.count(F.lit(1))
    rules = {"share of a": (share, lambda m: m <= 0.6), "rows": (F.count(F.lit(1)), lambda m: m >= 4)}
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frame = lambda kinds: spark.createDataFrame([(k,) for k in kinds], "kind string").mapInArrow(counted, "kind string")
    assert named.replace_table(frame("aabbc"), "expected_rows", rules) == {"share of a": 0.4, "rows": 5}
    assert seen.value == 5  # the rows were made once
    for kinds, told in (("aaab", "share of a: 0.75"), ("abc", "rows: 3"), ("", "share of a: None; rows: 0")):
        with pytest.raises(named.ExpectationError, match=told):
            named.replace_table(frame(kinds), "expected_rows", rules)
        assert spark.table("expected_rows").count() == 5
    spark.range(4).write.parquet(str(tmp_path / "t.parquet"))
    named.attach(spark, str(tmp_path), "attached", ["t"])
    assert spark.table("attached.t").count() == 4
    with pytest.raises(Exception, match="(?i)view"):
        spark.sql("INSERT INTO attached.t VALUES (1)")
    named.temp_rows(spark, "from_driver", [(1, "x"), (2, None)], "i int, s string")
    assert spark.sql("SELECT count(s) AS n FROM from_driver").first().n == 1


SHAPE = {"id": "integer", "name": "string", "score?": ("number", None), "tags": [{"k": {"x", "y"}, "v?": "boolean"}]}
GOOD = {"id": 1, "name": "a", "score": None, "tags": [{"k": "x", "v": True}, {"k": "y"}]}


def test_typed_json(spark):
    cases = {
        json.dumps(GOOD): [], json.dumps(GOOD | {"score": 1.5, "tags": []}): [], json.dumps({k: v for k, v in GOOD.items() if k != "score"}): [],
        json.dumps(GOOD | {"id": "1"}): ["$.id: expected integer, found string"], json.dumps(GOOD | {"id": 1.5}): ["$.id: expected integer, found number"], json.dumps(GOOD | {"extra": 1}): ["$.extra: unknown key"],
        json.dumps({k: v for k, v in GOOD.items() if k != "name"}): ["$.name: missing"], json.dumps(GOOD | {"name": None}): ["$.name: expected string, found null"],
        json.dumps(GOOD | {"tags": [{"k": "x"}, {"k": "z"}, {"v": 1, "w": 0}]}): ["$.tags[1].k: expected one of x, y", "$.tags[2].w: unknown key", "$.tags[2].k: missing", "$.tags[2].v: expected boolean, found integer"],
        json.dumps(GOOD | {"tags": {}}): ["$.tags: expected array, found object"], "[]": ["$: expected object, found array"], "3": ["$: expected object, found integer"],
        "": ["$: not JSON"], "{": ["$: not JSON"], json.dumps(GOOD) + "}": ["$: not JSON"], json.dumps(GOOD) + ",": ["$: not JSON"], "1],[2": ["$: not JSON"], '1},{"a":2': ["$: not JSON"], '{"id":1,"id":2}': ["$: not JSON"],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "i int, doc string")
    got = {r.doc: r.faults for r in strict_json.checked(rows, "doc", SHAPE).collect()}
    assert got.pop(None) == ["$: not JSON"]
    for text, expected in cases.items():
        assert got[text] == expected, text
    good = rows.where("i in (0, 1, 2)")
    assert sorted(map(tuple, strict_json.strict(good, "doc", SHAPE).collect())) == sorted(map(tuple, good.collect()))
    with pytest.raises(Exception, match=r"not of the shape: \$\.id: expected integer, found string"):
        strict_json.strict(rows.where("i = 3"), "doc", SHAPE).collect()


def test_whitelist_refuses_what_it_must(spark):
    from skygrid.functions import matrix

    rows = spark.createDataFrame([(1, 2.0, None, 3.0)], "id int, a double, b double, lat double")
    assert matrix.whitelisted(rows, ["id"], ["b", "a"], ["label"], ["lat"]).columns == ["id", "b", "a"]
    for features, told in ((["a", "lat"], "lat tells the place"), (["a", "a"], "a is named twice"), (["a", "zz"], "no column zz")):
        with pytest.raises(ValueError, match=told):
            matrix.whitelisted(rows, ["id"], features, ["label"], ["lat"])
    with pytest.raises(ValueError, match="a defines the label"):
        matrix.whitelisted(rows, [], ["a"], ["a"], [])
    seen = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    assert [r[0] for r in seen.select(matrix.observed(["a", "b"])).collect()] == [True, False, False]


def test_summary_of_clusters(spark):
    from skygrid.operators import cluster

    rows = [(1, 80.0, 20.0, "B", 3, True, None), (1, 80.2, 20.0, "A", 9, False, 400.0), (1, 80.1, 20.3, None, 1, True, 900.0), (2, 70.0, 10.0, None, 0, False, None), (2, 70.0, 10.0, None, 0, False, None), (3, 1.0, 1.0, "C", 1, True, 1.0)]
    got = cluster.summary(spark.createDataFrame(rows, "cluster int, lon double, lat double, state string, priors int, night boolean, asset_m double"), 2, 500).collect()
    spread = round(geo.R * max(math.hypot(math.radians(x - 80.1), math.radians(y - 20.1)) for x, y in ((80.0, 20.0), (80.2, 20.0), (80.1, 20.3))))
    assert [tuple(r) for r in got] == [(1, 80.1, 20.1, "A", 3, 9, 0.667, 400, True, spread), (2, 70.0, 10.0, None, 2, 0, 0.0, None, False, 0)]


def test_first_row_of_a_sheet_wins(spark):
    from skygrid.sources import tables

    sheet = spark.createDataFrame([("k1 ", "operating", 7), ("k1", "retired", 2), ("k2", None, 1), ("k2", "later", 5)], "k string, s string, line int")
    got = tables.first_row_status(spark.createDataFrame([("k1",), (" k2",), ("k3",)], "id string"), "id", sheet, "k", "s", "line")
    assert {r.id: r.status for r in got.collect()} == {"k1": "retired", " k2": "", "k3": ""}


def test_rows_without_a_line_come_last_and_number_keys_meet(spark):
    from skygrid.sources import tables

    sheet = spark.createDataFrame([(1.0, "late", None), (1.0, "first", 4), (1.0, "second", 9), (2.0, "only", None)], "k double, s string, line int")
    got = tables.first_row_status(spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long"), "id", sheet, "k", "s", "line")
    assert {r.id: r.status for r in got.collect()} == {1: "first", 2: "only", 3: "", None: ""}


def test_release_is_in_order(spark, tmp_path):
    from skygrid.sources import tables

    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("t"), "id")
    tables.write_release(rows, str(tmp_path / "o"), "csv", ["t", "id"])
    read = [int(r.t) for f in sorted((tmp_path / "o").glob("part*")) for r in spark.read.csv(str(f), header=True).collect()]
    assert read == list(range(500))


def test_exposure_on_the_conic(spark):
    square = lambda i, g, x: [(i, g, x, 20.0, x + 1, 20.0), (i, g, x + 1, 20.0, x + 1, 21.0), (i, g, x + 1, 21.0, x, 21.0), (i, g, x, 21.0, x, 20.0)]
    edges = spark.createDataFrame(square(1, 0, 80.0) + square(2, 1, 81.5), "poly_id long, grp int, x1 double, y1 double, x2 double, y2 double")
    pts = [(1, 0, 80.9, 20.5), (2, 0, 80.1, 20.5), (3, 1, 80.5, 20.5), (4, 1, 82.0, 20.5)]
    got = {r.id: r.metres for r in spatial.other_group_m(spark.createDataFrame(pts, "id long, grp int, lon double, lat double"), edges, 90_000).collect()}
    assert got[1] == pytest.approx(vincenty(80.9, 20.5, 81.5, 20.5), rel=0.02)
    assert got[2] is None and got[3] == 0.0
    assert got[4] == pytest.approx(vincenty(82.0, 20.5, 81.0, 20.5), rel=0.02) if got[4] else got[4] is None
