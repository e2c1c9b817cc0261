"""Every query with oracle SQL against DuckDB on the small data; the others run and keep their invariants."""

import glob
import os

import duckdb
import pytest

from skygrid.plans import catalog, evidence, models, places  # noqa: F401  the last three add queries to the catalog

DATA = "/root/testdata/sf0.001"


def frame(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        df[c] = df[c].map(lambda v: "" if v is None or v != v else (f"{float(v):.6f}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)[:19].removesuffix(" 00:00:00")))
    out = sorted(map(tuple, df.values.tolist()))
    return list(df.columns), out


def same(a, b):
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) <= 2e-6 * max(1, abs(float(a)))
    except ValueError:
        return False


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    columns, rows = frame(catalog.queries()[name](spark, DATA).toPandas())
    wanted, expected = frame(duck.execute(catalog.oracle_sql()[name]).df())
    assert columns == wanted and len(rows) == len(expected)
    bad = [(r, e) for r, e in zip(rows, expected, strict=True) if not all(map(same, r, e))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_permutation_null_against_shuffles(spark, monkeypatch):
    import random
    import statistics

    import numpy as np

    from skygrid.operators import stats

    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice(range(5))) for _ in range(400)]
    got = stats.permutation_null(spark.createDataFrame(rows, "x string, y int"), "x", "y", 300).first()
    a, b = [x for x, _ in rows], [y for _, y in rows]

    def v(a, b):
        table = np.zeros((3, 5))
        for x, y in zip(a, b, strict=True):
            table["abc".index(x), y] += 1
        return stats._table_v(table)

    draws = []
    for _ in range(300):
        rng.shuffle(b)
        draws.append(v(a, b))
    assert got.draws == 300 and got.n == 400 and got.v == pytest.approx(v([x for x, _ in rows], [y for _, y in rows]))
    assert got["mean"] == pytest.approx(statistics.mean(draws), rel=0.1) and got.sd == pytest.approx(statistics.pstdev(draws), rel=0.25)
    assert got.z == pytest.approx((got.v - got["mean"]) / got.sd) and 1 / 301 <= got.p <= 1
    monkeypatch.setattr(stats, "CATEGORIES", 4)
    with pytest.raises(ValueError, match="more than 4 categories"):
        stats.permutation_null(spark.createDataFrame(rows, "x string, y int"), "x", "y", 300)


def test_names_of_granules_and_finite_numbers(spark):
    from pyspark.sql import functions as F

    from skygrid.sources import tables

    good = spark.createDataFrame([("3SIMG_02NOV2024_0741_L1B.h5",), ("other",)], "f string")
    assert [str(r[0]) for r in good.select(tables.granule_instant(F.col("f"))).collect()] == ["2024-11-02 07:41:00", "None"]
    with pytest.raises(Exception, match="no such date"):
        spark.createDataFrame([("3SIMG_02ANF2024_0741_L1B.h5",)], "f string").select(tables.granule_instant(F.col("f"))).collect()
    nested = "a array<struct<x: float>>, m map<string, double>, s struct<y: array<double>>, n int"
    assert tables.finite(spark.createDataFrame([([(1.0,)], {"k": 1.0}, ([2.0, None],), 1), (None, None, None, None)], nested)).count() == 2
    for bad in (([(float("nan"),)], {}, ([],), 1), ([], {"k": float("inf")}, ([],), 1), ([], {}, ([float("-inf")],), 1)):
        with pytest.raises(Exception, match="not a finite number"):
            tables.finite(spark.createDataFrame([bad], nested)).collect()


def test_bad_input_raises_where_asked(spark):
    from pyspark.sql import functions as F

    from skygrid.functions import scalars
    from skygrid.operators import labels

    rows = spark.createDataFrame([("0745", "85", "operating"), (None, None, None)], "t string, c string, s string")
    band = scalars.strict(scalars.confidence_band(F.col("c")), F.col("c"), "confidence")
    time = scalars.strict(scalars.acquisition_instant(F.lit("2024-01-01"), F.col("t")), F.col("t"), "time")
    got = rows.select(band.alias("b"), time.cast("string").alias("t"), scalars.in_use(F.col("s")).alias("u")).collect()
    assert [tuple(r) for r in got] == [("high", "2024-01-01 07:45:00", True), (None, None, None)]
    for bad, what in ((("2460", "8", "retired"), "not a time"), (("0001", "101", "retired"), "not a confidence"), (("0001", "8", "sold"), "not a known status")):
        with pytest.raises(Exception, match=what):
            spark.createDataFrame([bad], rows.schema).select(band, time, scalars.in_use(F.col("s"))).collect()
    groups = spark.createDataFrame([("x", "a"), ("x", "b"), (None, "c")], "state string, grp string")
    with pytest.raises(ValueError, match="in two groups: x"):
        labels.checked_groups(groups, "state", "grp")
    assert labels.checked_groups(groups.where("grp = 'a'"), "state", "grp").count() == 1
    with pytest.raises(ValueError, match="no column near"):
        labels.mask_split(groups, "state", ["x"], "near")


def test_conic_at_its_origin(spark):
    from pyspark.sql import functions as F

    from skygrid.functions import geo

    x, y = geo.conic(F.lit(80.0), F.lit(24.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == pytest.approx((4_000_000.0, 4_000_000.0), abs=1e-3)


def test_sources_and_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from skygrid.sources import tables
    from skygrid.streaming import events

    head = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight"
    (tmp_path / "v.csv").write_text(head + "\n20.5,72.25,330.1,0.4,0.4,2024-11-02,2000,N,VIIRS,n,MADE_UP,290.0,3.5,N\n,1,1,1,1,2024-11-02,138,N,VIIRS,h,MADE_UP,1,1,D\n")
    got = tables.read_detections(spark, str(tmp_path / "v.csv"), "viirs")
    r = got.select("latitude", "confidence_band", "family", F.col("acq_ts_local").cast("string").alias("at"), tables.detection_id("instrument", "satellite", "longitude", "latitude", F.col("acq_ts_utc").cast("string")).alias("id")).collect()
    assert [(x.latitude, x.confidence_band, x.family, x["at"], len(x.id)) for x in r] == [(20.5, "nominal", "viirs", "2024-11-03 01:30:00", 32)]
    with pytest.raises(Exception, match="fixture rows"):
        tables.read_detections(spark, str(tmp_path / "v.csv"), "viirs", "MADE_UP").collect()
    with pytest.raises(ValueError, match="brightness"):
        tables.read_detections(spark, str(tmp_path / "v.csv"), "modis")
    for kind in ("parquet", "csv", "json"):
        tables.write_release(got.select("latitude", "confidence"), str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == spark.read.json(str(tmp_path / "json")).count() == 1
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["confidence"] == "n"
    spark.createDataFrame([(1, "2024-01-01 00:05:00", "a"), (1, "2024-01-01 00:06:00", "a"), (2, "2024-01-01 00:40:00", "b")], "k int, s string, kind string").select("k", "kind", F.to_timestamp("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k int, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, rows, mode in (("first_of_key", events.first_arrivals(stream(), "k", "ts"), "append"), ("slots", events.slot_counts(stream(), "ts", "kind"), "complete")):
        q = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / ("c" + name))).start()
        q.awaitTermination(60)
    assert sorted(r.k for r in spark.table("first_of_key").collect()) == [1, 2]
    assert sorted((str(r.slot_start), r.kind, r.n) for r in spark.table("slots").collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:30:00", "b", 1)]
