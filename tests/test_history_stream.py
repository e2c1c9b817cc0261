"""The stream's history against the batch operator on the same events."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skygrid.operators import temporal
from skygrid.streaming import history

SCHEMA = "event_id long, user_id long, ts timestamp, value double, night boolean"


def replay(spark, tmp_path, batches, name, days=7, short=2, late="6 hours"):
    """Each batch is a file; one trigger reads one file."""
    source, seen = str(tmp_path / "in"), set()
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").parquet(source)
        for path in set(map(str, (tmp_path / "in").glob("*.parquet"))) - seen:
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read by their times
            seen.add(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = history.recurrence_stream(stream, "event_id", "user_id", "ts", "value", "night", days, short, late)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return {r.id: r for r in spark.table(name).collect()}


def same(got, want):
    for c in ("prior_count", "prior_count_short"):
        assert got[c] == want[c], (got, want)
    for c in ("night_fraction", "value_variance", "mean_gap_days"):
        assert (got[c] is None) == (want[c] is None) and got[c] == (want[c] if want[c] is None else pytest.approx(want[c], abs=1e-6)), (c, got, want)


def test_replay_of_events_equals_the_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = e.select("event_id", (F.col("user_id") % 3).alias("user_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 > 0, (F.hour("ts") < 6)).alias("night"))
    rows = rows.where("event_id % 3 = 0").orderBy("ts").limit(150).cache()
    cuts = [r.ts for r in rows.orderBy("ts").collect()][:: 50]
    batches = [rows.where((F.col("ts") >= a) & ((F.col("ts") < b) if b else F.lit(True))) for a, b in zip(cuts, [*cuts[1:], None])]
    flush = spark.createDataFrame([(-1, 99)], "event_id long, user_id long").select("event_id", "user_id", F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(0.0).alias("value"), F.lit(False).alias("night"))
    got = replay(spark, tmp_path, [*batches, flush], "history_replay")
    want = {r.event_id: r for r in temporal.recurrence(rows, "user_id", F.col("ts"), F.col("value"), F.col("night"), 7, 2).collect()}
    assert set(want) == set(got) - {-1}
    for i, r in want.items():
        same(got[i], r)
    assert any(r.prior_count < 10 and r.prior_count_short for r in want.values())


def test_order_inside_the_delay_does_not_matter_and_later_ones_are_dropped(spark, tmp_path):
    row = lambda i, cell, day, hour: (i, cell, f"2024-01-{day:02d} {hour:02d}:00:00", float(i), True)
    frame = lambda rows: spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double, night boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    batches = [[row(1, 1, 1, 5), row(2, 1, 1, 8)], [row(3, 1, 1, 4)], [row(4, 1, 20, 0)], [row(8, 1, 20, 1)], [row(5, 1, 1, 6)], [row(6, 1, 30, 0)], [row(7, 2, 31, 23)]]
    got = replay(spark, tmp_path, list(map(frame, batches)), "history_late")
    # 3 came within six hours of 2; 5 came 19 days late
    assert {i: got[i].prior_count for i in (1, 2, 3, 4)} == {3: 0, 1: 1, 2: 2, 4: 0}
    assert 5 not in got
    assert got[2].mean_gap_days == pytest.approx(1 / 24)
    assert got[4].mean_gap_days == pytest.approx(2 / 24)  # (8 h - 4 h) over two gaps, long after the frame was cleared
    assert got[6].prior_count == 0 and got[6].mean_gap_days == pytest.approx((19 * 24 + 1 - 4) / 24 / 4)


def test_features_by_hand():
    day = history.DAY
    rng = random.Random(1)
    ev = pd.DataFrame({"id": range(60), "at_us": sorted(rng.randint(0, 30) * day // 2 for _ in range(60)), "value": [rng.choice([None, 1.5, 2.0, 9.0]) for _ in range(60)], "night": [rng.choice([None, True, False]) for _ in range(60)]})
    cut = 30
    old = history.instant_sums(ev[ev.at_us < ev.at_us[cut]])
    new = ev[ev.at_us >= ev.at_us[cut]]
    before = ev[ev.at_us < ev.at_us[cut]]
    got = history.features(new.at_us.to_numpy(), old | history.instant_sums(new), (len(before), int(before.at_us.min()), int(before.at_us.max())), 7, 2)
    for i, (_, r) in enumerate(new.iterrows()):
        prior = ev[(ev.at_us < r.at_us) & (ev.at_us >= r.at_us - 7 * day)]
        assert got.prior_count[i] == len(prior)
        values = prior.value.dropna().astype(float)
        assert got.value_variance[i] == pytest.approx(values.var(ddof=0)) if len(values) >= 2 else got.value_variance.isna()[i]
        ever = ev[ev.at_us < r.at_us].at_us
        assert got.mean_gap_days[i] == pytest.approx((ever.max() - ever.min()) / day / (len(ever) - 1))
