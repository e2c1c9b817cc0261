"""Time-ordered analytics: strictly-before history, gaps, runs, nearest in time.

History is a RANGE frame on integer microseconds that ends one before the row, so rows of one instant
never see each other. Frames need a cell's rows in order: one shuffle by cell. A cell that holds
very many rows streams through its task; frames keep only what they span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def recurrence(rows: DataFrame, cell: str, at: Column, value: Column, night: Column, days: int, short: int) -> DataFrame:
    """rows with the strictly-before features of their cell: counts, night share, variance, mean gap."""
    base = rows.withColumn("_us", micros(at))
    w = Window.partitionBy(cell).orderBy("_us")
    recent, brief, ever = w.rangeBetween(-days * DAY, -1), w.rangeBetween(-short * DAY, -1), w.rangeBetween(Window.unboundedPreceding, -1)
    n = F.count(F.lit(1)).over(ever)
    values = F.count(value).over(recent)
    return base.withColumns({
        "prior_count": F.count(F.lit(1)).over(recent), "prior_count_short": F.count(F.lit(1)).over(brief), "night_fraction": F.avg(night.cast("double")).over(recent),
        "value_variance": F.when(values >= 2, F.var_pop(value).over(recent)), "mean_gap_days": F.when(n >= 2, (F.max("_us").over(ever) - F.min("_us").over(ever)) / F.lit(float(DAY)) / (n - 1)),
    }).drop("_us")


def returned(rows: DataFrame, cell: str, at: Column, lag_days: int, slack_days: int) -> DataFrame:
    """rows with whether the cell had an event about ``lag_days`` before."""
    w = Window.partitionBy(cell).orderBy("_us").rangeBetween(-(lag_days + slack_days) * DAY, -(lag_days - slack_days) * DAY)
    return rows.withColumn("_us", micros(at)).withColumn("returned", F.count(F.lit(1)).over(w) > 0).drop("_us")


def gaps(rows: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Gaps in days between successive events of a key, those above zero."""
    w = Window.partitionBy(*keys).orderBy("_us")
    return rows.withColumn("_us", micros(at)).withColumn("gap_days", (F.col("_us") - F.lag("_us").over(w)) / F.lit(float(DAY))).where("gap_days > 0").select(*keys, "gap_days")


def active_runs(rows: DataFrame, key: str, day: Column) -> DataFrame:
    """Runs of consecutive active days: (key, start, days, quiet_before)."""
    days = rows.select(key, day.alias("_d")).distinct()
    w = Window.partitionBy(key).orderBy("_d")
    marked = days.withColumn("_gap", F.datediff("_d", F.lag("_d").over(w))).withColumn("_run", F.sum(F.when(F.col("_gap") == 1, 0).otherwise(1)).over(w))
    return marked.groupBy(key, "_run").agg(F.min("_d").alias("start"), F.count(F.lit(1)).alias("days"), F.max(F.when(F.col("_gap") > 1, F.col("_gap") - 1)).alias("quiet_before")).drop("_run")


def asof_nearest(left: DataFrame, right: DataFrame, tolerance_s: int) -> DataFrame:
    """Each left (id, at) with the right (ref_id, rat) nearest in time within the tolerance, the earlier and smaller if tied.

    Both sides are dealt into bins of the tolerance's width and sorted by time; the nearest ones before and
    after come with running frames in the bin, or are the last and first of the bins beside it. Every row is in one bin, so work
    is linear however many rows share one. A left row without a time has no match.
    """
    width = tolerance_s * 1_000_000
    refs = right.where("rat is not null").groupBy(micros(F.col("rat")).alias("_us")).agg(F.min("ref_id").alias("ref_id")).withColumn("_own", F.lit(False))
    refs = refs.withColumn("_r", F.struct("_us", "ref_id"))
    rows = left.select("id", micros(F.col("at")).alias("_us")).withColumn("_own", F.lit(True))
    both = rows.where("_us is not null").unionByName(refs.drop("ref_id"), allowMissingColumns=True).withColumn("_b", F.floor(F.col("_us") / width))
    near = lambda *order: F.last("_r", ignorenulls=True).over(Window.partitionBy("_b").orderBy(*order, "_own").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_before", near(F.col("_us").asc())).withColumn("_after", near(F.col("_us").desc())).where("_own")
    ends = refs.groupBy(F.floor(F.col("_us") / width).alias("_b")).agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    found = found.join(ends.select((F.col("_b") + 1).alias("_b"), "_last"), "_b", "left").join(ends.select((F.col("_b") - 1).alias("_b"), "_first"), "_b", "left")
    one = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_us") - F.col(f"{c}._us")).alias("gap"), F.col(f"{c}._us").alias("us"), F.col(f"{c}.ref_id").alias("ref_id")))
    best = F.least(*map(one, ("_before", "_after", "_last", "_first")))
    kept = found.withColumn("_m", best).withColumn("_m", F.when(F.col("_m.gap") <= width, F.col("_m"))).select("id", F.col("_m.ref_id").alias("ref_id"), (F.col("_m.gap") / 1e6).alias("gap_s"))
    return kept.unionByName(rows.where("_us is null").select("id"), allowMissingColumns=True)


def day_gaps(rows: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """Days between successive active days of a key: (keys, gap)."""
    days = rows.select(*keys, day.alias("_d")).distinct()
    return days.withColumn("gap", F.datediff("_d", F.lag("_d").over(Window.partitionBy(*keys).orderBy("_d")))).where("gap is not null").select(*keys, "gap")
