"""Labels with their evidence, splits by groups, prediction sets, and comparison with a baseline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrid.operators.sampling import ranked
from skygrid.operators.stats import quantiles

#: How far each kind of evidence is trusted.
TRUST = {"flare catalogue": 0.9, "industrial map": 0.7, "asset register": 0.7, "land cover": 0.5}
VEGETATION = ("tree_cover", "shrubland", "grassland")


def evidence(flare_m: Column, industrial_m: Column, asset_m: Column, cover: Column, flare_at: float = 500, industrial_at: float = 1000) -> Column:
    """struct(label, source, rule, confidence) of the first rule that holds; a missing distance never holds."""

    def told(label: str, source: str, rule: str, confidence: float) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(source).alias("source"), F.lit(rule).alias("rule"), F.lit(float(confidence)).alias("confidence"))

    def by(label: str, source: str, rule: str) -> Column:
        return told(label, source, rule, TRUST[source])

    return (
        F.when(flare_m <= flare_at, by("flare", "flare catalogue", f"within {flare_at:.0f} m of a flare"))
        .when(industrial_m <= industrial_at, by("industrial", "industrial map", f"within {industrial_at:.0f} m of an industrial feature"))
        .when(asset_m <= industrial_at, by("industrial", "asset register", f"within {industrial_at:.0f} m of an operating asset"))
        .when(cover == "cropland", by("agricultural", "land cover", "cropland and nothing nearer"))
        .when(cover.isin(*VEGETATION), told("unlabelled", "land cover", "vegetation and nothing nearer", 0.0))
        .otherwise(told("unlabelled", "none", "no rule holds", 0.0))
    )


def mask_split(rows: DataFrame, state: str, group: list[str], near_group: str) -> DataFrame:
    """rows of the test part (state in the group) and the train part (outside of it, and not near it), named in ``part``.

    Rows without a state are in neither. A missing near_group column raises.
    """
    if near_group not in rows.columns:
        raise ValueError(f"no column {near_group}: rows near the group cannot be left out")
    part = F.when(F.col(state).isin(group), "test").when(F.col(state).isNotNull() & ~F.col(near_group), "train")
    return rows.withColumn("part", part).where("part is not null")


def group_faults(members: DataFrame, state: str, group: str) -> DataFrame:
    """(fault, what): states in two groups, and groups without a state."""
    own = members.where(F.col(group).isNotNull())
    two = own.where(F.col(state).isNotNull()).groupBy(state).agg(F.countDistinct(group).alias("n")).where("n > 1").select(F.lit("in two groups").alias("fault"), F.col(state).alias("what"))
    empty = own.groupBy(group).agg(F.count(state).alias("n")).where("n = 0").select(F.lit("empty").alias("fault"), F.col(group).alias("what"))
    return two.unionByName(empty)


def checked_groups(members: DataFrame, state: str, group: str) -> DataFrame:
    """members, or an error that lists up to ten faults."""
    faults = group_faults(members, state, group).limit(10).collect()
    if faults:
        raise ValueError("; ".join(f"{r.fault}: {r.what}" for r in faults))
    return members


def three_way(rows: DataFrame, ident: str, seed: str, shares: tuple[float, float]) -> DataFrame:
    """rows with ``part``: fit, calibrate or test by place in hash order; the first two take their shares, rounded down."""
    n = rows.count()
    a, b = math.floor(shares[0] * n + 1e-9), math.floor((shares[0] + shares[1]) * n + 1e-9)
    placed = ranked(rows.withColumn("_all", F.lit(0)), ident, "_all", seed)
    return placed.withColumn("part", F.when(F.col("_r") <= a, "fit").when(F.col("_r") <= b, "calibrate").otherwise("test")).drop("_all", "_r")


def conformal_sets(rows: DataFrame, posterior: str, truth: str, calibration: Column, alpha: float) -> DataFrame:
    """One row (coverage, size, single, empty) of the sets {class: p >= 1 - threshold} of rows outside the calibration part.

    Classes count from 1. threshold: the interpolated quantile of 1 - p(truth) over the calibration part.
    """
    own = rows.where(calibration).select((1 - F.element_at(posterior, F.col(truth))).alias("a"), F.lit(0).alias("k"))
    n = own.count()
    level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n) if n else 1.0
    cut = quantiles(own, "k", "a", {"t": lambda m: F.lit(level) * (m - 1)}).select("t")
    rest = rows.where(~calibration).crossJoin(F.broadcast(cut))  # one row
    own_set = F.filter(F.transform(posterior, lambda p, i: F.when(p >= 1 - F.col("t"), i + 1)), lambda x: x.isNotNull())
    share = lambda c: F.avg(c.cast("double"))
    s = rest.select(truth, own_set.alias("s"))
    return s.agg(share(F.array_contains("s", F.col(truth))).alias("coverage"), F.avg(F.size("s")).alias("size"), share(F.size("s") == 1).alias("single"), share(F.size("s") == 0).alias("empty"))


def against_baseline(claims: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """claims and the keys of the baseline that they lack, with ``state``: new, gone or same."""
    old = baseline.select(F.col(key).alias("_old")).distinct()
    joined = claims.join(old, F.col(key) == F.col("_old"), "full_outer")
    state = F.when(F.col("_old").isNull(), "new").when(F.col(key).isNull(), "gone").otherwise("same")
    return joined.withColumn("state", state).withColumn(key, F.coalesce(key, "_old")).drop("_old")
