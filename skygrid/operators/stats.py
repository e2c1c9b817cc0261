"""Statistics over groups: circular, contingency, quantiles, votes, coverage, classification, conformal."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.sources.scratch import written


def circular(rows: DataFrame, key: str, hour: Column) -> DataFrame:
    """Per key: circular mean hour (24 h) and resultants of the angle and of the doubled angle."""
    a = hour * F.lit(2 * math.pi / 24)
    s = rows.groupBy(key).agg(F.sum(F.sin(a)).alias("s"), F.sum(F.cos(a)).alias("c"), F.sum(F.sin(2 * a)).alias("s2"), F.sum(F.cos(2 * a)).alias("c2"), F.count(hour).alias("n"))
    mean = F.pmod(F.degrees(F.atan2("s", "c")) / 15.0, F.lit(24.0))
    return s.select(key, "n", mean.alias("mean_hour"), (F.hypot("s", "c") / F.col("n")).alias("resultant"), (F.hypot("s2", "c2") / F.col("n")).alias("axial"))


def ring_distance(a: Column, b: Column, period: float = 24.0) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(period) - d)


def widest_gap(rows: DataFrame, key: str, hour: Column, period: float = 24.0) -> DataFrame:
    """Per key the widest gap between distinct observed hours on the ring, and where it starts."""
    h = rows.select(key, hour.alias("_h")).where("_h is not null").distinct()
    w = Window.partitionBy(key)
    after = F.coalesce(F.lead("_h").over(w.orderBy("_h")), F.min("_h").over(w) + F.lit(period)) - F.col("_h")
    return h.withColumn("gap", after).groupBy(key).agg(F.min(F.struct((-F.col("gap")).alias("g"), F.col("_h").alias("h"))).alias("m")).select(key, (-F.col("m.g")).alias("gap"), F.col("m.h").alias("from_hour"))


def cramers_v(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, chi2, v) of the contingency table of two columns; cells that do not occur count."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    row, col = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    # chi2 = n (sum o^2 / (r c) - 1): cells without rows add nothing, so the full grid is not needed
    part = cells.join(row, a).join(col, b).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("q"), F.sum("o").alias("n"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    return part.select("n", (F.col("n") * (F.col("q") - 1)).alias("chi2"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") - 1) / F.nullif(F.least("ka", "kb") - 1, F.lit(0))).alias("v"))


#: Rows that a range of values is meant to hold, and ranges at most; beyond RANGE * RANGES rows the ranges grow.
RANGE, RANGES = 1_000_000, 4_096


def ranged(counts: DataFrame, by: str) -> DataFrame:
    """counts, written once, with ``_part``: the number of its range of ``by``. Ranges ascend, equal values are in one.

    A table of up to RANGE rows is one range; a larger one is dealt by sampled bounds and written in that order.
    """
    counts = written(counts)
    parts = min(RANGES, -(-counts.count() // RANGE))
    if parts <= 1:
        return counts.withColumn("_part", F.lit(0))
    return written(counts.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()))


def running(cut: DataFrame, keys: list[str], by: str, amounts: dict[str, str]) -> DataFrame:
    """cut (of ``ranged``) with running sums {name: column} in the order of ``by``, per keys (none: over all rows).

    A range sums its own rows, and sums of the ranges give each its base, so no task holds a whole key.
    Equal values of ``by`` share their sums; null keys are a key.
    """
    own = [*keys, "_part"]
    sums = cut.groupBy(*own).agg(*(F.sum(c).alias(f"_s_{name}") for name, c in amounts.items()))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*(F.col(k).alias(f"_k_{k}") for k in own), *(F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in amounts))
    within = Window.partitionBy(*own).orderBy(by)  # RANGE: peers count
    here = cut.select("*", *(F.sum(c).over(within).alias(f"_i_{name}") for name, c in amounts.items()))
    at = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in own]
    return here.join(base, at).select(*(c for c in cut.columns if c != "_part"), *((F.col(f"_i_{name}") + F.col(f"_b_{name}")).alias(name) for name in amounts))


def quantiles(rows: DataFrame, key: str, value: str, picks: dict) -> DataFrame:
    """Per key the values at ranks (from 0) that ``picks`` name as functions of the count; between two ranks, linear.

    It works on counts of distinct values, written once, so a value that very many rows share is one row.
    """
    cut = ranged(rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c")), value)
    n = cut.groupBy(F.col(key).alias("_key")).agg(F.sum("_c").alias("_n"))
    run = running(cut, [key], value, {"upto": "_c"}).join(n, F.col(key).eqNullSafe(F.col("_key")))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col(value)))
    ranks = {c: f(F.col("_n")).cast("double") for c, f in picks.items()}
    found = run.groupBy(key, "_n").agg(*(x for c, r in ranks.items() for x in (at(F.floor(r)).alias(f"_l_{c}"), at(F.ceil(r)).alias(f"_h_{c}"))))
    part = lambda c, r: F.col(f"_l_{c}") + (F.col(f"_h_{c}") - F.col(f"_l_{c}")) * (r - F.floor(r))
    return found.select(key, *(part(c, r).alias(c) for c, r in ranks.items()))


def vote(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Per key the commonest label, the smallest if tied, from counts (never from lists)."""
    n = rows.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("b")).select(key, F.col("b.l").alias(label), (-F.col("b.m")).alias("votes"))


def greedy_coverage(sizes: DataFrame, key: str, n: str, shares: list[float]) -> DataFrame:
    """Fewest keys whose n reach each share of the total, from the number of keys of each size."""
    by = ranged(sizes.groupBy((-F.col(n)).alias("_by")).agg(F.count(key).alias("_keys"), F.sum(n).alias("_sum")), "_by")
    total = by.agg(F.sum("_sum")).first()[0] or 0
    run = running(by, [], "_by", {"upto": "_sum", "_upto_keys": "_keys"})
    need = lambda x: F.lit(x * total - 1e-12 * total)
    # of the size that reaches the share, as many keys as still lack
    keys = lambda x: F.min(F.when(F.col("upto") >= need(x), F.col("_upto_keys") - F.col("_keys") + F.greatest(F.lit(1), F.ceil((need(x) - F.col("upto") + F.col("_sum")) / -F.col("_by")))))
    wide = run.agg(*(keys(x).cast("int").alias(f"s{i}") for i, x in enumerate(shares)))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("share"), F.col(f"s{i}").alias("keys")) for i, x in enumerate(shares)))).alias("r")
    return wide.select(rows).select("r.share", "r.keys")


def classification(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class: support, precision, recall, f1; zero where a denominator is zero."""
    cells = rows.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    k = F.explode(F.array_distinct(F.array(truth, guess)))
    each = cells.withColumn("label", k).groupBy("label").agg(
        F.sum(F.when((F.col(truth) == F.col("label")) & (F.col(guess) == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col(truth) == F.col("label"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col(guess) == F.col("label"), F.col("n")).otherwise(0)).alias("guessed"),
    )
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return each.select("label", "support", zero(F.col("tp"), F.col("guessed")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), F.col("support") + F.col("guessed")).alias("f1"))


def average_precision(rows: DataFrame, positive: Column, score: Column) -> DataFrame:
    """One row: sum of precision times the step in recall over distinct scores, from counts by score."""
    by = rows.groupBy((-score).alias("s")).agg(F.count_if(positive).alias("p"), F.count(F.lit(1)).alias("n"))
    run = running(ranged(by, "s"), [], "s", {"tp": "p", "k": "n"})
    return run.agg((F.sum(F.col("p") * F.col("tp") / F.col("k")) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def conformal(scores: DataFrame, calibration: Column, nonconformity: str, alpha: float) -> DataFrame:
    """One row: n, level, threshold (interpolated quantile) of calibration rows, coverage of the others."""
    own = scores.where(calibration)
    n = own.count()
    level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n) if n else 1.0
    cut = quantiles(own.withColumn("n", F.lit(n).cast("long")), "n", nonconformity, {"threshold": lambda m: F.lit(level) * (m - 1)})
    rest = scores.where(~calibration).join(F.broadcast(cut))
    return rest.groupBy("n", "threshold").agg(F.lit(level).alias("level"), F.avg((F.col(nonconformity) <= F.col("threshold")).cast("double")).alias("coverage"))


def _table_v(table: np.ndarray) -> float:
    """Cramer's V of a table of counts."""
    r, c, n = table.sum(1, keepdims=True), table.sum(0, keepdims=True), table.sum()
    small = min(table.shape) - 1
    return math.sqrt(max(0.0, float((table * table / (r * c)).sum()) - 1) / small) if small > 0 and n else 0.0


#: Categories of a column, and cells of their table, that a draw from the margins may have.
CATEGORIES, CELLS = 100_000, 4_000_000


def permutation_null(rows: DataFrame, a: str, b: str, times: int, seed: int = 17) -> DataFrame:
    """One row: v of the columns, and mean, sd, max of v over ``times`` shuffles of one against the other; z, p = (k + 1) / (times + 1).

    A shuffle keeps both margins, so its table is a draw from the margins (hypergeometric row by row): a
    draw costs the size of the table of categories, whatever the number of rows. Draws are tasks of their own.
    Margins of more than CATEGORIES categories, or a table of more than CELLS cells, are an error.
    """
    cells = written(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")))
    across, down = ([r.n for r in cells.groupBy(c).agg(F.sum("n").alias("n")).orderBy(c).limit(CATEGORIES + 1).collect()] for c in ("a", "b"))
    if max(len(across), len(down)) > CATEGORIES or len(across) * len(down) > CELLS:
        raise ValueError(f"more than {CATEGORIES} categories or {CELLS} cells")

    def draw(batches):
        for batch in batches:
            vs = []
            for i in batch.column("id").to_pylist():
                rng, left, table = np.random.default_rng((seed, i)), np.array(down, np.int64), []
                for k in across:
                    table.append(rng.multivariate_hypergeometric(left, k, method="marginals"))
                    left = left - table[-1]
                vs.append(_table_v(np.array(table, float).reshape(len(across), len(down))))
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.float64())], ["v"])

    drawn = rows.sparkSession.range(times).mapInArrow(draw, "v double")
    own = cramers_v(rows, a, b).select("n", "v")
    null = drawn.crossJoin(F.broadcast(own.select(F.col("v").alias("_own"))))  # one row
    s = null.agg(F.count("v").alias("draws"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.max("v").alias("max"), F.count_if(F.col("v") >= F.col("_own")).alias("k"))
    return own.crossJoin(s).select("n", "v", "draws", "mean", "sd", "max", ((F.col("v") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("z"), ((F.col("k") + 1) / (F.col("draws") + 1)).alias("p"))
