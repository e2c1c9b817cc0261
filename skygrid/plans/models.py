"""Queries that fit models: boosted trees with blocked evaluation, the block ablation, and the logistic probe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.operators import boosting, probe
from skygrid.plans.catalog import query, rounded

CLASSES = ["flare", "industrial", "agricultural"]
FEATURES = ["quantity", "discount", "tax", "unit_price", "month", "lag_days"]
DEFINING = ["flare_m", "industrial_m"]
NEAR = {f"group_{g}": f"near_{g}" for g in "abc"}
#: Few rounds of shallow trees; the operator's own defaults are 200 rounds of depth 6.
SMALL = {"rounds": 4, "depth": 3, "rate": 0.3, "bins": 16, "store_every": 4}


def detections(t) -> DataFrame:
    """Order lines as rows with missing values, a label that three distances define with some noise, and groups of nations."""
    noise = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(100))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    flare_m, industrial_m = 1500 - 40 * F.col("l_quantity") + 10 * noise, 2000 - F.col("l_discount") * 20000 + 10 * noise
    block = F.pmod("c_nationkey", F.lit(5))
    group = F.element_at(F.array(*map(F.lit, ("group_a", "group_b", "group_c", "other", "external"))), block + 1)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    near = {f"near_{g}": (F.col("c_custkey") % 7 == i) for i, g in enumerate("abc")}
    rows = rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), group.alias("block"), *(v.alias(k) for k, v in near.items()),
        F.when(F.col("l_orderkey") % 6 > 0, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_partkey") % 9 > 0, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"), price.alias("unit_price"),
        F.month("o_orderdate").alias("month"), F.datediff("l_shipdate", "o_orderdate").alias("lag_days"), flare_m.alias("flare_m"), industrial_m.alias("industrial_m"), F.col("l_suppkey").alias("site"),
    )
    return rows.withColumn("label", F.when(F.col("flare_m") <= 500, "flare").when(F.col("industrial_m") <= 1000, "industrial").otherwise("agricultural"))


@query()
def boosted_blocked_report(t):
    """Held-out groups, the external one, the leak shown, and the capped majority: one fit, one report."""
    out = boosting.blocked_evaluation(detections(t), "id", "block", NEAR, "external", FEATURES, DEFINING, "label", CLASSES, cap=0.4, **SMALL)
    return rounded(out)


@query()
def boosted_block_ablation(t):
    """What the quantity block tells apart: flare rows guessed industrial, with it and without it."""
    return rounded(boosting.block_ablation(detections(t), "id", "block", NEAR, FEATURES, ["quantity", "lag_days"], "label", CLASSES, "flare", "industrial", **SMALL))


@query()
def logistic_probe(t):
    """A probe on vectors of even ids, scored by group on the others; a class of few rows or sites gets a note."""
    v = t("embeddings").select("vec_id", "embedding", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("label"), F.concat(F.lit("g"), (F.col("vec_id") % 10).cast("string")).alias("block"), F.expr("vec_id div 4").alias("site"))
    classes = ["c0", "c1", "c2"]
    fitted = probe.fit(v.where("vec_id % 2 = 0"), "embedding", "label", classes)
    return rounded(probe.with_floors(probe.guesses(v.where("vec_id % 2 = 1"), "embedding", fitted), "block", "label", "guess", "site", classes, least=25))
