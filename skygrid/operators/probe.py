"""Multinomial logistic probe by distributed Newton steps, and scores with support floors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.operators.boosting import softmax


@dataclass(frozen=True)
class Probe:
    classes: tuple[str, ...]
    weights: np.ndarray  # (class, feature), the intercept last


def _inputs(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return np.concatenate([flat.reshape(len(batch), width), np.ones((len(batch), 1))], axis=1)


def partial_sums(batches: Iterable[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's loss, gradient and curvature as (cell, v): cell 0, then the gradient's, then the curvature's by rows."""
    classes, wide = weights.shape
    loss, grad, curve = 0.0, np.zeros((classes, wide)), np.zeros((classes, wide, classes, wide))
    for batch in batches:
        x, y = _inputs(batch, wide - 1), batch.column("y").to_numpy()
        p = softmax(x @ weights.T)
        loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
        grad += (p - (y[:, None] == np.arange(classes))).T @ x
        for a in range(classes):
            for b in range(a, classes):
                part = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
                curve[a, :, b] += part
                if a < b:
                    curve[b, :, a] += part
    values = np.concatenate([[loss], grad.ravel(), curve.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["cell", "v"])


def fit(rows: DataFrame, vector: str, label: str, classes: list[str], strength: float = 1.0, steps: int = 50, tolerance: float = 1e-8) -> Probe:
    """Weights that minimise the summed loss plus half their square over ``strength``; the intercept is free.

    A step is one pass: tasks add up gradient and curvature, of (classes * (features + 1)) ** 2 numbers
    whatever the rows. It is halved while the loss does not fall. Rows without a vector or of no listed class are left out.
    """
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1
    data = rows.where(F.col(vector).isNotNull() & F.col(label).isin(classes)).select(F.col(vector).cast("array<double>").alias("x"), number.alias("y"))
    first = data.select(F.size("x").alias("n")).head()
    if first is None:
        raise ValueError("no rows to fit")
    wide, k = first.n + 1, len(classes)
    free = np.ones((k, wide))
    free[:, -1] = 0
    at = np.zeros((k, wide))

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        got = data.mapInArrow(lambda b: partial_sums(b, w), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(1 + w.size + w.size**2)
        flat[got["cell"].to_numpy()] = got["v"].to_numpy()
        penalty = free / strength
        return flat[0] + 0.5 * float((penalty * w * w).sum()), flat[1 : 1 + w.size] + (penalty * w).ravel(), flat[1 + w.size :].reshape(w.size, w.size) + np.diag(penalty.ravel())

    loss, grad, curve = sums(at)
    for _ in range(steps):
        if np.abs(grad).max() < tolerance * max(1.0, abs(loss)):
            break
        step = np.linalg.lstsq(curve, grad, rcond=1e-12)[0].reshape(k, wide)  # the sum of all intercepts is free: the shortest step
        size = 1.0
        while True:
            new = sums(at - size * step)
            if new[0] <= loss + 1e-12 * abs(loss) or size < 1e-6:
                break
            size /= 2
        at, (loss, grad, curve) = at - size * step, new
    return Probe(tuple(classes), at)


def guesses(rows: DataFrame, vector: str, probe: Probe, name: str = "guess") -> DataFrame:
    """rows with the class of the largest score; no vector, no guess."""
    w = probe.weights
    scores = F.array(*(F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, map(float, w[i, :-1]))), lambda a, b: a * b), F.lit(float(w[i, -1])), lambda s, v: s + v) for i in range(len(w))))
    best = F.element_at(F.array(*map(F.lit, probe.classes)), F.array_position(scores, F.array_max(scores)).cast("int"))
    return rows.withColumn(name, F.when(F.col(vector).isNotNull(), best))


def with_floors(scored: DataFrame, group: str, label: str, guess: str, site: str, classes: list[str], least: int = 30) -> DataFrame:
    """(group, class, precision, recall, f1, support, sites, note) of every group and class.

    A class with fewer than ``least`` rows or sites in a group gets no score but a note; so does a group without rows.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), (F.col(label) == c).alias("is"), (F.col(guess) == c).alias("said")) for c in classes)))
    long = scored.where(F.col(label).isNotNull()).select(group, site, each.alias("c")).select(group, site, "c.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by = long.groupBy(group, "class").agg(F.count_if(F.col("is") & F.coalesce("said", F.lit(False))).alias("hit"), F.count_if("is").alias("support"), F.count_if("said").alias("said"))
    sites = long.where("is").select(group, "class", site).distinct().groupBy(F.col(group).alias("_g"), F.col("class").alias("_c")).agg(F.count(site).alias("sites"))
    met = by.join(sites, F.col(group).eqNullSafe(F.col("_g")) & (F.col("class") == F.col("_c")), "left").na.fill(0, ["sites"])
    enough = (F.col("support") >= least) & (F.col("sites") >= least)
    note = F.when(~enough, F.concat(F.lit("insufficient support, n="), F.col("support"), F.lit(" from "), F.col("sites"), F.lit(" sites")))
    score = {"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support")), "f1": ratio(2 * F.col("hit"), F.col("said") + F.col("support"))}
    return met.select(group, "class", *(F.when(enough, v).alias(k) for k, v in score.items()), "support", "sites", note.alias("note"))
