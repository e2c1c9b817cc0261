"""Quality classifier: Bradley-Terry pairwise ranking.

A document's worth is a linear function of surface features of its whole text. The weights are
learned from preference pairs (a document labelled 1 beats one labelled 0) by logistic loss on the
difference of their features. Scores are shifted so that the label-0 share of the training scores
(a quantile) falls at the threshold.

Features and scores are SQL expressions, so scoring is one scan without Python or a shuffle. Only
the fit leaves the cluster: at most ``max_rows`` labelled rows' features reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score from which a document is predicted to be good.
THRESHOLD = 0.3
#: Labelled rows that the fit may use, chosen by hash of doc_id; a documented bound.
MAX_ROWS = 20_000
MAX_PAIRS = 200_000
SYMBOLS = "*#$%&|!@~^<>{}[]=+_\\/"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍ"


def _share(text: Column, chars: str) -> Column:
    n = F.length(text)
    return F.coalesce((n - F.length(F.translate(text, chars, ""))) / F.nullif(n, F.lit(0)), F.lit(0.0))


def features(text: Column) -> list[Column]:
    """Surface features of a text (null: empty); all are finite doubles."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n, k = F.length(text), F.size(words)
    symbol, upper = _share(text, SYMBOLS), _share(text, UPPER)
    ratio = lambda a: F.coalesce(F.size(F.array_distinct(a)) / F.nullif(F.size(a), F.lit(0)), F.lit(1.0))
    return [
        F.log1p(n.cast("double")), 1.0 / (1.0 + k), symbol, F.sqrt(symbol), upper, F.sqrt(upper), _share(text, "0123456789"),
        _share(text, ".,;:?"), F.coalesce(n / F.nullif(k, F.lit(0)), F.lit(0.0)), ratio(words), ratio(lines), F.log1p(F.size(lines).cast("double")),
    ]


@dataclass(frozen=True)
class PairwiseModel:
    """score = sigmoid(sum w_i (x_i - mean_i) / sd_i - cut + logit(threshold))."""

    mean: tuple[float, ...]
    sd: tuple[float, ...]
    weight: tuple[float, ...]
    cut: float
    threshold: float = THRESHOLD

    def score(self, text: Column) -> Column:
        raw = F.lit(float(np.log(self.threshold / (1 - self.threshold)) - self.cut))
        for x, m, s, w in zip(features(text), self.mean, self.sd, self.weight, strict=True):
            raw = raw + (x - F.lit(m)) * F.lit(w / s)
        return 1.0 / (1.0 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -raw))))


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-3, pairs: int = MAX_PAIRS, seed: int = 7) -> np.ndarray:
    """Weights maximising the likelihood that each good row beats the bad row it is paired with (Newton steps)."""
    rng = np.random.default_rng(seed)
    m = min(pairs, len(good) * len(bad))
    diff = good[rng.integers(0, len(good), m)] - bad[rng.integers(0, len(bad), m)]
    w = np.zeros(diff.shape[1])
    for _ in range(30):
        lose = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        grad = diff.T @ lose / m - ridge * w
        hess = (diff * (lose * (1 - lose))[:, None]).T @ diff / m + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> PairwiseModel:
    """Fit on rows of labels (doc_id, quality) that are not null.

    Beyond max_rows labels, those with the smallest hash of doc_id are used. A doc_id labelled twice counts as
    good if one label says so; of rows that repeat a doc_id one counts. Without both classes (an
    empty table, say), every weight is 0 and every document scores above the threshold.
    """
    own = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    share = max_rows / max(1, own.count())
    if share < 1:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    own = own.limit(2 * max_rows)
    docs = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(own), "doc_id")
    each = docs.select("doc_id", "_quality", F.array(*features(F.col("_text"))).alias("x"))
    rows = each.groupBy("doc_id", "_quality").agg(F.max("x").alias("x")).collect()
    width = len(features(F.lit("")))
    x = np.array([r.x for r in rows], float).reshape(len(rows), width)
    y = np.array([r["_quality"] for r in rows])
    if not (y == 1).any() or not (y == 0).any():
        return PairwiseModel((0.0,) * width, (1.0,) * width, (0.0,) * width, -1.0, threshold)
    mean, sd = x.mean(0), x.std(0)
    sd[sd < 1e-9] = 1.0
    z = (x - mean) / sd
    w = bradley_terry(z[y == 1], z[y == 0])
    raw, k = np.sort(z @ w), int((y == 0).sum())
    return PairwiseModel(tuple(mean.tolist()), tuple(sd.tolist()), tuple(w.tolist()), float((raw[k - 1] + raw[k]) / 2), threshold)


def held_out(doc_id: Column, modulus: int = 5, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text leaves the remainder (a null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def classify(docs: DataFrame, model: PairwiseModel, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with columns score (0 to 1) and predicted (1: keep). Null and empty texts are scored like any other.

    ``names`` call the two columns; input columns of those names are replaced, all others are kept. Repeated
    rows give equal rows, an empty table an empty one.
    """
    kept = docs.drop(*names)
    return kept.withColumn(names[0], model.score(docs["text"])).withColumn(names[1], (F.col(names[0]) >= model.threshold).cast("int"))
