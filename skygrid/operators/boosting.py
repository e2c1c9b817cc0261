"""Gradient-boosted multiclass trees with missing values, many models in one pass; blocked evaluation.

Rows are binned once (bin 0: missing). A pass adds up gradient, curvature and rows by (model, class, node,
feature, bin) in each task and then over tasks; the driver gets those sums, whose number hangs on the
parameters and not on the rows, and picks each node's split, with the branch that missing values take. Folds, feature
sets and capped samples are models of one fit: a bit of a row's mask tells whether a model learns from it, so all
of them share every pass. Sums are of whole numbers (gradients in fixed point): a fit does not
hang on how rows lie in partitions, and a model fitted among others equals the one fitted alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrid.operators.sampling import majority_kept
from skygrid.sources.scratch import written

#: Fixed point of gradients and curvatures.
UNIT = 1 << 24
#: Rows whose curvatures (at most UNIT / 4 each) add up to less than ROW, the weight of a row beside them; PACKED * ROW is below 2 ** 53.
PACKED, ROW = 1 << 14, 1 << 37
#: Rows worked on at a time, so that they stay in a core's cache.
CHUNK = 1 << 10
#: Nodes times bins up to which sums are products of matrices; beyond, cells are counted one by one.
DENSE = 64
#: Models of one fit, a bit each.
MOST_MODELS = 62


@dataclass(frozen=True)
class Model:
    """A model's name, the rows it learns from, and the features it may use (all if none are named)."""

    name: str
    train: Column
    features: tuple[str, ...] = ()


@dataclass
class Tree:
    """Nodes by number, children of i at 2 i + 1 and 2 i + 2: rows with bin <= cut go left, missing ones as ``lost`` says."""

    feature: dict[int, int] = field(default_factory=dict)
    cut: dict[int, int] = field(default_factory=dict)
    lost: dict[int, bool] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def place(self, columns: list[np.ndarray]) -> np.ndarray:
        """Node of each row, from the bins of each feature."""
        at = np.zeros(len(columns[0]) if columns else 0, np.int16)
        for node in sorted(self.feature):
            b = columns[self.feature[node]]
            left = b <= self.cut[node]
            if not self.lost[node]:
                left &= b > 0
            np.copyto(at, 2 * node + 2 - left, where=at == node, casting="unsafe")
        return at


@dataclass(frozen=True)
class Ensemble:
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    classes: tuple[str, ...]
    models: tuple[str, ...]
    start: np.ndarray  # (model, class)
    rounds: list[dict[tuple[int, int], Tree]]  # (model, class) to tree

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """(row, model, class) before the softmax."""
        columns = list(np.ascontiguousarray(bins.T))
        return added(np.repeat(self.start[..., None], len(bins), axis=2), columns, self.rounds).transpose(2, 0, 1)


def added(raw: np.ndarray, columns: list[np.ndarray], rounds: list[dict[tuple[int, int], Tree]], width: int | None = None) -> np.ndarray:
    """raw (model, class, row) with the trees' values added; bins are below ``width``."""
    return adder(rounds, len(columns), width or 1 + max((int(c.max(initial=0)) for c in columns), default=0))(raw, columns)


def adder(rounds: list[dict[tuple[int, int], Tree]], features: int, width: int) -> Callable[[np.ndarray, list[np.ndarray]], np.ndarray]:
    """``added`` of these trees, made once for many rows.

    A tree of at most eight leaves has a bit a leaf: each bin of a feature leaves some of them open, and one is open for
    all features. So a row takes the open leaves of all trees at once, feature by feature, and walks no tree.
    """
    trees = [(key, tree) for r in rounds for key, tree in r.items() if tree.value]
    small = [tree for _, tree in trees if len(tree.value) <= 8]
    opened = np.full((features, width, -(-len(small) // 8) * 8), 255, np.uint8)
    bins, lookup = np.arange(width), {}
    for t, tree in enumerate(small):
        bits = {node: 1 << i for i, node in enumerate(sorted(tree.value))}
        lookup[id(tree)] = t, np.zeros(256)
        opened[:, :, t] = (1 << len(bits)) - 1
        for node, bit in bits.items():
            lookup[id(tree)][1][bit] = tree.value[node]
        for node in sorted(tree.feature, reverse=True):
            left, right = bits[2 * node + 1], bits[2 * node + 2]
            bits[node] = left | right
            goes = (bins <= tree.cut[node]) & (tree.lost[node] | (bins > 0))
            opened[tree.feature[node], :, t] &= np.where(goes, 255 ^ right, 255 ^ left).astype(np.uint8)
    words = opened.view(np.uint64)
    used = sorted({f for tree in small for f in tree.feature.values()})

    def add(raw: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        leaves = None
        for f in used:
            part = words[f].take(columns[f], axis=0)
            leaves = part if leaves is None else np.bitwise_and(leaves, part, out=part)
        leaves = None if leaves is None else leaves.view(np.uint8)
        for (m, k), tree in trees:
            if not tree.feature:
                raw[m, k] += tree.value[0]
            elif id(tree) in lookup:
                t, values = lookup[id(tree)]
                raw[m, k] += values.take(leaves[:, t])
            else:
                values = np.zeros(max(tree.value) + 1)
                values[list(tree.value)] = list(tree.value.values())
                raw[m, k] += values.take(tree.place(columns))
        return raw

    return add


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def edges_of(rows: DataFrame, features: list[str], bins: int) -> tuple[tuple[float, ...], ...]:
    """Cut points of each feature by approximate quantiles, at most ``bins`` - 1."""
    shares = [i / bins for i in range(1, bins)]
    got = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in features)).head()
    return tuple(tuple(sorted({v for v in got[c] or [] if v == v})) for c in features)


def binned(rows: DataFrame, features: list[str], label: str, classes: list[str], models: list[Model], edges: tuple, keep: list[str]) -> DataFrame:
    """Written rows (keep, y, mask, b0, b1 ...): null and NaN are bin 0; rows of no listed class have y -1 and train nothing."""
    if len(models) > MOST_MODELS:
        raise ValueError(f"{len(models)} models in one fit, at most {MOST_MODELS}")
    number = F.coalesce(F.array_position(F.array(*map(F.lit, classes)), F.col(label)), F.lit(0)).cast("int") - 1

    def bin_of(name: str, cuts: tuple[float, ...]) -> Column:
        """1 plus the cuts below the value."""
        value = F.col(name).cast("double")
        below = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + (value > c).cast("int")) if cuts else F.lit(0)
        return F.when(value.isNull() | F.isnan(value), 0).otherwise(1 + below).cast("smallint")

    mask = F.lit(0).cast("long")
    for i, m in enumerate(models):
        mask = mask + F.when(m.train & (number >= 0), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    own = [bin_of(c, e).alias(f"b{i}") for i, (c, e) in enumerate(zip(features, edges, strict=True))]
    return written(rows.select(*keep, number.alias("y"), mask.alias("mask"), *own))


def _columns(batch: pa.RecordBatch, features: int) -> list[np.ndarray]:
    return [batch.column(f"b{i}").to_numpy() for i in range(features)]


def gradients(y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point gradient and curvature of the softmax loss, (row, model, class)."""
    g, h = _slopes(y, raw.transpose(1, 2, 0))
    return g.transpose(2, 0, 1).astype(np.int64), h.transpose(2, 0, 1).astype(np.int64)


def _slopes(y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``gradients`` of raw (model, class, row), as whole numbers in doubles."""
    p = np.exp(raw - raw.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hit = y == np.arange(raw.shape[1])[:, None]
    return np.rint((p - hit) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT)


def histograms(batches: Iterable[pa.RecordBatch], ensemble: Ensemble, done: int, growing: dict, open_: dict, width: int) -> Iterator[pa.RecordBatch]:
    """(cell, g, h, n) of a task; a cell is (tree, slot of an open node, feature, bin)."""
    features, slots, keys = len(ensemble.features), max(map(len, open_.values())), sorted(open_)
    total = np.zeros((len(keys), slots, features, width, 3), np.int64)
    add, score = _add_dense if slots * width <= DENSE else _add_counts, adder(ensemble.rounds[done:], features, width)
    for batch in batches:
        columns, y, mask, stored = _columns(batch, features), batch.column("y").to_numpy(), batch.column("mask").to_numpy(), _stored(batch, ensemble)
        for at in range(0, len(y), PACKED):
            sums = np.zeros((len(keys), slots, 2, features, width))
            for low in range(at, min(at + PACKED, len(y)), CHUNK):
                own = slice(low, min(low + CHUNK, at + PACKED))
                bins = [c[own] for c in columns]
                g, h = _slopes(y[own], score(stored[..., own].copy(), bins))
                h += ROW
                add(sums, keys, bins, mask[own], g, h, growing, open_)
            both = sums[:, :, 1].astype(np.int64)
            total[..., 0] += sums[:, :, 0].astype(np.int64)
            total[..., 1] += both % ROW
            total[..., 2] += both // ROW
    flat = total.reshape(-1, 3)
    held = np.flatnonzero(flat[:, 2])
    yield pa.RecordBatch.from_arrays([pa.array(held), *(pa.array(flat[held, i]) for i in range(3))], ["cell", "g", "h", "n"])


def _add_dense(sums: np.ndarray, keys: list, columns: list[np.ndarray], mask: np.ndarray, g: np.ndarray, h: np.ndarray, growing: dict, open_: dict) -> None:
    """Adds (gradient, curvature and row) by cell to sums, at most PACKED rows in all; whole numbers of at most a double's 53 bits, in any order.

    One product for all trees and features: rows by (tree, slot) times the rows' bins, 0 or 1 each.
    """
    trees, slots, _, features, width = sums.shape
    left, right = np.zeros((trees, slots, 2, len(mask))), np.zeros((len(mask), features * width))
    places = np.arange(len(mask)) * (features * width)
    for f, column in enumerate(columns):
        right.ravel()[places + f * width + column] = 1
    for t, (m, k) in enumerate(keys):
        learns = (mask >> m) & 1 == 1
        at = growing[m, k].place(columns)
        for s, node in enumerate(open_[m, k]):
            own = learns & (at == node)
            np.multiply(g[m, k], own, out=left[t, s, 0])
            np.multiply(h[m, k], own, out=left[t, s, 1])
    sums += (left.reshape(-1, len(mask)) @ right).reshape(sums.shape)


def _add_counts(sums: np.ndarray, keys: list, columns: list[np.ndarray], mask: np.ndarray, g: np.ndarray, h: np.ndarray, growing: dict, open_: dict) -> None:
    """As ``_add_dense``, tree by tree and feature by feature."""
    _, slots, _, features, width = sums.shape
    for t, (m, k) in enumerate(keys):
        rows = np.flatnonzero((mask >> m) & 1)
        slot = np.full(2 * max(open_[m, k]) + 3, slots)  # rows of closed nodes go to a slot of their own, left out below
        slot[open_[m, k]] = np.arange(len(open_[m, k]))
        base = slot[growing[m, k].place(columns)[rows]] * width
        for f in range(features):
            cell = base + columns[f][rows]
            for i, w in enumerate((g[m, k][rows], h[m, k][rows])):
                sums[t, :, i, f] += np.bincount(cell, w, (slots + 1) * width)[: slots * width].reshape(slots, width)


def _stored(batch: pa.RecordBatch, ensemble: Ensemble) -> np.ndarray:
    """(model, class, row)"""
    if "raw" not in batch.schema.names:
        return np.broadcast_to(ensemble.start[..., None], (*ensemble.start.shape, len(batch)))
    return batch.column("raw").flatten().to_numpy().reshape(len(batch), *ensemble.start.shape).transpose(1, 2, 0)


def best_split(hist: np.ndarray, allowed: np.ndarray, least: int, reg: float) -> tuple[int, int, bool, float] | None:
    """(feature, cut, missing left, gain) of a node's (feature, bin, 3) sums; the first of equal gains."""
    whole = hist[0].sum(axis=0)
    part = lambda s: s[..., 0].astype(float) ** 2 / (s[..., 1] + reg * UNIT)
    lost, upto = hist[:, 0], hist[:, 1:].cumsum(axis=1)[:, :-1]
    best = None
    for missing_left in (True, False):
        left = upto + (lost[:, None] if missing_left else 0)
        right = whole - left
        gain = (part(left) + part(right) - part(whole)) / UNIT
        gain[(left[..., 2] < least) | (right[..., 2] < least) | ~allowed[:, None]] = -np.inf
        if gain.size and gain.max() > 1e-9 and (best is None or gain.max() > best[3]):
            f, c = divmod(int(gain.argmax()), gain.shape[1])
            best = f, c + 1, missing_left, float(gain[f, c])
    return best


def fit(rows: DataFrame, features: list[str], label: str, classes: list[str], models: list[Model], rounds: int = 200, depth: int = 6, rate: float = 0.1, bins: int = 64, least: int = 20, reg: float = 1.0, keep: tuple[str, ...] = (), store_every: int = 10) -> tuple[Ensemble, DataFrame]:
    """The models' trees, and the written binned rows with the columns ``keep``.

    A round fits one tree a model and class, level by level: a pass a level, of which the driver sees at
    most models * classes * 2 ** (depth - 1) * features * (bins + 1) sums. Scores of the trees are
    written every ``store_every`` rounds, so a pass walks few trees. Rows of other classes train nothing.
    A model without rows stays at even odds.
    """
    edges = edges_of(rows, features, bins)
    data = binned(rows, features, label, classes, models, edges, list(keep))
    width = max((len(e) for e in edges), default=0) + 2
    names = tuple(m.name for m in models)
    if len(set(names)) < len(names):
        raise ValueError("models of one name")
    allowed = [np.array([not m.features or f in m.features for f in features]) for m in models]
    counts = np.zeros((len(models), len(classes)), np.int64)
    seen = data.where("mask > 0").groupBy("y").agg(*(F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1))).alias(f"m{i}") for i in range(len(models))))
    for r in seen.collect():
        counts[:, r.y] = [r[f"m{i}"] for i in range(len(models))]
    start = np.log(np.maximum(counts, 0.5) / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    ensemble, stored, done = Ensemble(tuple(features), edges, tuple(classes), names, start, []), data.where("mask > 0"), 0
    for r in range(rounds):
        growing = {(m, k): Tree() for m in range(len(models)) for k in range(len(classes)) if counts[m].sum()}
        open_, seen = {key: [0] for key in growing}, {}
        for level in range(depth):
            if not open_:
                break
            keys = sorted(open_)
            asked = {key: [n for n in nodes if n % 2 or not n] for key, nodes in open_.items()}  # the other child has the rest of its parent's sums
            slots = max(map(len, asked.values()))
            run = lambda batches, a=(replace(ensemble, rounds=list(ensemble.rounds)), done, growing, asked, width): histograms(batches, *a)
            sums = stored.mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
            flat = np.zeros((len(keys) * slots * len(features) * width, 3), np.int64)
            flat[sums["cell"].to_numpy()] = np.stack([sums[c].to_numpy() for c in "ghn"], axis=1)
            hist = flat.reshape(len(keys), slots, len(features), width, 3)
            nxt = {}
            for t, key in enumerate(keys):
                seen |= {(key, node): hist[t, s] for s, node in enumerate(asked[key])}
                for node in open_[key]:
                    if (key, node) not in seen:
                        seen[key, node] = seen[key, (node - 1) // 2] - seen[key, node - 1]
                    nxt.setdefault(key, []).extend(_grow(growing[key], node, seen[key, node], allowed[key[0]], least, reg, rate))
            open_ = {key: nodes for key, nodes in nxt.items() if nodes and level + 1 < depth}
        ensemble.rounds.append(growing)
        if (r + 1) % store_every == 0 and r + 1 < rounds:
            stored, done = _with_scores(stored, ensemble, done), r + 1
    return ensemble, data


def _grow(tree: Tree, node: int, hist: np.ndarray, allowed: np.ndarray, least: int, reg: float, rate: float) -> list[int]:
    """Split the node if a split gains; its children, whose values are set."""
    value = lambda s: float(-rate * s[0] / (s[1] + reg * UNIT))
    whole = hist[0].sum(axis=0) if len(hist) else np.zeros(3, np.int64)
    if node == 0:
        tree.value[0] = value(whole)
    found = best_split(hist, allowed, least, reg) if len(hist) else None
    if found is None:
        return []
    f, cut, lost, _ = found
    tree.feature[node], tree.cut[node], tree.lost[node] = f, cut, lost
    left = hist[f, 1 : cut + 1].sum(axis=0) + (hist[f, 0] if lost else 0)
    tree.value.pop(node)
    tree.value |= {2 * node + 1: value(left), 2 * node + 2: value(whole - left)}
    return [2 * node + 1, 2 * node + 2]


def _with_scores(stored: DataFrame, ensemble: Ensemble, done: int) -> DataFrame:
    features, own = len(ensemble.features), replace(ensemble, rounds=list(ensemble.rounds))
    kept = [c for c in stored.columns if c != "raw"]
    kinds = dict(stored.dtypes)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = added(_stored(batch, own).copy(), _columns(batch, features), own.rounds[done:]).transpose(2, 0, 1).reshape(len(batch), -1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * raw.shape[1]), pa.array(raw.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], [*kept, "raw"])

    return written(stored.mapInArrow(score, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", raw array<double>"))


def predicted(data: DataFrame, ensemble: Ensemble, keep: list[str], column: str = "", values: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``fit``'s data as keep, y, and for each model its classes' probabilities: one row a row and model.

    With ``values``, a model has only the rows in which ``column`` is its value there.
    """
    own, features = ensemble, len(ensemble.features)
    kinds = dict(data.dtypes)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, name in enumerate(own.models):
                part = batch if values is None else batch.filter(pc.equal(batch.column(column), values[name]))
                raw = np.repeat(own.start[m : m + 1, :, None], len(part), axis=2)
                trees = [{(0, k): tree for (other, k), tree in r.items() if other == m} for r in own.rounds]
                p = softmax(added(raw, _columns(part, features), trees)[0].T) if len(part) else np.zeros((0, own.start.shape[1]))
                probabilities = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                best = pa.array(p.argmax(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*keep, "y"]), pa.array([name] * len(part), pa.string()), best, probabilities], [*keep, "y", "model", "guess", "p"])

    return data.mapInArrow(score, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "y int, model string, guess int, p array<double>")


def class_report(scored: DataFrame, classes: list[str]) -> DataFrame:
    """(model, class, precision, recall, f1, support) from (model, y, guess), and a row of class `macro`: plain means of all classes.

    A ratio without a denominator is 0. Classes that a model's rows lack count, with support 0.
    """
    pairs = scored.where("y >= 0").groupBy("model", "y", "guess").agg(F.count(F.lit(1)).alias("n"))
    each = pairs.select("model", F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(c).alias("class")) for i, c in enumerate(classes)))).alias("c"), "y", "guess", "n").select("model", "c.*", "y", "guess", "n")
    hit, truth, said = (F.sum(F.when(w, F.col("n")).otherwise(0)) for w in ((F.col("y") == F.col("k")) & (F.col("guess") == F.col("k")), F.col("y") == F.col("k"), F.col("guess") == F.col("k")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by = each.groupBy("model", "class").agg(hit.alias("hit"), truth.alias("support"), said.alias("said"))
    rows = by.select("model", "class", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")
    macro = rows.groupBy("model").agg(F.lit("macro").alias("class"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    return rows.unionByName(macro)


def blocked_evaluation(rows: DataFrame, ident: str, group: str, near: dict[str, str], external: str, features: list[str], leaking: list[str], label: str, classes: list[str], cap: float, **params) -> DataFrame:
    """Report of models that each leave a group out, all fitted in one pass.

    ``near`` maps each held-out group to the column that tells whether a row lies near it; its model
    learns from rows with a group, outside of it, of ``external`` and of its surroundings. Model ``external``
    learns from all groups but that one. ``leak:g`` of the first group also has the features that define
    the label and is to be shown, never used. ``capped:g`` learns from the majority class only up to the share
    ``cap``. Each model is scored on the rows of its own group, each once: rows may share an ident.
    """
    inside = F.col(group).isNotNull() & (F.col(group) != external)
    learns = {g: inside & (F.col(group) != g) & ~F.coalesce(F.col(c), F.lit(False)) for g, c in near.items()}
    rows = written(rows)
    capped = {g: majority_kept(rows.where(train & F.col(label).isin(classes)), ident, label, cap) for g, train in learns.items()}
    first = next(iter(near))
    models = [Model(g, train, tuple(features)) for g, train in learns.items()] + [Model("external", inside, tuple(features)), Model(f"leak:{first}", learns[first])]
    models += [Model(f"capped:{g}", train & capped[g], tuple(features)) for g, train in learns.items()]
    ensemble, data = fit(rows, [*features, *leaking], label, classes, models, keep=(ident, group), **params)
    own = {m.name: external if m.name == "external" else m.name.split(":")[-1] for m in models}
    return class_report(predicted(data, ensemble, [group], group, own), classes)


def block_ablation(rows: DataFrame, ident: str, group: str, near: dict[str, str], features: list[str], block: list[str], label: str, classes: list[str], truth: str, other: str, **params) -> DataFrame:
    """(group, rows of class ``truth``, share guessed ``other`` with all features and without the block), and their mean by rows as group `all`.

    Every group's two models are fitted in the same pass. A group without such rows has no shares.
    """
    learns = {g: F.col(group).isNotNull() & (F.col(group) != g) & ~F.coalesce(F.col(c), F.lit(False)) for g, c in near.items()}
    rest = tuple(f for f in features if f not in block)
    models = [Model(f"{g}:{kind}", train, own) for g, train in learns.items() for kind, own in (("with", ()), ("without", rest))]
    ensemble, data = fit(rows, features, label, classes, models, keep=(ident, group), **params)
    scored = predicted(data.where(F.col("y") == classes.index(truth)), ensemble, [group], group, {f"{g}:{kind}": g for g in near for kind in ("with", "without")})
    share = lambda kind: F.avg(F.when(F.substring_index("model", ":", -1) == kind, (F.col("guess") == classes.index(other)).cast("double")))
    by = scored.groupBy(group).agg(F.sum((F.substring_index("model", ":", -1) == "with").cast("long")).alias("n"), share("with").alias("share_with"), share("without").alias("share_without"))
    names = rows.sparkSession.createDataFrame([(g,) for g in near], f"`{group}` string")
    each = names.join(by, group, "left").na.fill(0, ["n"])
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n")).alias(c)
    return each.unionByName(each.agg(F.lit("all").alias(group), F.sum("n").alias("n"), mean("share_with"), mean("share_without")))
