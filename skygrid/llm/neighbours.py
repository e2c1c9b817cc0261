"""Approximate nearest neighbours by low-dimensional stable projections.

Largest inner product becomes smallest distance by one more component: rows (x, sqrt(M^2 - |x|^2)),
queries scaled to length M. A Gaussian (2-stable) projection to eight dimensions turns a distance d
into d times the root of a chi-square variable. Rows are dealt to cells by a kd-tree over the
projections; each block of a cell has a kd-tree of its own. A query visits leaves by their projected
distance and verifies points exactly, until the chi-square test holds: with probability
``confidence`` a point nearer than the k-th best would have a smaller projected distance.

The cell tree is fitted on at most ``SAMPLE`` rows; all rows are indexed. A cell's rows are split by
hash into blocks, so equal vectors (a third of the table, say) fill no block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.llm.common import small_batches, table

#: Rows whose projections (64 bytes each) the cell tree is fitted on, rows that a block is meant to hold, cells at most.
SAMPLE, BLOCK, CELLS = 200_000, 8_192, 32_768
LEAF = 64
PROJECTIONS = 8


def chi_square_quantile(p: float, degrees: int) -> float:
    """Inverse distribution function for an even number of degrees, by bisection of the closed form."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return hi


def kd_leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of each leaf: halves along the widest dimension until they hold at most ``most`` rows."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        own = points[rows]
        order = np.argsort(own[:, np.argmax(np.ptp(own, axis=0))], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


class CellTree:
    """Median splits of a sample; ``place`` gives the cell of any projected row."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim, self.cut, self.left, self.right, self.cell = [], [], [], [], []
        self.cells = 0
        self._grow(sample, max(1, cells))

    def _grow(self, rows: np.ndarray, cells: int) -> int:
        at = len(self.dim)
        for x in (self.dim, self.cut, self.left, self.right, self.cell):
            x.append(0)
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(PROJECTIONS)
        if cells == 1 or spread.max() == 0:
            self.cell[at], self.dim[at] = self.cells, -1
            self.cells += 1
            return at
        d = int(np.argmax(spread))
        cut = float(np.median(rows[:, d]))
        if cut == rows[:, d].min():
            cut = float(np.nextafter(cut, np.inf))
        below = rows[:, d] < cut
        self.dim[at], self.cut[at] = d, cut
        self.left[at] = self._grow(rows[below], cells // 2)
        self.right[at] = self._grow(rows[~below], cells - cells // 2)
        return at

    def place(self, points: np.ndarray) -> np.ndarray:
        dim, cut, left, right = (np.array(x) for x in (self.dim, self.cut, self.left, self.right))
        at = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(dim[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(points[inner, dim[node]] < cut[node], left[node], right[node])
        return np.array(self.cell)[at]


def _project(vectors: np.ndarray, largest: float, matrix: np.ndarray) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(1), 0))
    return vectors @ matrix[:-1] + rest[:, None] * matrix[-1]


def search_block(ids, vectors, projected, asked, v, floor, k: int, largest: float, matrix: np.ndarray, factor: float):
    """The k best (query_id, vec_id, score), as arrays, of each query (asked: ids, v: vectors, floor: k-th score so far or -inf) in a block.

    The queries visit their leaves together, by rounds: the nearest, the next two, the next four and so on. A leaf is
    one product with all that visit it in a round; what may be among the best is scored again row by row.
    """
    leaves = kd_leaves(projected, LEAF)
    low, high = np.array([projected[r].min(0) for r in leaves]), np.array([projected[r].max(0) for r in leaves])
    held = [vectors[r] for r in leaves]
    scale = largest / np.sqrt((v * v).sum(1))
    z = scale[:, None] * (v @ matrix[:-1])
    gap = np.zeros((len(v), len(leaves)))
    for i in range(z.shape[1]):
        gap += np.maximum(np.maximum(low[:, i] - z[:, i : i + 1], z[:, i : i + 1] - high[:, i]), 0) ** 2
    order = np.argsort(gap, axis=1, kind="stable")
    worst, slack = floor.copy(), 1e-12 * v.shape[1] * largest * largest / scale  # more than a product's rounding
    whose, own, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    at, step = 0, 1
    while at < len(leaves):
        visit = order[:, at : at + step]
        open_ = np.take_along_axis(gap, visit, 1) <= np.where(worst == -np.inf, np.inf, (2 * largest**2 - 2 * scale * worst) * factor * (1 + 1e-9) + 1e-9 * largest**2)[:, None]
        if not open_.any():
            break
        who, column = np.nonzero(open_)
        leaf = visit[who, column]
        by_leaf = np.argsort(leaf, kind="stable")
        who, leaf = who[by_leaf], leaf[by_leaf]
        new = [(whose, own, score)]
        for part in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
            x, q = leaf[part[0]], who[part]
            i, j = np.nonzero(v[q] @ held[x].T >= (worst[q] - slack[q])[:, None])
            q, row = q[i], ids[leaves[x][j]]
            exact = (held[x][j] * v[q]).sum(1)
            keep = (row != asked[q]) & (exact >= worst[q])
            new.append((q[keep], row[keep], exact[keep]))
        whose, own, score = (np.concatenate(c) for c in zip(*new, strict=True))
        best = np.lexsort((own, -score, whose))
        whose, own, score = whose[best], own[best], score[best]
        place = np.arange(len(whose)) - np.searchsorted(whose, whose)
        whose, own, score = whose[place < k], own[place < k], score[place < k]
        full = place[place < k] == k - 1
        worst[whose[full]] = np.maximum(worst[whose[full]], score[full])
        at, step = at + step, step * 2
    return asked[whose], own, score


def _vector(c: Column) -> Column:
    """The vector as doubles; null if it takes no part."""
    v = c.cast("array<double>")
    whole = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.when(whole, v)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, confidence: float = 0.97, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by inner product, itself left out.

    Ties go to the smaller vec_id. Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do those of another length than most or with a null vec_id. Of rows that repeat a vec_id
    one of the largest vector in array order counts. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    small_batches(spark)
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), _vector(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id is not null and v is not null")
    base = table(base.groupBy("vec_id").agg(F.max("v").alias("v"), F.max("q").alias("q")).withColumn("m", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    schema = "query_id long, rank int, vec_id long, score double"
    usual = base.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    d, n, largest = usual.d, usual.n, math.sqrt(usual.m)
    base = base.where(F.size("v") == d)
    matrix = np.random.default_rng(seed).standard_normal((d + 1, PROJECTIONS))
    factor = chi_square_quantile(confidence, PROJECTIONS)
    share = min(1.0, SAMPLE / n)
    def matrix_of(column) -> np.ndarray:
        return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, d) if len(column) else np.empty((0, d))

    def projections(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_project(matrix_of(b.column("v")), largest, matrix).tolist(), pa.list_(pa.float64()))], ["p"])

    sample = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").mapInArrow(projections, "p array<double>").limit(2 * SAMPLE).collect()
    tree = CellTree(np.array([r.p for r in sample]).reshape(-1, PROJECTIONS), min(CELLS, -(-n // BLOCK)))

    def place(batches):
        for b in batches:
            if b.num_rows:
                p = _project(matrix_of(b.column("v")), largest, matrix)
                yield pa.RecordBatch.from_arrays([pa.array(tree.place(p).astype(np.int32)), *(b.column(c) for c in ("vec_id", "v", "q")), pa.array(p.tolist(), pa.list_(pa.float64()))], ["cell", "vec_id", "v", "q", "p"])

    placed = table(base.select("vec_id", "v", "q").mapInArrow(place, "cell int, vec_id long, v array<double>, q boolean, p array<double>"))
    at = lambda i: F.element_at("p", i + 1)
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.min(at(i)) for i in range(PROJECTIONS))).alias("lo"), F.array(*(F.max(at(i)) for i in range(PROJECTIONS))).alias("hi")).collect()}
    blocks = [(c, j) for c in sorted(cells) for j in range(-(-cells[c].n // BLOCK))]
    first = {c: i for i, (c, j) in reversed(list(enumerate(blocks)))}
    low, high = np.array([cells[c].lo for c, _ in blocks]), np.array([cells[c].hi for c, _ in blocks])
    counts = {c: -(-cells[c].n // BLOCK) for c in cells}
    lookup = F.broadcast(spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}, {first[c]}, {counts[c]})" for c in sorted(cells)) + " AS t(cell, first, blocks)"))
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int")
    own = placed.join(lookup, "cell").withColumn("block", block)
    candidates = own.select("block", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))

    def run(batches):
        """A block's rows (kind 0) are gathered as they come first; its queries (kind 1) are answered batch by batch."""
        at, block = None, None  # the number of the block held, and its (ids, vectors, projections)
        ids, parts = [], []
        for batch in batches:
            number, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
            vec, vectors, floors = batch.column("vec_id").to_numpy(), matrix_of(batch.column("v")), batch.column("floor").fill_null(-math.inf).to_numpy()
            cut = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
            for start, end in zip(cut, [*cut[1:], len(number)], strict=True):
                if number[start] != at:
                    at, block, ids, parts = number[start], None, [], []
                if kind[start] == 0:
                    ids.append(vec[start:end])
                    parts.append(vectors[start:end])
                    continue
                if not ids:
                    continue  # nothing to search
                if block is None:
                    v = np.concatenate(parts)
                    block = (np.concatenate(ids), v, _project(v, largest, matrix))
                found = search_block(*block, vec[start:end], vectors[start:end], floors[start:end], k, largest, matrix, factor)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    def find(queries: DataFrame) -> DataFrame:
        return candidates.unionByName(queries).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "query_id long, vec_id long, score double")

    home = table(find(own.where("q").select("block", F.lit(1).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))))
    best = home.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") == k, F.col("least")).alias("floor"))
    asking = own.where("q").join(best, "vec_id", "left").select("block", "vec_id", "v", "floor")

    def route(batches):
        for b in batches:
            out = []
            vs = matrix_of(b.column("v"))
            for i, (mine, floor) in enumerate(zip(b.column("block").to_pylist(), b.column("floor").to_pylist(), strict=True)):
                scale = largest / math.sqrt(float((vs[i] ** 2).sum()))
                z = scale * (vs[i] @ matrix[:-1])
                gap = (np.maximum(np.maximum(low - z, z - high), 0) ** 2).sum(1)
                near = np.ones(len(gap), bool) if floor is None else gap <= (2 * largest**2 - 2 * scale * floor) * factor * (1 + 1e-9) + 1e-9 * largest**2
                near[mine] = False
                out += [(j, i) for j in np.flatnonzero(near).tolist()]
            at = pa.array([i for _, i in out], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in out], pa.int32()), pa.array([1] * len(out), pa.int32()), b.column("vec_id").take(at), b.column("v").take(at), b.column("floor").take(at)], ["block", "kind", "vec_id", "v", "floor"])

    routed = asking.select("block", "vec_id", "v", "floor").mapInArrow(route, "block int, kind int, vec_id long, v array<double>, floor double")
    every = home.unionByName(find(routed)) if len(blocks) > 1 else home
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
