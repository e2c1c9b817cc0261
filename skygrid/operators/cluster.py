"""Density clustering by cells of a grid and connected components.

A cell is so small that its rows are all near each other: one component, and all core rows where it holds
enough. So only neighbouring cells are compared, and of two crowded ones no more is asked than whether any rows
of theirs are near: representatives of ever smaller parts answer that, and what they leave open is small. Rows
are compared one by one only where one side is a cell with few rows; a heap of rows, even of equal ones, costs
its size and never its square.

Components: every round each vertex takes the smallest label among itself and its neighbours, then the label of
its label; the graph of the labels is what the next round works on, until one task can finish it. Rounds are
written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrid.functions.geo import R, distance_m
from skygrid.sources.scratch import written

#: Comparisons of two parts' rows that are made outright; above, the parts are split. Splits at most: coordinates differ by then.
PAIRS, SPLITS = 256, 40


#: Edges (16 bytes each, if ids are numbers) that one task joins into components; more are contracted first.
TASK_EDGES = 100_000


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(v, c) of undirected edges (a, b): c is the smallest vertex reachable."""
    now, labels = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    for _ in range(rounds):
        last = now.count() <= TASK_EDGES
        if last:
            step = now.coalesce(1).mapInArrow(_union_find, now.withColumnsRenamed({"a": "v", "b": "c"}).schema)
        else:
            ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = written(ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")))
            for _ in range(2):  # to the label of the label
                step = step.join(step.select(F.col("v").alias("c"), F.col("c").alias("up")), "c").select("v", F.col("up").alias("c"))
        step = written(step)
        to = lambda c: step.select(F.col("v").alias(c), F.col("c").alias("_to"))  # noqa: B023, E731
        labels = step if labels is None else written(labels.join(to("c"), "c", "left").select("v", F.coalesce("_to", "c").alias("c")))
        if last:
            return labels
        now = now.join(to("a"), "a").select(F.col("_to").alias("x"), "b").join(to("b"), "b").select(F.least("x", "_to").alias("a"), F.greatest("x", "_to").alias("b"))
        now = written(now.where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _union_find(batches):
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kinds = None
    for batch in batches:
        kinds = batch.schema.types
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    if kinds:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), kinds[0]), pa.array([find(v) for v in list(root)], kinds[1])], ["v", "c"])


@dataclass(frozen=True)
class Space:
    """What near means: at most ``eps`` by ``distance`` (of the columns of two structs).

    Cells have edges of ``side`` over ``dims``; no two rows of one are further apart than ``spread`` (at most eps), and
    rows near each other are at most ``reach`` cells apart along a dimension.
    """

    dims: tuple[str, ...]
    eps: float
    side: float
    reach: tuple[int, ...]
    spread: float
    distance: Callable[[Column, Column], Column]

    def cell(self, split: int = 0) -> Column:
        """The cell of a row, or its part after so many halvings of the edges."""
        return F.array(*(F.floor(F.col(c) * F.lit(2.0**split) / F.lit(self.side)).cast("long") for c in self.dims))

    def around(self, half: bool = False) -> Column:
        """Steps to the cells in reach, the own one included; half: each pair of cells once, without the own."""
        steps = product(*(range(-x, x + 1) for x in self.reach))
        zero = (0,) * len(self.dims)
        return F.array(*(F.array(*(F.lit(x).cast("long") for x in step)) for step in steps if not half or step > zero))


def on_earth(metres: float, half: float) -> Space:
    """Points (lon, lat) within metres of each other; half: degrees of longitude that hold the distance."""
    side = metres / (1.5 * 111_700)  # no degree is longer
    return Space(("lon", "lat"), metres, side, (math.ceil(half / side), math.ceil(metres / 110_500 / side)), metres * math.sqrt(2) / 1.5, lambda a, b: distance_m(a["lon"], a["lat"], b["lon"], b["lat"]))


def euclidean(dims: list[str], eps: float) -> Space:
    side = eps / math.sqrt(len(dims)) * 0.999
    square = lambda a, b: sum(((a[c] - b[c]) * (a[c] - b[c]) for c in dims), F.lit(0.0))
    return Space(tuple(dims), eps, side, (math.ceil(eps / side),) * len(dims), eps * 0.9995, lambda a, b: F.sqrt(square(a, b)))


def _whole(points: DataFrame, space: Space) -> DataFrame:
    """(id, dims, k) of the points whose coordinates are numbers, with their cells."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    kept = points.select("id", *(F.col(c).cast("double").alias(c) for c in space.dims))
    for c in space.dims:
        kept = kept.where(number(c))
    return kept.withColumn("k", space.cell())


def _joined_cells(rows: DataFrame, space: Space) -> DataFrame:
    """(v, c): cells, by their smallest ids, and the smallest one they reach over cells that hold rows near each other.

    rows: (home, id, dims) of distinct coordinates. Cells that are next to no other are left out. A pair of cells is
    looked at only until both are in one component, so crowded places are settled by the first representatives.
    """
    row = F.struct("id", *space.dims)

    def parts(split: int) -> DataFrame:
        return rows.groupBy("home", space.cell(split).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("r"))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{x}_{c}") for c in df.columns))

    def judged(pairs: DataFrame, split: int) -> DataFrame:
        """Pairs with near: true if their representatives are, false if they are too far for any rows of theirs, else null."""
        d = space.distance(F.col("x_r"), F.col("y_r"))
        apart = d > space.eps + 2.02 * space.spread / 2**split
        return written(pairs.withColumn("near", F.when(d <= space.eps, True).when(apart, False)).where("near is not false").drop("x_r", "y_r"))

    names, ends = None, ["x_home", "y_home"]

    def named(df: DataFrame) -> DataFrame:
        """Pairs of different components, with these (a, b)."""
        for end, to in (("x_home", "a"), ("y_home", "b")):
            df = df.drop(to) if names is None else df.drop(to).join(names.select(F.col("v").alias(end), F.col("c").alias(to)), end, "left")
            df = df.withColumn(to, F.col(end)) if names is None else df.withColumn(to, F.coalesce(to, end))
        return df.where("a <> b")

    def merge(links: DataFrame) -> None:
        """Joins the components (a, b) of links."""
        nonlocal names
        step = components(links)
        if names is None:
            names = step
        else:
            to = step.select(F.col("v").alias("c"), F.col("c").alias("_to"))
            alone = step.join(names.select("v"), "v", "left_anti")
            names = written(names.join(to, "c", "left").select("v", F.coalesce("_to", "c").alias("c")).unionByName(alone))

    cells = written(parts(0))
    step = F.explode(space.around(half=True))
    left = side(cells, "x").withColumn("_s", step).withColumn("y_k", F.zip_with("x_k", "_s", lambda k, s: k + s)).drop("_s")
    open_ = judged(left.join(side(cells, "y"), "y_k"), 0)
    merge(open_.where("near").select(F.col("x_home").alias("a"), F.col("y_home").alias("b")))
    for split in range(SPLITS + 1):
        open_ = written(named(open_.where("near is null")))
        if open_.isEmpty():
            break
        few = (F.col("x_n") * F.col("y_n") <= PAIRS) if split < SPLITS else F.lit(True)
        own = rows.select("home", space.cell(split).alias("k"), row.alias("r"))
        tried = open_.where(few).join(side(own, "x"), ["x_home", "x_k"]).join(side(own, "y"), ["y_home", "y_k"])
        merge(tried.where(space.distance(F.col("x_r"), F.col("y_r")) <= space.eps).select("a", "b"))
        many = open_.where(~few)
        if split == SPLITS or many.isEmpty():
            break
        finer = written(parts(split + 1).withColumn("up", F.transform("k", lambda x: F.floor(x / 2).cast("long"))))
        half = lambda x: side(finer, x).withColumnRenamed(f"{x}_up", f"{x}_k_")  # noqa: B023, E731
        pairs = named(many).select(*ends, "a", "b", F.col("x_k").alias("x_k_"), F.col("y_k").alias("y_k_"))
        open_ = judged(pairs.join(half("x"), ["x_home", "x_k_"]).join(half("y"), ["y_home", "y_k_"]).drop("x_k_", "y_k_"), split + 1)
        merge(open_.where("near").select("a", "b"))
    return names


def single_link(points: DataFrame, space: Space) -> DataFrame:
    """(id, cluster) of all points (id, dims): the smallest id reachable over near points; a point without a number for a coordinate is alone."""
    whole = _whole(points, space)
    homes = written(whole.groupBy("k").agg(F.min("id").alias("home")))
    rows = written(whole.groupBy("k", *space.dims).agg(F.min("id").alias("id")).join(homes, "k").drop("k"))
    named = homes.join(_joined_cells(rows, space).withColumnRenamed("v", "home"), "home", "left").select("k", F.coalesce("c", "home").alias("cluster"))
    own = whole.join(named, "k").select("id", "cluster")
    return own.unionByName(points.join(whole, "id", "left_anti").select("id", F.col("id").alias("cluster")))


def dbscan(points: DataFrame, space: Space, least: int) -> DataFrame:
    """(id, cluster) of points (id unique, dims): core points have ``least`` near ones, themselves included; null is noise.

    A border point goes to the cluster of its near core points that has the smallest first core id. A point without a
    number for a coordinate is noise.
    """
    whole = _whole(points, space)
    sizes = written(whole.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    placed = written(whole.join(sizes, "k"))
    row = F.struct(*space.dims)
    few = placed.where(F.col("n") < least).select("id", row.alias("r"), F.explode(space.around()).alias("_s"), "k").select("id", "r", F.zip_with("k", "_s", lambda k, s: k + s).alias("k"))

    def near(some: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of cells with few of them, next to all others near them."""
        return some.join(others.select("k", row.alias("o"), *(c for c in ("cluster",) if c in others.columns)), "k").where(space.distance(F.col("r"), F.col("o")) <= space.eps)

    enough = near(few, placed).groupBy("id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least)
    core = written(placed.where(F.col("n") >= least).unionByName(placed.where(F.col("n") < least).join(enough.select("id"), "id", "left_semi")).drop("n"))
    own = written(single_link(core.drop("k"), space))
    border = near(few.join(own, "id", "left_anti"), core.join(own, "id")).groupBy("id").agg(F.min("cluster").alias("near"))
    return points.select("id").join(own, "id", "left").join(border, "id", "left").select("id", F.coalesce("cluster", "near").alias("cluster"))


def sweep(points: DataFrame, space: Callable[[int], Space], radii: list[int]) -> DataFrame:
    """Per radius the number of clusters, of those with two points or more, and the size of the largest."""
    points, out = written(points), None
    for r in radii:
        n = single_link(points, space(r)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        row = n.agg(F.lit(r).alias("metres"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") >= 2).alias("linked"), F.max("n").alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out


def summary(members: DataFrame, least: int, registered_m: float) -> DataFrame:
    """One row a cluster of ``least`` members or more, the largest first (then by cluster).

    members: (cluster, lon, lat, state, priors, night, asset_m). Centre to five places; the commonest state, the
    smaller name if tied, null without any; the spread is the largest distance from the centre with both
    coordinates as angles on the sphere, unscaled; an asset that no member has in reach is null and not registered.
    """
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("detections"), F.avg("lon").alias("_x"), F.avg("lat").alias("_y"), F.max("priors").alias("max_priors"), F.round(F.avg(F.col("night").cast("double")), 3).alias("night_fraction"), F.min("asset_m").alias("_m")).where(F.col("detections") >= least)
    states = members.where("state is not null").groupBy("cluster", "state").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "state")).alias("s"))
    angle = F.sqrt(F.pow(F.radians(F.col("lat") - F.col("_y")), 2) + F.pow(F.radians(F.col("lon") - F.col("_x")), 2))
    far = members.join(size.select("cluster", "_x", "_y"), "cluster").groupBy("cluster").agg(F.max(angle * R).alias("_far"))
    out = size.join(far, "cluster").join(states, "cluster", "left")
    return out.select("cluster", F.round("_x", 5).alias("lon"), F.round("_y", 5).alias("lat"), F.col("s.state").alias("state"), "detections", "max_priors", "night_fraction", F.round("_m").cast("long").alias("nearest_asset_m"), F.coalesce(F.col("_m") <= registered_m, F.lit(False)).alias("registered"), F.round("_far").cast("long").alias("spread_m")).orderBy(F.desc("detections"), "cluster")


def density_sweep(points: DataFrame, space: Callable[[float], Space], radii: list[float], leasts: list[int]) -> DataFrame:
    """Per radius and least neighbourhood: clusters, points in them, points in none."""
    points, out = written(points), None
    for r in radii:
        for least in leasts:
            found = dbscan(points, space(r), least)
            row = found.agg(F.lit(r).alias("metres"), F.lit(least).alias("least"), F.countDistinct("cluster").alias("clusters"), F.count("cluster").alias("clustered"), F.count_if(F.col("cluster").isNull()).alias("noise"))
            out = row if out is None else out.unionByName(row)
    return out
