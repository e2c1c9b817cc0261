"""Sharding by k-d tree: recursive weighted-median splits along the widest metadata dimension.

A node that must become k shards is split so that its left part holds floor(k/2)/k of its bytes. The
rows of a node are in the order of (value in the dimension, draw), the draw being a 60-bit hash of the row,
so a value that a third of the rows share is cut as well as any other; the cut is exact: a row is on the
left if the middle of its bytes is. It is found by histograms of 4,096 bins, each inside the bin that
held the cut before: first over values until the bin has one value, then over draws until it has one
row. However large or lopsided a node or one of its values is, a pass is one sum a task and bin.

Every level is written to the shared folder, so plans stay small. Only node summaries (a few numbers
a node, at most as many nodes as shards) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.llm.common import table, utf8_bytes

BINS = 4096
DIMS = 4
#: Bits of a draw; the upper 36 depend on doc_id and text, the lower 24 tell apart rows that repeat both.
DRAW_BITS = 60
#: Hash ranges of a shard that are numbered apart.
PARTS = 256


def _small(rows: DataFrame, columns: str, values: list[tuple]) -> DataFrame:
    """A literal table (at most one row a node) as a broadcast side."""
    body = ", ".join("(" + ", ".join(f"{v!r}D" if isinstance(v, float) else f"{v}L" for v in row) + ")" for row in values)
    return F.broadcast(rows.sparkSession.sql(f"SELECT * FROM VALUES {body} AS t({columns})"))


def tree(shards: int) -> list[dict[int, tuple[int, int]]]:
    """Levels of the tree: node -> (shards it must become, the first of them). The root is 1; children of n are 2 n and 2 n + 1."""
    levels = [{1: (shards, 0)}]
    while any(k > 1 for k, _ in levels[-1].values()):
        nodes = {}
        for n, (k, first) in levels[-1].items():
            if k > 1:
                nodes[2 * n], nodes[2 * n + 1] = (k // 2, first), (k - k // 2, first + k // 2)
            else:
                nodes[n] = (k, first)
        levels.append(nodes)
    return levels


def _cuts(rows: DataFrame, nodes: dict[int, tuple[int, int]]) -> dict[int, tuple[int, float, int]]:
    """For each node to split that has rows: the dimension (from 0), and value and draw below which its left part lies."""
    active = rows.join(_small(rows, "node", [(n,) for n, (k, _) in nodes.items() if k > 1]), "node", "left_semi")
    sides = [f(F.element_at("x", i + 1)).alias(f"{n}{i}") for i in range(DIMS) for n, f in (("lo", F.min), ("hi", F.max))]
    spread = active.groupBy("node").agg(F.sum("size").alias("bytes"), *sides).collect()
    whole = [max((r[f"hi{i}"] for r in spread), default=0) - min((r[f"lo{i}"] for r in spread), default=0) for i in range(DIMS)]
    # a node's state: dimension, range of values, range of draws (shift: bits of a bin; None while values are searched), bytes before
    dim, values, draws, before, total, done = {}, {}, {}, {}, {}, {}
    for r in spread:
        n = r["node"]
        dim[n] = max(range(DIMS), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"]) / whole[i] if whole[i] else 0)
        values[n], draws[n] = (r[f"lo{dim[n]}"], r[f"hi{dim[n]}"]), (0, None) if r[f"lo{dim[n]}"] < r[f"hi{dim[n]}"] else (0, DRAW_BITS - 12)
        before[n], total[n] = 0, r["bytes"]
    while len(done) < len(dim):
        todo = [n for n in dim if n not in done]
        state = [(n, dim[n], float(values[n][0]), float(values[n][1]), (values[n][1] - values[n][0]) / (BINS - 1), draws[n][0], -1 if draws[n][1] is None else draws[n][1], before[n], nodes[n][0], 2 * total[n] * (nodes[n][0] // 2)) for n in todo]
        plan = _small(rows, "node, dim, low, high, width, first, shift, base, k, need", state)
        value = F.element_at("x", (F.col("dim") + 1).cast("int"))
        found = active.join(plan, "node").withColumn("x", value).where(F.col("x").between(F.col("low"), F.col("high")) & ((F.col("shift") < 0) | (F.col("draw") >= F.col("first"))))
        by_value = F.floor((F.col("x") - F.col("low")) / F.nullif("width", F.lit(0.0)))
        found = found.withColumn("bin", F.when(F.col("shift") < 0, by_value).otherwise(F.expr("shiftright(draw - first, CAST(shift AS INT))"))).where((F.col("shift") < 0) | (F.col("bin") < BINS))
        bins = found.groupBy("node", "base", "k", "need", "bin").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("draw").alias("d0"), F.max("draw").alias("d1"))
        run = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        upto = bins.withColumn("upto", F.col("base") + F.sum("s").over(run))
        # the first bin that the cut is in or before, else the last one
        inside = (F.col("k") * F.col("upto") * 2 > F.col("need")).cast("int")
        hit = upto.groupBy("node").agg(F.min_by(F.struct("bin", "upto", "s", "m", "lo", "hi", "d0", "d1"), F.struct(1 - inside, F.when(inside == 1, F.col("bin")).otherwise(-F.col("bin")))).alias("h")).collect()
        for r in hit:
            n, h = r["node"], r["h"]
            k, need = nodes[n][0], 2 * total[n] * (nodes[n][0] // 2)
            before[n] = h["upto"] - h["s"]
            if h["m"] == 1 or draws[n][1] == 0 or (h["lo"] == h["hi"] and h["d0"] == h["d1"]):
                left = k * (2 * before[n] + h["s"]) <= need
                done[n] = (dim[n], float(h["hi"]), h["d1"] + 1 if left else h["d0"])
            elif draws[n][1] is not None:
                draws[n] = (draws[n][0] + (h["bin"] << draws[n][1]), draws[n][1] - 12)
            else:
                values[n] = (h["lo"], h["hi"])
                if h["lo"] == h["hi"]:
                    draws[n] = (0, DRAW_BITS - 12)
    return done


def _draw(doc_id: Column, crc: Column) -> Column:
    """Bits 24 to 59: md5 of doc_id and text; bits 0 to 23: of the row's number, drawn once as the table is written."""
    own = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), crc.cast("string")).cast("binary")), 1, 9), 16, 10).cast("long")
    return F.shiftleft(own, 24) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 24))


def shard(docs: DataFrame, shards: int = 40, passthrough: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) and the passthrough columns of docs.

    Law ``bytes``: the shards' sizes are as near equal as whole documents allow: a cut is off by at most
    half the document that it falls on. Size: UTF-8 bytes of the text (null: none) plus 16. Slots count
    from 0 without gaps in each shard. Rows that repeat a doc_id or all their columns are rows of their
    own, cut and numbered like others. Null lang, source or doc_id are values like any other. With fewer
    rows than shards some shards are empty; an empty table gives an empty one. passthrough columns keep
    their names and must not be called like a result column (ValueError).
    """
    result = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    if clash := set(passthrough) & set(result):
        raise ValueError(f"passthrough columns called like result columns: {sorted(clash)}")
    crc = F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    code = lambda c: (F.crc32(F.coalesce(docs[c].cast("string"), F.lit("")).cast("binary")) % 1024).cast("double")
    size = utf8_bytes(docs["text"]) + 16
    kept = F.struct(docs["doc_id"].alias("doc_id"), *(docs[c] for c in passthrough)).alias("kept")
    x = F.array(size.cast("double"), F.length(F.coalesce(docs["text"], F.lit(""))).cast("double"), code("lang"), code("source"))
    rows = table(docs.select(kept, size.alias("size"), crc.alias("crc"), _draw(docs["doc_id"], crc).alias("draw"), x.alias("x"), F.lit(1).cast("long").alias("node")))
    levels = tree(shards)
    for nodes in levels[:-1]:
        cuts = _cuts(rows, nodes)
        if not cuts:
            break
        plan = _small(rows, "node, dim, cut, from_draw", [(n, *cut) for n, cut in cuts.items()])
        value = F.element_at("x", (F.col("dim") + 1).cast("int"))
        right = ((value > F.col("cut")) | (value == F.col("cut")) & (F.col("draw") >= F.col("from_draw"))).cast("long")
        rows = table(rows.join(plan, "node", "left").withColumn("node", F.coalesce(F.col("node") * 2 + right, "node")).drop("dim", "cut", "from_draw"))
    rows = rows.join(_small(rows, "node, shard", [(n, first) for n, (_, first) in levels[-1].items()]), "node")
    # slots: offsets of hash ranges in each shard, so that no task numbers a whole shard
    rows = rows.withColumn("part", F.shiftright("draw", DRAW_BITS - 8))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "part").orderBy("draw")
    out = rows.join(F.broadcast(offsets), ["shard", "part"])  # at most shards * PARTS rows
    return out.select("kept.*", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.row_number().over(own) - 1 + F.col("base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
