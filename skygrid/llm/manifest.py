"""Merkle manifest of a dataset: one leaf a row, a tree of fanout 8 for each lang, one tree over their roots.

A leaf's place in its lang is an exact rank without a global sort. Rows are counted by (lang, doc_id
without its lowest 12 bits), these counts are added up to ever shorter prefixes of the id, and the
running sums of a prefix's children, at most 4,096 of them, give every prefix its first rank. Only
rows of one last prefix are sorted, at most 4,096 ids. A prefix that holds far more rows than ids
(ids that repeat) is counted by (doc_id, leaf) instead, and the leaves' own digits rank what is left.

The rank in octal digits is the leaf's path in the tree. Rows are packed by rank without its last three
digits, 512 leaves a pack; a pack reduces three levels and is one node of the next trie, until a lang
has one node. Siblings then go down the same packs as strings, from the root to the leaves, where each
row's proof is hashed and its leaf folded back to the root. No group is larger than a pack, and leaves
are shuffled once to rank them and once to pack them. The tree over langs has a row a lang and is one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.llm.common import BROADCAST_BYTES, by_key, table

FANOUT, LEVELS = 8, 3
#: Bits of a digit of doc_id, and of a rank that a pack reduces.
DIGIT_BITS, PACK_BITS = 12, 3 * LEVELS
#: Rows of a last prefix beyond which they are counted by leaf: ids repeat there.
CROWDED = 16 << DIGIT_BITS
#: Bytes of a path from a pack to the root that the size check of a broadcast reckons with.
PATH_BYTES = 8_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(framed(values[c]) for c in FIELDS)), 256)


def levels_of(nodes: list[str], whole: bool) -> list[list[str]]:
    """Node lists from nodes upwards: to a single one if ``whole``, else LEVELS times."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= LEVELS:
        out.append([digest(*out[-1][i : i + FANOUT]) for i in range(0, len(out[-1]), FANOUT)])
    return out


def path_of(levels: list[list[str]], i: int) -> str:
    """Siblings of node i on each level below the top: before|after, levels joined by /."""
    steps = []
    for nodes in levels[:-1]:
        run = i // FANOUT * FANOUT
        steps.append("".join(nodes[run:i]) + "|" + "".join(nodes[i + 1 : run + FANOUT]))
        i //= FANOUT
    return "/".join(steps)


def fold(start: str, path: str) -> str:
    for step in path.split("/") if path else ():
        before, after = step.split("|")
        start = digest(before, start, after)
    return start


def _ahead(*keys: str, by: str = "p") -> Column:
    """Rows counted in the groups before this one among those that share the keys."""
    return F.sum("n").over(Window.partitionBy(*keys).orderBy(F.col(by).asc_nulls_first())) - F.col("n")


def ranked(rows: DataFrame) -> DataFrame:
    """Written rows (lang_key, doc_id, leaf, other) with ``at``: from 0 by (doc_id, leaf) in each lang, null ids first."""
    rows = rows.withColumn("p", F.coalesce(F.shiftright("doc_id", DIGIT_BITS), F.lit(-(1 << 63 - DIGIT_BITS) - 1)))  # null: below all others
    counts = [table(rows.groupBy("lang_key", "p").agg(F.count(F.lit(1)).alias("n")))]
    for _ in range(64 // DIGIT_BITS - 1):
        counts.append(counts[-1].groupBy("lang_key", F.shiftright("p", DIGIT_BITS).alias("p")).agg(F.sum("n").alias("n")))
    base = counts[-1].select("lang_key", "p", "n", _ahead("lang_key").alias("base"))  # of 64 bits four are left: 16 children and null's
    for level in reversed(counts[:-1]):
        up = base.select("lang_key", F.col("p").alias("up"), F.col("base").alias("above"))
        own = level.withColumn("up", F.shiftright("p", DIGIT_BITS)).withColumn("within", _ahead("lang_key", "up"))
        base = own.join(up, ["lang_key", "up"]).select("lang_key", "p", "n", (F.col("above") + F.col("within")).alias("base"))
    base = table(base)
    placed = by_key(rows, base.withColumnRenamed("n", "held"), ["lang_key", "p"])
    place = F.row_number().over(Window.partitionBy("lang_key", "p").orderBy(F.col("doc_id").asc_nulls_first(), "leaf"))
    columns = ("lang_key", "doc_id", "leaf", "other", "at")
    calm = placed.where(F.col("held") <= CROWDED).withColumn("at", F.col("base") + place - 1).select(*columns)
    if not base.where(F.col("n") > CROWDED).limit(1).count():
        return calm
    return calm.unionByName(_by_leaf(placed.where(F.col("held") > CROWDED)).select(*columns))


def _by_leaf(crowd: DataFrame) -> DataFrame:
    """Ranks where ids repeat: rows of one (doc_id, leaf) are alike, so they are counted and dealt out again."""
    keys, start = ["lang_key", "p", "base", "doc_id"], F.substring(F.hex("leaf"), 1, 3).alias("start")
    leaves = table(crowd.groupBy(*keys, "leaf", start).agg(F.count(F.lit(1)).alias("n"), F.first("other").alias("other")))
    starts = table(leaves.groupBy(*keys, "start").agg(F.sum("n").alias("n")))
    ids = starts.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("a", _ahead("lang_key", "p", by="doc_id")).select("lang_key", "p", F.col("doc_id").alias("i"), "a")
    starts = starts.withColumn("b", _ahead("lang_key", "p", "doc_id", by="start"))
    starts = starts.join(ids, (starts.lang_key == ids.lang_key) & (starts.p == ids.p) & starts.doc_id.eqNullSafe(ids.i)).select(starts.lang_key, starts.p, "start", "i", (F.col("a") + F.col("b")).alias("before"))
    own = leaves.withColumn("c", _ahead("lang_key", "p", "doc_id", "start", by="leaf"))
    own = own.join(starts, (own.lang_key == starts.lang_key) & (own.p == starts.p) & own.doc_id.eqNullSafe(starts.i) & (own.start == starts.start)).select(own.lang_key, "doc_id", "leaf", "other", "n", (F.col("base") + F.col("before") + F.col("c")).alias("first"))
    blocks = own.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CROWDED).cast("long")))).repartition("lang_key", "doc_id", "leaf", "from")
    return blocks.withColumn("at", F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + F.least(F.col("from") + CROWDED, F.col("n")) - 1)))


def _upwards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs to the nodes of the next trie."""
    for batch in batches:
        rows = batch.select(["lang_key", "pack", "total", "kids"]).to_pylist()
        nodes = [bytes.fromhex(levels_of([k["leaf"].hex() for k in r["kids"]], r["total"] <= 1 << PACK_BITS)[-1][0]) for r in rows]
        totals = [-(-r["total"] >> PACK_BITS) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("lang_key"), batch.column("pack"), pa.array(totals, pa.int64()), pa.array(nodes, pa.binary())], ["lang_key", "at", "total", "leaf"])


def _paths(row: dict) -> Iterator[tuple[dict, str]]:
    """A pack's kids with their siblings up to the root."""
    levels = levels_of([k["leaf"].hex() for k in row["kids"]], row["total"] <= 1 << PACK_BITS)
    for i, kid in enumerate(row["kids"]):
        yield kid, "/".join(p for p in (path_of(levels, i), row["path"]) if p)


def _downwards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang_key", pa.string()), ("pack", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("path", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([{"lang_key": row["lang_key"], "pack": kid["at"], "subroot": row["subroot"], "root": row["root"], "path": path} for kid, path in _paths(row)], schema)


def _proofs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in names), ("verified", pa.bool_())])
    for batch in batches:
        for row in batch.to_pylist():
            out = []
            for kid, path in _paths(row):
                own = kid["leaf"].hex()
                folded = fold(kid["other"].hex() if kid["other"] else own, path)
                out.append(dict(zip(names, (own, row["subroot"], row["root"], digest(path.replace("|", "").replace("/", "")), folded), strict=True)) | {"doc_id": kid["doc_id"], "verified": folded == row["root"]})
            yield pa.RecordBatch.from_pylist(out, schema)


def _root(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree over the subroots of all langs."""
    for batch in batches:
        for row in batch.to_pylist():
            langs = row["langs"] or []
            levels = levels_of([x["leaf"].hex() for x in langs], True)
            top = levels[-1][0] if langs else ""
            yield pa.RecordBatch.from_arrays([pa.array([x["lang_key"] for x in langs], pa.string()), pa.array([0] * len(langs), pa.int64()), pa.array([x["leaf"].hex() for x in langs], pa.string()), pa.array([top] * len(langs), pa.string()), pa.array([path_of(levels, i) for i in range(len(langs))], pa.string())], ["lang_key", "pack", "subroot", "root", "path"])


def _packs(nodes: DataFrame, *extra: str) -> DataFrame:
    kids = F.sort_array(F.collect_list(F.struct("at", "leaf", *extra)))
    return table(nodes.groupBy("lang_key", F.shiftright("at", PACK_BITS).alias("pack"), "total").agg(kids.alias("kids")))


def manifest(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text, lang, source, n_chars) with its leaf, roots, proof and check.

    Rows whose crc32(doc_id) is a multiple of 3 are tampered (their text lower-cased): ``verified``
    tells whether the leaf as it is now folds to the root. Null fields are framed as ``-``, empty ones
    as ``0:``; null lang is a lang of its own, the first. Null doc_id comes first in its lang and counts
    as the empty text for the crc. Rows with one doc_id follow each other by leaf; rows alike in all
    five fields take places in any order. Texts are hashed whole. Other columns are ignored, whatever
    their names. An empty table gives an empty one.
    """
    values = {c: docs[c] for c in FIELDS}
    tampered = values | {"text": F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    hit = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 3 == 0
    key = F.coalesce(F.concat(F.lit("+"), docs["lang"].cast("string")), F.lit(""))
    rows = table(docs.select(key.alias("lang_key"), docs["doc_id"].cast("long").alias("doc_id"), F.unhex(leaf(values)).alias("leaf"), F.when(hit, F.unhex(leaf(tampered))).alias("other")))
    totals = table(rows.groupBy("lang_key").agg(F.count(F.lit(1)).alias("total")))
    most = totals.agg(F.max("total")).head()[0] or 0
    levels = [_packs(by_key(ranked(rows), totals, "lang_key"), "doc_id", "other")]
    while True:
        nodes = table(levels[-1].mapInArrow(_upwards, "lang_key string, at long, total long, leaf binary"))
        most = -(-most >> PACK_BITS)
        if most <= 1:
            break
        levels.append(_packs(nodes))
    langs = nodes.agg(F.sort_array(F.collect_list(F.struct("lang_key", "leaf"))).alias("langs"))
    paths = table(langs.mapInArrow(_root, "lang_key string, pack long, subroot string, root string, path string"))
    met = lambda packs: packs.join(F.broadcast(paths) if paths.count() * PATH_BYTES <= BROADCAST_BYTES else paths, ["lang_key", "pack"])
    for packs in reversed(levels[1:]):
        paths = table(met(packs).mapInArrow(_downwards, "lang_key string, pack long, subroot string, root string, path string"))
    return met(levels[0]).mapInArrow(_proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
