"""Helpers shared by the training-data operators: scratch tables, words, hashes, grouped streams."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: A word is a run of bytes other than these; ``bytes.split()`` splits at exactly them.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: texts may be long, so a batch holds few of them.
BATCH_ROWS = 1000
#: Bytes of a key table that may be broadcast, at 48 a row and 16 a column; a larger one is joined by shuffle.
BROADCAST_BYTES = 64_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.skygrid.scratch", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.skygrid.scratch", base)
    return base.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def small_enough(keys: DataFrame) -> bool:
    """Whether a written table of fixed-size columns may be broadcast: its size is its rows, counted."""
    return keys.count() * (48 + 16 * len(keys.columns)) <= BROADCAST_BYTES


def by_key(df: DataFrame, keys: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join df with a written key table: broadcast up to BROADCAST_BYTES, else shuffled."""
    return df.join(F.broadcast(keys) if small_enough(keys) else keys, on, how)


def text_hash(text: Column) -> Column:
    """64-bit hash that tells apart rows with one doc_id (null: as the empty text)."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, all other characters unchanged."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours (needs len >= k)."""
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out)


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; a shorter text is one shingle, an empty one none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return rolling(word_hashes(words), k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w neighbours, by doubling (needs len >= w)."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one array a row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    if kind == pa.int64() and flat.dtype == np.uint64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of a stream that is sorted by keys: (key, column lists). Holds one group at a time."""
    at, held = None, [[] for _ in columns]
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in columns]
        ks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(1, len(ks) + 1):
            if i == len(ks) or ks[i] != ks[start]:
                if at is not None and ks[start] != at:
                    yield at, held
                    held = [[] for _ in columns]
                at = ks[start]
                for h, c in zip(held, cols, strict=True):
                    h += c[start:i]
                start = i
    if at is not None:
        yield at, held


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by keys and sorted by them inside each partition, for ``grouped``."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Edges (16 bytes each) that one task may join into components; more go through rounds.
TASK_EDGES = 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of a written table of edges (a, b): rows (v, c), c the smallest vertex reachable.

    Up to TASK_EDGES edges: one union-find. More: min-label propagation with pointer jumping, every round
    of which is written to the shared folder.
    """
    if edges.limit(TASK_EDGES + 1).count() <= TASK_EDGES:
        return table(edges.select("a", "b").coalesce(1).mapInArrow(_union_find, "v long, c long"))
    both = table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = table(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("w"), F.col("c").alias("up"))
        new = table(step.join(jump, F.col("c") == F.col("w"), "left").select("v", "was", F.least("c", "up").alias("c")))
        labels = new.select("v", "c")
        if not new.where("c <> was").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _union_find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(v) for v in list(root)], pa.int64())], ["v", "c"])
