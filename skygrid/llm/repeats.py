"""Finding repeated fixed-length windows by super-k-mers; shared by the two substring operators.

A document is a sequence of units (words or bytes). The minimiser of a window is its gram with the
smallest hash, the leftmost if tied; consecutive windows with the same minimiser form one run.
Equal windows have equal minimisers at equal places, so they meet under the minimiser's hash.

1. ``repeated_keys``: each partition adds up its minimisers (a key that it sees twice is one row for
   the others, however frequent); one shuffle finds the keys that occur twice anywhere.
2. ``segments``: the runs of repeated keys travel, each as one packed string, to their key's bucket.
   A partition sends a string once. Keys above ``HOT`` occurrences are split: their windows travel
   alone, each to a bucket of its own content, so no bucket grows with a common passage.
3. The operator resolves buckets to spans; ``with_spans`` brings these back to their documents.

A document is known by (doc_id, hash of its text); rows that repeat both are one document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from skygrid.llm.common import by_key, mix, rolling, sliding_min, table, word_hashes, words_of

#: Occurrences above which a key is hot, at any size of the corpus.
HOT = 20_000
#: Keys and strings that a partition adds up before it sends them on; bounds its memory.
BLOCK_KEYS, BLOCK_STRINGS = 2_000_000, 150_000
#: Windows handled at a time, so that a very long text is cut into overlapping parts.
CHUNK = 1 << 19
#: Bytes of packed strings that a bucket partition is meant to hold.
BUCKET_BYTES = 16_000_000
_PLACE = np.uint64((1 << 20) - 1)


@dataclass(frozen=True)
class Units:
    """How texts become units: ``words`` or bytes; windows of ``window`` units, grams of ``gram``."""

    words: bool
    window: int
    gram: int

    def split(self, text: str | None) -> list[bytes] | bytes:
        return words_of(text) if self.words else (text or "").encode("utf-8", "surrogatepass")

    def pack(self, units, start: int, end: int) -> bytes:
        return b" ".join(units[start:end]) if self.words else units[start:end]

    def hashes(self, units) -> np.ndarray:
        """Hash of each gram (needs len >= gram)."""
        if self.words:
            return rolling(word_hashes(units), self.gram)
        h, power, k = mix(np.frombuffer(units, np.uint8).astype(np.uint64)), np.uint64(0x9E3779B97F4A7C15), 1
        while 2 * k <= self.gram:
            h, k = h[:-k] * power + h[k:], 2 * k
            with np.errstate(over="ignore"):
                power = power * power
        rest = self.gram - k  # the first k units and the last k, which may overlap
        return mix(h[: len(h) - rest] * power + h[rest:]) if rest else mix(h)

    def runs(self, units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs in order: key, first window, last window + 1."""
        n = len(units) - self.window + 1
        if n < 1:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        keys, first, last = [], [], []
        for c in range(0, n, CHUNK):
            end = min(n, c + CHUNK)
            h = self.hashes(units[c : end + self.window - 1])
            place = (sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), self.window - self.gram + 1) & _PLACE).astype(np.int64)
            at = np.flatnonzero(np.diff(place, prepend=-1))
            keys.append(h[place[at]])
            first.append(at + c)
            last.append(np.append(at[1:], end - c) + c)
        return np.concatenate(keys), np.concatenate(first), np.concatenate(last)


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, th) of docs, th a 64-bit hash of the text (null: empty)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def repeated_keys(docs: DataFrame, units: Units) -> DataFrame:
    """(key, doc_id, th, n, total) of keys that occur twice or more.

    n = 0 or 1: the document has the key. n >= 2: a partition's count, without a document; the
    totals are the same for all rows of a key with n > 0.
    """

    def run(batches):
        held, size = [], 0

        def flush():
            if not held:
                return
            key = np.concatenate([k for k, _, _, _ in held])
            doc = np.repeat(np.arange(len(held)), [len(k) for k, _, _, _ in held])
            count = np.concatenate([c for _, c, _, _ in held])
            order = np.argsort(key, kind="stable")
            key, doc, count = key[order], doc[order], count[order]
            start = np.flatnonzero(np.diff(key, prepend=~key[:1]))
            total = np.add.reduceat(count, start)
            many = np.repeat(total > 1, np.diff(start, append=len(key)))
            ids, ths = [h[2] for h in held], np.array([h[3] for h in held], np.int64)
            for at in range(0, len(key), 100_000):
                part = slice(at, at + 100_000)
                k, d, m = key[part], doc[part], many[part]
                yield pa.RecordBatch.from_arrays([_signed(np.where(m, mix(d.astype(np.uint64)), k)), _signed(k), pa.array([ids[i] for i in d.tolist()], pa.int64()), pa.array(ths[d]), pa.array(np.where(m, 0, 1).astype(np.int64))], ["at", "key", "doc_id", "th", "n"])
            k, n = key[start][total > 1], total[total > 1]
            yield pa.RecordBatch.from_arrays([_signed(k), _signed(k), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(n.astype(np.int64))], ["at", "key", "doc_id", "th", "n"])
            held.clear()

        for batch in batches:
            for d, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text").to_pylist(), strict=True):
                keys = units.runs(units.split(text))[0]
                if len(keys):
                    own, count = np.unique(keys, return_counts=True)
                    held.append((own, count, d, th))
                    size += len(own)
                    if size > BLOCK_KEYS:
                        yield from flush()
                        size = 0
        yield from flush()

    found = docs.mapInArrow(run, "at long, key long, doc_id long, th long, n long")
    return found.withColumn("total", F.sum("n").over(Window.partitionBy("at"))).where("n = 0 or total > 1").drop("at")


def segments(docs: DataFrame, units: Units, every: bool) -> tuple[DataFrame, int]:
    """Packed strings of repeated keys by bucket, and the number of bucket partitions they call for.

    Rows (key, doc_id, th, start, end, n, packed): n occurrences in the partition, of which this is
    the earliest. Rows without packed are spans that the partition already knows to be repeated: all
    occurrences of a string it has seen twice if ``every``, else all but the earliest.
    """
    keys = table(repeated_keys(docs, units))
    seen = keys.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = table(keys.where((F.col("n") > 0) & (F.col("total") > HOT)).select("key").distinct().withColumn("hot", F.lit(True)))
    own = by_key(keys.where("n < 2"), hot, "key", "left").groupBy("doc_id", "th").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("hot"), F.col("key"))).alias("hots"))
    at = docs["doc_id"].eqNullSafe(F.col("d")) & (docs["th"] == F.col("h"))
    rows = docs.join(own.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "keys", "hots"), at).select("doc_id", "th", "text", "keys", "hots")
    W = units.window

    def run(batches):
        block: dict[bytes, list] = {}
        size = 0

        def flush():
            out, spans = [], []
            for packed, found in block.items():
                key, where = found[0], sorted(set(found[1:]))
                null, d, th, start, end = where[0]
                out.append((key, None if null else d, th, start, end, len(where), packed))
                for null, d, th, start, end in where[0 if every else 1 :] if len(where) > 1 else []:
                    spans.append((0, None if null else d, th, start, end, 0, None))
            spans.sort(key=lambda s: (s[1] is None, s[1] or 0, s[2], s[3]))
            joined = []
            for s in spans:  # overlapping spans of a document are one
                if joined and joined[-1][1:3] == s[1:3] and s[3] <= joined[-1][4]:
                    joined[-1] = (*joined[-1][:4], max(s[4], joined[-1][4]), 0, None)
                else:
                    joined.append(s)
            out += [(xxh64_intdigest(str(s[1:4])) - (1 << 63), *s[1:]) for s in joined]
            block.clear()
            for at in range(0, len(out), 20_000):
                cols = list(zip(*out[at : at + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "doc_id", "th", "start", "end", "n", "packed"])

        for batch in batches:
            ids, ths, texts, lists, hots = (batch.column(c) for c in ("doc_id", "th", "text", "keys", "hots"))
            for i in range(batch.num_rows):
                u, d, th = units.split(texts[i].as_py()), ids[i].as_py(), ths[i].as_py()
                wanted = set(lists[i].values.to_numpy().view(np.uint64).tolist())
                hot = set(hots[i].values.to_numpy(zero_copy_only=False).tolist())
                where = (d is None, d or 0, th)
                for key, a, b in zip(*(x.tolist() for x in units.runs(u)), strict=True):
                    if key in wanted:
                        signed = key - (1 << 64) if key >> 63 else key
                        if signed in hot:
                            for s in range(a, b):
                                packed = units.pack(u, s, s + W)
                                block.setdefault(packed, [xxh64_intdigest(packed) - (1 << 63)]).append((*where, s, s + W))
                            size += b - a
                        else:
                            block.setdefault(units.pack(u, a, b + W - 1), [signed]).append((*where, a, b + W - 1))
                            size += 1
                if size > BLOCK_STRINGS:
                    yield from flush()
                    size = 0
        yield from flush()

    found = rows.mapInArrow(run, "key long, doc_id long, th long, start long, end long, n long, packed binary")
    per = 2 * units.window * (7 if units.words else 1)
    return found, max(1, -(-seen * per // BUCKET_BYTES))


def with_spans(docs: DataFrame, spans: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """docs mapped by ``finish(doc_id, text, spans)`` to rows of schema; spans: (start, end) pairs in order, in units."""
    own = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = docs.join(own.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "spans"), docs["doc_id"].eqNullSafe(F.col("d")) & (docs["th"] == F.col("h")), "left").select("doc_id", "text", "spans")
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[f.strip().split(" ")[1]] for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            out = []
            ids, texts, lists = (batch.column(c) for c in ("doc_id", "text", "spans"))
            for i in range(batch.num_rows):
                own = lists[i].values
                pairs = list(zip(own.field(0).to_pylist(), own.field(1).to_pylist(), strict=True)) if own is not None else []
                out.append(finish(ids[i].as_py(), texts[i].as_py(), pairs))
            cols = zip(*out, strict=True) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], fields)

    return rows.mapInArrow(run, schema)


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; spans that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
