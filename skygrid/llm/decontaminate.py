"""Benchmark decontamination by SimHash windows.

For each benchmark item, the windows of a document as long as the item (in words) that share a
shingle with it get 64-bit SimHashes. A multi-index of bit blocks finds every item fingerprint within
the radius: two that differ in at most RADIUS bits differ in one of BLOCKS blocks by at most
RADIUS // BLOCKS, and all values that near are looked up; about one in twenty unrelated fingerprints
passes. What it finds is verified by exact similarity of the shingles weighted by their counts.

The items are a stated query set: they are read in blocks of bounded size, each sent to all tasks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.llm.common import by_key, lower_words, mix, shingles, small_batches, table, text_hash

#: Items sent to the tasks at a time.
ITEMS = 5_000
#: Bits in which fingerprints may differ, and blocks: two within the radius differ in a block by RADIUS // BLOCKS at most.
#: At similarity 0.8 fingerprints differ in about 10 bits (standard deviation 2.9).
RADIUS, BLOCKS = 14, 5


def simhashes(tokens: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SimHash of the m tokens from each start: bit by bit the sign of the sum over the tokens' hash bits."""
    lo = int(starts.min())
    part = tokens[lo : int(starts.max()) + m]
    signs = np.unpackbits(mix(part).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    run = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(signs, 0)])
    return np.packbits(run[starts - lo + m] - run[starts - lo] > 0, axis=1).view(np.uint64).ravel()


def blocks(count: int = BLOCKS) -> list[tuple[int, int]]:
    """(shift, bits) of runs of bits that cover all 64."""
    edge = np.linspace(0, 64, count + 1).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def flips(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most ``most`` of them set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.int64)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller over sum of the larger weights."""
    both = sum(min(c, b[x]) for x, c in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class ItemIndex:
    """Items of one word count n: shingles, fingerprints and the multi-index over them.

    A block's table lists the items by their value of the block; a search looks up all values that differ
    from the window's in at most RADIUS // BLOCKS bits.
    """

    def __init__(self, n: int, k: int, items: list[tuple[int, np.ndarray]]):
        self.n, self.m, self.items = n, max(1, n - k + 1), items
        self.prints = np.array([simhashes(s, np.zeros(1, np.int64), self.m)[0] for _, s in items], np.uint64)
        self.weights = [Counter(s.tolist()) for _, s in items]
        self.tables = []
        for shift, bits in blocks():
            value = ((self.prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.tables.append((shift, bits, flips(bits, RADIUS // BLOCKS), order, np.searchsorted(value[order], np.arange((1 << bits) + 1)).astype(np.int32)))

    def candidates(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """(place in prints, item) of the pairs that are near in a block."""
        found = set()
        for shift, bits, flip, order, first in self.tables:
            probe = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)[:, None] ^ flip
            row, at = np.nonzero(first[probe + 1] > first[probe])
            for r, v in zip(row.tolist(), probe[row, at].tolist(), strict=True):
                found.update((r, i) for i in order[first[v] : first[v + 1]].tolist())
        return sorted(found)

    def near(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(place in prints, item, Hamming distance) of all fingerprints within the radius."""
        out = []
        for at in range(0, len(prints), 4096):
            pairs = self.candidates(prints[at : at + 4096])
            if pairs:
                w, i = np.array(pairs).T
                d = np.bitwise_count(prints[at + w] ^ self.prints[i])
                out += [(at + x, y, z) for x, y, z in zip(w.tolist(), i.tolist(), d.tolist(), strict=True) if z <= RADIUS]
        return out


def _finder(items: list[tuple[int, list[bytes]]], k: int, similarity: float):
    by_length = defaultdict(list)
    for item, words in items:
        if words:
            by_length[len(words)].append((item, shingles(words, min(len(words), k))))  # hashed as find does
    index = {n: ItemIndex(n, k, own) for n, own in by_length.items()}
    seeds = {}  # words of a shingle: sorted shingles, and the word counts of the items that have each
    for kk in {min(n, k) for n in index}:
        where = defaultdict(set)
        for n, own in by_length.items():
            if min(n, k) == kk:
                for _, s in own:
                    for x in s.tolist():
                        where[x].add(n)
        keys = np.array(sorted(where), np.uint64)
        seeds[kk] = (keys, [sorted(where[x]) for x in keys.tolist()])

    def find(text: str | None) -> dict[int, tuple]:
        """Best (similarity, -start, n, distance) by item."""
        words, best = lower_words(text), {}
        for kk, (keys, lengths) in seeds.items():
            if len(words) < kk:
                continue
            own = shingles(words, kk)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hits = np.flatnonzero(keys[at] == own)
            starts = defaultdict(list)
            for p in hits.tolist():
                for n in lengths[at[p]]:
                    starts[n].append(p)
            for n, ps in starts.items():
                x = index[n]
                p = np.unique(np.concatenate([np.arange(max(0, p - x.m + 1), min(p, len(words) - n) + 1) for p in ps]))
                if not len(p):
                    continue
                for part in np.split(p, np.flatnonzero(np.diff(p) > 4 * n) + 1):
                    weights: dict[int, Counter] = {}
                    for w, i, d in x.near(simhashes(own, part, x.m)):
                        start = int(part[w])
                        if w not in weights:
                            weights[w] = Counter(own[start : start + x.m].tolist())
                        s = weighted_similarity(weights[w], x.weights[i])
                        if s >= similarity and (s, -start, n, d) > best.get(x.items[i][0], (-1.0,)):
                            best[x.items[i][0]] = (s, -start, n, d)
        return best

    return find


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """As ``keyed_matches``, without the hash of the text."""
    return keyed_matches(docs, benchmark, k, similarity).drop("th")


def keyed_matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per document and item found in it: (doc_id, th, item_id, start_word, n_words, hamming, similarity), the best window.

    ``th`` hashes the text, so that a clean text of the same doc_id is told apart.

    Null or empty texts match nothing, on either side; an item of fewer than k words is one shingle. Texts
    are searched whole, however long; of windows of equal similarity the first counts. A document stored
    twice gives its rows twice; rows that repeat an item_id are one item with several texts, and give one row.
    Empty tables give an empty one; extra columns take no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = table(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null"))
    count = -(-items.count() // ITEMS)
    out = None
    for b in range(max(1, count)):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(max(1, count))) == b).orderBy("item_id", "text").collect()
        own = spark.sparkContext.broadcast([(r.item_id, lower_words(r.text)) for r in rows])

        def run(batches, own=own):
            find = _finder(own.value, k, similarity)
            for batch in batches:
                found = [(d, th, i, -p, n, h, s) for d, th, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True) for i, (s, p, n, h) in find(t).items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 7, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()], strict=True)], ["doc_id", "th", "item_id", "start_word", "n_words", "hamming", "similarity"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, th long, item_id long, start_word long, n_words long, hamming int, similarity double")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, text) holds an item, by ``keyed_matches``; null is a doc_id like any other.

    From ``matches``, which does not tell the texts of a doc_id apart, all rows of the doc_id go.
    """
    keyed = "th" in found.columns
    bad = table(found.select(F.col("doc_id").alias("_bad"), (F.col("th") if keyed else F.lit(0).cast("long")).alias("_th")).distinct())
    on = docs["doc_id"].cast("long").eqNullSafe(bad["_bad"])
    return by_key(docs, bad, on & (text_hash(docs["text"]) == bad["_th"]) if keyed else on, "left_anti")
