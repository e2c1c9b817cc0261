"""Suffix-array dedup: a logarithmic family of suffix arrays in each bucket.

Packed strings reach their bucket partition in document order. New strings gather in a batch; the batch
gets a suffix array (of the starts of whole windows, ordered by their bytes), is merge-scanned
against the array of every existing level for matches of the whole length, and what is new becomes
a level. Levels of about equal size merge, so there are few and each byte is merged a logarithmic
number of times. The scan finds where a suffix belongs, so a merge takes linear time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.llm.common import small_batches
from skygrid.llm.repeats import Units, merged, named, segments, with_spans

#: Bytes of strings in a batch.
BATCH_BYTES = 1 << 20


def heads(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number (zeros after the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


class SuffixArray:
    """Starts of windows of a text, sorted by the window's bytes."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, head: np.ndarray, lead: np.ndarray):
        self.text, self.starts, self.head, self.lead = text, starts, head, lead  # lead: the first eight bytes, sorted

    def __len__(self) -> int:
        return len(self.starts)


def offsets(length: int) -> list[int]:
    """Places after the first eight bytes at which eight more are compared (needs length >= 8)."""
    return sorted({*range(8, length - 7, 8), length - 8} - {0})


def build(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[SuffixArray, np.ndarray]:
    """The suffix array of distinct windows, and the starts whose window also starts earlier in ``starts``."""
    head = heads(text)
    order = np.argsort(head[starts], kind="stable")
    sa, lead = starts[order], head[starts[order]]
    new = np.diff(lead, prepend=~lead[:1]) != 0
    for off in offsets(length):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        group, word = np.cumsum(new)[tied], head[sa[tied] + off]
        again = np.lexsort((word, group))
        sa[tied], word, group = sa[tied[again]], word[again], group[again]
        new[tied] |= np.append(True, (np.diff(word) != 0) | (np.diff(group) != 0))
    return SuffixArray(text, sa[new], head, lead[new]), sa[~new]


def _bisect(level: SuffixArray, lo: np.ndarray, hi: np.ndarray, off: int, word: np.ndarray, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        value = level.head[level.starts[mid] + off]
        up = value <= word[live] if right else value < word[live]
        lo[live[up]], hi[live[~up]] = mid[up] + 1, mid[~up]
        live = live[lo[live] < hi[live]]
    return lo


def scan(level: SuffixArray, new: SuffixArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-scan: where each suffix of new belongs in level, and whether its whole window is there."""
    lo, hi = np.searchsorted(level.lead, new.lead, "left"), np.searchsorted(level.lead, new.lead, "right")
    live = np.flatnonzero(lo < hi)
    for off in offsets(length):
        word = new.head[new.starts[live] + off]
        a = _bisect(level, lo[live], hi[live], off, word, False)
        b = _bisect(level, a, hi[live], off, word, True)
        lo[live], hi[live] = a, b
        live = live[a < b]
    return lo, lo < hi


def merge(level: SuffixArray, new: SuffixArray, length: int) -> SuffixArray:
    """One array of both; no window of new may be in level."""
    at, _ = scan(level, new, length)
    return SuffixArray(np.concatenate([level.text, new.text]), np.insert(level.starts, at, new.starts + len(level.text)), np.concatenate([level.head, new.head]), np.insert(level.lead, at, new.lead))


class Family:
    """The logarithmic family: ``add`` reports the starts of a text whose window came before."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def add(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return starts
        new, again = build(text, starts, self.length)
        for level in self.levels:
            _, found = scan(level, new, self.length)
            again = np.concatenate([again, new.starts[found]])
            new = SuffixArray(new.text, new.starts[~found], new.head, new.lead[~found])
        if len(new):
            while self.levels and len(self.levels[-1]) <= 2 * len(new):
                new = merge(self.levels.pop(), new, self.length)
            self.levels.append(new)
        return np.sort(again)


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = 32) -> DataFrame:
    """(doc_id, th, start, end): byte spans of windows that also start earlier. docs: of ``named``."""
    found, n = segments(docs, Units(False, length, gram), every=False)
    dealt = found.repartition(n, "key").sortWithinPartitions(F.col("packed").isNotNull(), F.asc_nulls_last("doc_id"), "th", "start")

    def run(batches):
        family, seen, held, size = Family(length), {}, [], 0

        def table_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "th", "start", "end"])

        def flush():
            text = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
            base = np.cumsum([0] + [len(h[3]) for h in held])
            windows = [len(h[3]) - length + 1 for h in held]
            starts = np.repeat(base[:-1], windows) + np.arange(sum(windows)) - np.repeat(np.cumsum([0] + windows[:-1]), windows)
            again = family.add(text, starts)
            row = np.searchsorted(base, again, "right") - 1
            cut = np.flatnonzero((np.diff(again, prepend=-9) != 1) | (np.diff(row, prepend=-1) != 0))
            out = []
            for a, b in zip(cut.tolist(), np.append(cut, len(again))[1:].tolist(), strict=True):
                d, th, start, _ = held[row[a]]
                first = int(again[a] - base[row[a]])
                out.append((d, th, start + first, start + first + (b - a) + length - 1))
            held.clear()
            if out:
                yield table_of(out)

        for batch in batches:
            out = []
            for d, th, start, end, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "start", "end", "packed")), strict=True):
                if packed is None:
                    out.append((d, th, start, end))
                elif seen.setdefault(packed, (d, th, start)) == (d, th, start):
                    if not held or held[-1][:3] != (d, th, start):
                        held.append((d, th, start, packed))
                        size += len(packed)
                else:  # the whole string came before
                    out.append((d, th, start, end))
            if out:
                yield table_of(out)
            if size > BATCH_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return dealt.mapInArrow(run, "doc_id long, th long, start long, end long")


def dedup(docs: DataFrame, length: int = 100, gram: int = 32) -> DataFrame:
    """Per document (doc_id, n_bytes, n_removed, n_spans, kept_sha256) without bytes of strings seen earlier.

    A string of ``length`` bytes (UTF-8) of one document is removed if it also starts earlier: in a document
    with a smaller doc_id (a null one is the largest; equal ones by hash of the text), or before in the
    same document. Null texts are empty. Rows that repeat doc_id and text are one document stored
    twice, and both get its result. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = named(docs)

    def finish(doc_id, text, spans):
        data, at, kept = (text or "").encode("utf-8", "surrogatepass"), 0, hashlib.sha256()
        gone = merged(spans)
        for a, b in gone:
            kept.update(data[at:a])
            at = b
        kept.update(data[at:])
        return doc_id, len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest()

    return with_spans(docs, repeated_spans(docs, length, gram), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
