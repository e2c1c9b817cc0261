"""Substring dedup by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to their minimiser's bucket.
There the windows of the strings are sorted, so equal ones are neighbours, and counted exactly.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from skygrid.llm.common import grouped, small_batches
from skygrid.llm.repeats import Units, merged, named, segments, with_spans


def repeated_windows(strings: list[bytes], counts: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each string of words, spans (in words) of its windows that occur twice among all."""
    rows = []
    for i, s in enumerate(strings):
        words = s.split(b" ")
        rows += [(b" ".join(words[j : j + window]), i, j) for j in range(len(words) - window + 1)]
    rows.sort()
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    at = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k][0] != rows[at][0]:
            if k - at > 1 or counts[rows[at][1]] > 1:
                for _, i, j in rows[at:k]:
                    out[i].append((j, j + window))
            at = k
    return [merged(sorted(x)) for x in out]


def repeated_spans(docs: DataFrame, window: int = 35, gram: int = 8) -> DataFrame:
    """(doc_id, th, start, end): spans in words of the windows that occur more than once. docs: of ``named``."""
    found, n = segments(docs, Units(True, window, gram), every=True)
    dealt = found.repartition(n, "key").sortWithinPartitions("key")

    def run(batches):
        for _, (ids, ths, starts, ends, counts, packed) in grouped(batches, ["key"], ["doc_id", "th", "start", "end", "n", "packed"]):
            out = [(d, h, a, b) for d, h, a, b, p in zip(ids, ths, starts, ends, packed, strict=True) if p is None]
            own = [i for i, p in enumerate(packed) if p is not None]
            # rows of one place: a document stored twice, in two partitions
            own = list({(ids[i], ths[i], starts[i]): i for i in own}.values())
            strings = [packed[i] for i in own]
            if len(own) > 1 and strings.count(strings[0]) == len(strings):
                spans = [[(0, ends[i] - starts[i])] for i in own]
            elif len(own) > 1:
                spans = repeated_windows(strings, [counts[i] for i in own], window)
            else:  # alone: a string seen twice is already a span
                spans = [[] for _ in own]
            out += [(ids[i], ths[i], starts[i] + a, starts[i] + b) for i, s in zip(own, spans, strict=True) for a, b in s]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "th", "start", "end"])

    return dealt.mapInArrow(run, "doc_id long, th long, start long, end long")


def dedup(docs: DataFrame, window: int = 35, gram: int = 8) -> DataFrame:
    """Per document (doc_id, n_words, n_removed, kept_sha256, kept_text) without words of repeated windows.

    A window is ``window`` consecutive words (whole, case kept) of one document; it is repeated if the same
    words start anywhere else. Null and empty texts have no words. A null doc_id is an id like any
    other. Rows that repeat doc_id and text are one document stored twice: they don't repeat each
    other, and both get the same result. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = named(docs)
    units = Units(True, window, gram)

    def finish(doc_id, text, spans):
        words, kept, at, gone = units.split(text), [], 0, 0
        for a, b in merged(spans):
            kept += words[at:a]
            gone += b - a
            at = b
        kept = b" ".join(kept + words[at:])
        return doc_id, len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")

    return with_spans(docs, repeated_spans(docs, window, gram), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
