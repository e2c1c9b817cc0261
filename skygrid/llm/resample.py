"""Importance resampling towards a target distribution over hashed word n-grams.

Features are read by a byte automaton over whole Arrow buffers: a table of 256 entries tells word
bytes from others, differences of those flags are the words' bounds, and the CRCs of all words are
advanced together, one byte of every word that still has one a step. A two-word feature goes on from
the first word's state, over the blank and the second word. Lower-casing is a table too, so no text
is decoded. Words longer than LONG bytes end with zlib, one by one, so that one word of megabytes
is not a loop of as many steps.

The corpus is read twice: each task adds its bucket counts (a row a bucket and task), their sums give
the gains, an array of ``buckets`` numbers that every task gets; the second reading gives each
document its weight. Scores are whole numbers of a bounded range, so ranks need no total sort: a
count for each score gives the score's first rank, and rows of one score are ranked among themselves.
Noise by document keeps any score under 0.04 % of the documents (the peak of its density), copies or not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.llm.common import small_batches, table

#: Bytes of a word that all words advance through together.
LONG = 128
#: Bytes of text that are held as arrays at a time; a longer text is a piece of its own.
PIECE = 1 << 22


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Is a byte of a word; its lower-case form; the CRC-32 table (polynomial 0xEDB88320)."""
    byte = np.arange(256, dtype=np.uint8)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    word = ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
    return word, lower, crc


_WORD, _LOWER, _CRC = _tables()


def _advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after each word's bytes: words by falling length, so that those with a byte left are a prefix."""
    order = np.argsort(-length, kind="stable")
    at, size, s = start[order], length[order], state[order]
    if len(size):
        open_ = np.searchsorted(-size, -np.arange(1, min(int(size[0]), LONG) + 1), "right")
        for j, n in enumerate(open_.tolist()):
            s[:n] = _CRC[(s[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (s[:n] >> np.uint32(8))
        for i in range(int(np.searchsorted(-size, -LONG, "left"))):
            rest = data[at[i] + LONG : at[i] + size[i]].tobytes()
            s[i] = zlib.crc32(rest, int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, CRC) of all one- and two-word features of the texts between ``bounds`` in a UTF-8 buffer."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    turn = np.diff(inside)
    inner = bounds[1:-1]
    cut = np.unique(inner[(inside[inner] & inside[inner + 1]).astype(bool)])  # where two texts meet inside of a run
    start = np.sort(np.concatenate([np.flatnonzero(turn == 1), cut]))
    length = np.sort(np.concatenate([np.flatnonzero(turn == -1), cut])) - start
    text = np.searchsorted(bounds, start, "right") - 1
    low = _LOWER[data].astype(np.uint32)
    one = _advance(np.full(len(start), 0xFFFFFFFF, np.uint32), low.astype(np.uint8), start, length)
    first = np.flatnonzero(text[:-1] == text[1:])
    blank = _CRC[(one[first] ^ np.uint32(32)) & np.uint32(255)] ^ (one[first] >> np.uint32(8))
    two = _advance(blank, low.astype(np.uint8), start[first + 1], length[first + 1])
    return np.concatenate([text, text[first]]), ~np.concatenate([one, two])


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, bounds) of runs of rows with about PIECE bytes; null is no text."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PIECE, "right")) - 1)
        yield row, end - row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all features of the column text; buckets without features are absent."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, bounds in _pieces(batch.column(0)):
                total += np.bincount(features(data, bounds)[1] % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A whole number for each bucket: 1000 times the log ratio of its add-one shares in target and source, floored."""
    both = table(bucket_counts(source, buckets).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, buckets).withColumn("side", F.lit(1))))
    n = np.zeros((2, buckets), np.int64)  # at most 2 * buckets rows
    for r in both.collect():
        n[r.side, r.bucket] = r.n
    (s, t), (all_s, all_t) = n.astype(float), n.sum(axis=1).astype(float)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight): the floored mean gain of a document's features, 0 without any."""
    buckets = np.uint32(len(gain))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for row, rows, data, bounds in _pieces(batch.column(1)):
                text, crc = features(data, bounds)
                n[row : row + rows] = np.bincount(text, minlength=rows)
                order = np.argsort(text, kind="stable")
                upto = np.concatenate([[0], np.cumsum(gain[crc[order] % buckets])])  # whole numbers: sums are exact
                ends = np.cumsum(n[row : row + rows])
                total[row : row + rows] = upto[ends] - upto[ends - n[row : row + rows]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(weigh, "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel draw by seed and doc_id (null: as the empty text), floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least: int = 20, seed: int = 7) -> DataFrame:
    """Every row of docs (doc_id, text) as doc_id, n_features, weight, score and rank.

    ``percent`` of the rows with at least ``least`` words are drawn by falling score, ties to the
    smaller doc_id (null last); rank counts from 1, and is null for rows that are not drawn. Null,
    empty and wordless texts have no features, weight 0 and no rank. Texts are read whole, however
    long. Rows that repeat a doc_id are rows of their own, equal ones ranked in any order. Other
    columns are ignored, whatever their names. An empty table gives an empty one, an empty target
    counts as one without features.
    """
    small_batches(docs.sparkSession)
    scored = weights(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = table(scored)
    fit = F.col("n_features") >= 2 * least - 1
    counts = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # one row a score, of which there are some ten thousand at any size
    run = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    firsts = counts.withColumn("upto", F.sum("n").over(run)).withColumn("drawn", F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).cast("long"))
    firsts = table(firsts.select("score", (F.col("upto") - F.col("n")).alias("before"), "drawn").where("before < drawn"))
    drawn = scored.where(fit).join(F.broadcast(firsts), "score")  # rows of the scores drawn, the last one in part
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    drawn = drawn.withColumn("rank", F.col("before") + F.row_number().over(order)).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long"))
    rest = scored.join(F.broadcast(firsts.select("score")), "score", "left_anti").unionByName(scored.where(~fit).join(F.broadcast(firsts.select("score")), "score", "left_semi"))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return drawn.select(*columns).unionByName(rest.withColumn("rank", F.lit(None).cast("long")).select(*columns))
