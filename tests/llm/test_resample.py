"""Importance resampling against plain Python and SQL, on awkward texts."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from skygrid.llm import oracles, resample
from tests.llm.test_oracles import SF, sql_rows

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["", None, "one", "One TWO,three", "\u00e9t\u00e9 \u4e2d\u6587 \U0001f600x", "a" * 1000 + " b " + "c" * resample.LONG, "x", "y z", " . ", "\u00c9 A\x00b", "tail"]


def crcs(text):
    words = WORDS.findall((text or "").encode().lower())
    return [zlib.crc32(f) for f in words + [a + b" " + b for a, b in zip(words, words[1:])]]


@pytest.mark.parametrize("piece", [1, 1 << 22])
def test_features_of_neighbouring_texts(monkeypatch, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    for column in (pa.array(TEXTS), pa.array(["zz", *TEXTS]).slice(1), pa.array([], pa.string())):
        got = [[] for _ in range(len(column))]
        for row, _, data, bounds in resample._pieces(column):
            for t, c in zip(*resample.features(data, bounds)):
                got[row + t].append(int(c))
        assert [sorted(g) for g in got] == [sorted(crcs(t)) for t in column.to_pylist()]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), 1) for i in range(150)]
    rows += [(500 + i, "the same words of a third of all rows, " * 4, 2) for i in range(80)]
    rows += [(900 + i, t, 3) for i, t in enumerate(TEXTS)] + [(None, "no id " * 20, 4), (3, rows[3][1], 1), (3, rows[3][1], 1)]
    path = str(tmp_path_factory.mktemp("resample") / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3).write.parquet(path)
    return spark.read.parquet(path), path + "/*.parquet", [r[:2] for r in rows]


def test_rows_equal_sql_and_plain_python(spark, docs):
    df, path, rows = docs
    got = resample.resample(df, spark.read.parquet(f"{SF}/benchmark.parquet"))
    found = list(map(tuple, got.collect()))
    assert Counter(found) == sql_rows(oracles.importance_resampling(), path, got.columns)
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(c % 10_000 for c in crcs(text))
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        t.update(c % 10_000 for c in crcs(r.text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10_000) / ((s[b] + 1.0) * (t.total() + 10_000))))
    expected = []
    for i, text in rows:
        f = [gain(c % 10_000) for c in crcs(text)]
        weight = sum(f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        expected.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert Counter(r[:4] for r in found) == Counter(expected)
    fit = sorted((r for r in expected if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = sorted((r[4], r[3], r[0]) for r in found if r[4] is not None)
    assert [(r[1], r[2]) for r in ranks] == [(r[3], r[0]) for r in fit[: len(fit) * 25 // 100]]
    assert [r[0] for r in ranks] == list(range(1, len(ranks) + 1))


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(empty, none).count() == 0
    assert resample.resample(docs[0], none).where("rank = 1").count() == 1


def test_gains_prefer_the_target(spark):
    rows = [(i, ("red green blue " if i % 2 else "one two three ") * 10) for i in range(40)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("red green blue " * 50,)], "text string"))
    assert np.mean([r.weight for r in got.collect() if r.doc_id % 2]) > np.mean([r.weight for r in got.collect() if not r.doc_id % 2])
