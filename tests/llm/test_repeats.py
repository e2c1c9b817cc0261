"""Both substring operators against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from skygrid.llm import repeats, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, packed string, key string"


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, out = [text(60), text(45), text(36)], []
    for i in range(60):
        parts = [text(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), text(rng.randint(0, 40))]
        out.append((i, "\n".join(parts)))
    out += [(100, out[3][1]), (101, None), (102, ""), (103, "a" * 700), (104, "b " * 200), (105, out[5][1].upper()), (None, out[7][1]), (106, "é" * 120 + "x y" * 80)]
    out += [(107, text(3000)), (108, out[3][1] + " " + out[3][1])]
    return [(d, t, "en", "p", "k") for d, t in out]


def brute_words(rows, w=35):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    count = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = Counter()
    for (d, *_), x in zip(rows, words, strict=True):
        gone = {j for i in range(len(x) - w + 1) if count[tuple(x[i : i + w])] > 1 for j in range(i, i + w)}
        kept = b" ".join(v for j, v in enumerate(x) if j not in gone)
        out[(d, len(x), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def brute_bytes(rows, w=100):
    seen, out = set(), Counter()
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        x, gone = (t or "").encode(), set()
        for i in range(len(x) - w + 1):
            if x[i : i + w] in seen:
                gone.update(range(i, i + w))
            seen.add(x[i : i + w])
        spans = sum(j in gone and j - 1 not in gone for j in range(len(x)))
        out[(d, len(x), len(gone), spans, hashlib.sha256(bytes(v for j, v in enumerate(x) if j not in gone)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_words(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter(tuple(r)[:4] for r in substring_dedup.dedup(docs).collect())
    assert got == brute_words(rows)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    rows = corpus(2)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in suffix_dedup.dedup(docs).collect())
    assert got == brute_bytes(rows)


def test_family_of_arrays():
    import numpy as np

    rng = random.Random(3)
    family, seen = suffix_dedup.Family(20), set()
    for _ in range(40):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(20, 200)))
        starts = np.arange(len(text) - 19)
        want = []
        for i in starts.tolist():
            if text[i : i + 20] in seen:
                want.append(i)
            seen.add(text[i : i + 20])
        assert family.add(np.frombuffer(text, np.uint8), starts).tolist() == want
    assert len(family.levels) < 12


def test_stored_twice_and_empty(spark):
    rows = [(1, "x " * 50 + " ".join(map(str, range(50))), "", "", "")] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    for op in (substring_dedup.dedup, suffix_dedup.dedup):
        got = op(docs).collect()
        assert len(got) == 2 and got[0] == got[1]
        assert op(docs.limit(0)).count() == 0
    assert {r.n_removed for r in substring_dedup.dedup(docs).collect()} == {50}
