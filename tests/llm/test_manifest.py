"""Merkle manifest against plain Python: ranks, trees, proofs, tampering."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from skygrid.llm import manifest, oracles
from tests.llm.test_oracles import sql_rows

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, at string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    for nodes in levels[:-1]:
        a = i // 8 * 8
        yield nodes[a:i], nodes[i + 1 : a + 8]
        i //= 8


def brute(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in order}
    top = tree([trees[k][-1][0] for k in order])
    for n, k in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(langs[k], key=lambda x: x[:3])):
            path = [*siblings(trees[k], i), *siblings(top, n)]
            d = own
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 and r[4] is not None:
                d = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for before, after in path:
                d = h(*before, d, *after)
            yield r[0], own, trees[k][-1][0], top[-1][0], h(*(x for step in path for part in step for x in part)), d, d == top[-1][0]


def rows_of(seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice([i, -i, i << 40, (1 << 62) + i]), rng.choice(["s", "", None]), rng.choice(["en"] * 9 + ["de", "", None]), rng.choice([i, None]), rng.choice([f"Text {i}", f"text {i}", "", None, "\u00c4 " * 50])) for i in range(900)]
    rows += [(7, "s", "en", 1, f"T {i % 3}") for i in range(400)] + [(None, None, None, None, None)] * 5 + [(1, "s", f"l{i}", 1, "T") for i in range(20)]
    return [r + (1, "x") for r in rows]


@pytest.mark.parametrize("crowded", [100, manifest.CROWDED])
def test_manifest_equals_plain_python_and_sql(spark, tmp_path, monkeypatch, crowded):
    monkeypatch.setattr(manifest, "CROWDED", crowded)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows_of(), SCHEMA).repartition(3).write.parquet(path)
    got = manifest.manifest(spark.read.parquet(path))
    found = Counter(map(tuple, got.collect()))
    assert found == Counter(brute(rows_of()))
    assert found == sql_rows(oracles.merkle_manifest(5), path + "/*.parquet", got.columns)
    assert {r[-1] for r in found} == {True, False}


def test_more_than_one_pack_above_another(spark, monkeypatch):
    rows = [(i, "s", "en", i, f"T{i}", 1, "x") for i in range(5000)]
    got = Counter(map(tuple, manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == Counter(brute(rows))


def test_few_rows(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    for n in (1, 2, 8, 9):
        rows = [(i, "s", "en", i, f"T{i}", 1, "x") for i in range(n)]
        assert Counter(map(tuple, manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter(brute(rows))
