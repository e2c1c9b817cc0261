"""Components against brute force, with copies, near copies and nulls."""

import random

import pytest

from skygrid.llm import ngram_join


def brute(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def check(spark, k, num, den):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 40, 150, 1500]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w).title() if g % 2 else " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, "a b"), (1005, " \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs, k, num, den).collect())
    assert got == brute(rows, k, num, den)
    assert ngram_join.jaccard_components(docs.limit(0), k, num, den).count() == 0


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_components(spark, k, num, den):
    check(spark, k, num, den)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """3,000 near copies, small blocks and cells: the pairs verified and the edges stay in proportion to the rows."""
    seen = {"pairs": 0, "edges": 0}
    verified, found = ngram_join._verified, ngram_join.components

    def counted(pairs, *rest):
        seen["pairs"] += pairs.count()
        return verified(pairs, *rest)

    def counted_edges(edges):
        seen["edges"] += edges.count()
        return found(edges)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    monkeypatch.setattr(ngram_join, "components", counted_edges)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 200)
    monkeypatch.setattr(ngram_join, "CELL", 150)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base, rows = [rng.choice(words) for _ in range(60)], []
    for d in range(3000):  # each near copy is about as far from others as the threshold allows
        w = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            w[rng.randrange(60)] = f"x{d}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 5, 4, 5).collect()}
    assert seen["edges"] <= 6000 and seen["pairs"] <= 60_000
    shingles = {d: {tuple(t.split()[i : i + 5]) for i in range(56)} for d, t in rows[:400]}
    for a in range(400):
        for b in range(a):
            if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
                assert got[a] == got[b]


def test_hot_bucket_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 5)
    monkeypatch.setattr(ngram_join, "FORESTS", 1)
    check(spark, 5, 4, 5)


def test_ties_repeats_nulls_and_clashes(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(1, text, "x"), (1, text, "x"), (1, "other words of this very same id", "y"), (None, text, "z"), (5, text + " b", "c"), (None, None, "n"), (7, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").selectExpr("*", "'k' AS key", "1 AS th", "2 AS n", "3 AS cid", "4 AS c", "5 AS bucket")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 38, 1), (1, 38, 1), (1, 5, 1), (None, 38, 1), (5, 39, 1), (None, 0, None), (7, 0, 7)], key=str)
    found = ngram_join.labelled(docs).where("n_shingles > 0").groupBy("component").count().collect()
    assert sorted(r["count"] for r in found) == [1, 4]


def test_folding():
    import numpy as np

    from skygrid.llm import signature_tree as st

    tokens = np.random.default_rng(1).integers(0, 1 << 60, 300).astype(np.uint64)
    assert (ngram_join.folded(st.bitmap(tokens, 4096).tobytes(), 1024) == st.bitmap(tokens, 1024)).all()


def test_shared_buckets_travel_once_and_packed(spark, monkeypatch):
    """Names that two classes or more have, from one shuffle of packed rows and no join; a class stored twice counts once."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(i << 33, int(n), [int(x) << 30 for x in rng.integers(-300, 300, n)]) for i, n in enumerate(rng.integers(0, 9, 80))]
    rows += [rows[3], (99, 2, [1 << 60, 1 << 60])]
    monkeypatch.setattr(ngram_join, "PACK", 50)  # many packs a task
    heads = spark.createDataFrame(rows, "cid long, n long, prefix array<long>").repartition(3)
    names = {}
    for cid, n, prefix in rows:
        for x in prefix:
            names.setdefault((x % (1 << 64)) >> (64 - ngram_join.NAME_BITS), set()).add((cid, n))
    got = ngram_join._shared(heads)
    wanted = sorted((b, cid, n) for b, held in names.items() if len(held) > 1 for cid, n in held)
    assert sorted(map(tuple, got.collect())) == wanted and len(wanted) > 50
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan


def test_names_are_packed_without_gaps():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (0, 1, 3, 4, 50, 0, 21)]
    packs = [ngram_join._names(s) for s in sets]
    assert [len(p) for p in packs] == [-(-len(s) * ngram_join.NAME_BITS // 8) for s in sets]
    for kind, column in ((pa.binary(), packs), (pa.list_(pa.int64()), [s.view(np.int64).tolist() for s in sets])):
        names, length = ngram_join._named(pa.array(column, kind))
        assert length.tolist() == [len(s) for s in sets]
        assert (names == np.concatenate(sets) >> np.uint64(64 - ngram_join.NAME_BITS)).all()
    assert ngram_join._named(pa.array([b"", b""], pa.binary()))[1].tolist() == [0, 0]


def test_sketches_are_dealt_once_before_their_cells(spark, monkeypatch):
    """Of the shuffles below a round's cells, two hold sketches: that by class, and that of the cells themselves."""
    seen, real = [], ngram_join._candidates

    def candidates(rows, *args):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, *args)

    monkeypatch.setattr(ngram_join, "_candidates", candidates)
    check(spark, 3, 9, 10)
    assert seen
    for plan in seen:
        top = next(line for line in plan.splitlines() if "Join" in line)
        assert "cid" in top and "band" not in top
