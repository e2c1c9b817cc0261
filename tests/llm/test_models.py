"""Language model, classifier, neighbours, decontamination, mixture and shards on small fixtures."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skygrid.llm import attention_lm, decontaminate, mixing, neighbours, quality, sharding

SF = "/root/testdata/sf0.001"


def test_language_model(spark):
    rows = [(i, " ".join(random.Random(i).choices(["The", "cat", "sat", "on", "mats", "naïve", f"z{i}"], k=i % 30))) for i in range(60)] + [(100, None), (101, ""), (102, "x" * 5000)]
    got = {r.doc_id: r for r in attention_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    lower = lambda t: (t or "").encode().lower().split()
    count = Counter(w for d, t in rows if not held[d] for w in [*lower(t), b"\n"])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for d, t in rows:
        w = [*lower(t), b"\n"]
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(x in count for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_language_model_scores_whole_texts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["the", "unbelievably", "cat", "zqxv17", "naïve", "sat"], k=30))) for i in range(40)]
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows += [(held[0], "q7" * 500), (held[1], "q7" * 5000), (held[2], " ".join(rng.choices(["the", "cat", "sat", "zqxv17", "unbelievably"], k=500))), (held[3], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.score for r in attention_lm.score(docs).collect()}
    empty = whole[held[3]]
    short, long = whole[held[0]] - empty, whole[held[1]] - empty
    assert short < -310 and 8 < long / short < 12  # ten times the characters, not one floor for both
    for size in (1, 30):  # the parts' size is sent to the tasks with the function
        monkeypatch.setattr(attention_lm, "PART", size)
        parts = {r.doc_id: r.score for r in attention_lm.score(docs).collect()}
        assert all(math.isclose(parts[d], whole[d], rel_tol=1e-5) for d in whole)


def test_bigrams_cover_every_subword(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "PART", 50)
    rng = random.Random(1)
    texts = [None, "", "Fresh", " ".join(rng.choices(["the", "unbelievably", "cat", "zqxv17", "naïve"], k=3000)), " ".join(f"w{i}" for i in range(40))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    encode = attention_lm.Subwords(attention_lm.TOKENIZER)
    streams = [list(attention_lm.chain.from_iterable(encode([*attention_lm.lower_words(t), attention_lm.END]))) for t in texts]
    count = np.bincount(np.concatenate(streams), minlength=attention_lm.VOCABULARY + 1)
    classes = attention_lm.Classes(count, np.zeros(len(count), int))
    wanted, first = np.zeros((attention_lm.INPUTS, attention_lm.CLASSES), int), np.zeros(attention_lm.CLASSES, int)
    for t, ids in zip(texts, streams, strict=True):
        for a, b in zip([attention_lm.VOCABULARY, *ids], ids, strict=False):
            wanted[classes.inputs[a], classes.out[b]] += 1
        for w in encode([*attention_lm.lower_words(t), attention_lm.END]):
            first[classes.out[w[0]]] += 1
    seen, words = attention_lm._bigrams(docs, attention_lm.word_counts(docs), attention_lm.TOKENIZER, spark.sparkContext.broadcast(classes))
    assert seen.sum() == sum(map(len, streams)) and (seen == wanted).all() and (words == first).all()
    model = attention_lm.fit(docs, attention_lm.word_counts(docs), attention_lm.TOKENIZER)  # the table behind the logits is that count
    c = model.classes
    full = np.zeros((attention_lm.INPUTS, attention_lm.CLASSES))
    for ids in streams:
        for a, b in zip([attention_lm.VOCABULARY, *ids], ids, strict=False):
            full[c.inputs[a], c.out[b]] += 1
    prior = (np.bincount(c.out, count, attention_lm.CLASSES) + 1) / (count.sum() + attention_lm.CLASSES)
    assert np.allclose(model.bias, np.log((full + 20 * prior) / (full.sum(1, keepdims=True) + 20)), atol=1e-5)


def test_head_learns_from_every_subword(monkeypatch):
    monkeypatch.setattr(attention_lm, "PART", 50)
    rng = random.Random(2)
    texts = [None, "", "Fresh", *(" ".join(rng.choices(["the", "unbelievably", "cat", "zqxv17", "naïve"], k=k)) for k in (3000, 16, 1, 40))]
    encode = attention_lm.Subwords(attention_lm.TOKENIZER)
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(part, pa.string())}) for part in (texts[:4], texts[4:])]
    wanted, seen = Counter(), Counter()
    for t in texts:
        ids = [attention_lm.VOCABULARY, *attention_lm.chain.from_iterable(encode([*attention_lm.lower_words(t), attention_lm.END]))]
        wanted.update(zip(ids, ids[1:], strict=False))
    for turn in range(attention_lm.ROUNDS):
        for x, y in attention_lm._training_windows(batches, encode, turn):
            assert ((x >= 0) == (y >= 0)).all()
            seen.update(zip(x[y >= 0].tolist(), y[y >= 0].tolist(), strict=True))
    assert seen == wanted


def test_coded_texts_have_the_subwords_of_their_words(spark, monkeypatch):
    """Subwords are made once, and read from there by training and scoring."""
    rng = random.Random(3)
    some = ["the", "Cat", "unbelievably", "naïve", "q7" * 200, "x" * 256, "\u00a0", *(f"w{i}" for i in range(50))]
    texts = [None, "", *(" ".join(rng.choices(some, k=k)) for k in (1, 16, 400, 3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    path, counts = attention_lm.TOKENIZER, attention_lm.word_counts(docs)
    slow = attention_lm.Subwords(path)
    spell = lambda w: [attention_lm.VOCABULARY] if w == attention_lm.END else [t for at in range(0, len(w.decode()) + 1, 256) for t in slow.encode((" " + w.decode())[at : at + 256])]
    for common, part in ((300_000, 30_000), (5, 50), (0, 1)):  # all words common, few, none
        monkeypatch.setattr(attention_lm, "COMMON_WORDS", common)
        monkeypatch.setattr(attention_lm, "PART", part)
        known = attention_lm.lexicon(counts, path, attention_lm.least_common(counts))
        assert len(known.counts) <= common
        rows = attention_lm.coded(docs, spark.sparkContext.broadcast(known), path).orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
        got = [(size.tolist(), number, ids.tolist(), length.tolist()) for _, size, number, ids, length in known.ready(path).coded(rows)]
        words = [[*attention_lm.lower_words(t), attention_lm.END] for t in texts]
        assert [n for size, *_ in got for n in size] == [len(w) for w in words]
        assert [i for _, _, ids, _ in got for i in ids] == [i for w in words for x in w for i in spell(x)]
        assert [n for *_, length in got for n in length] == [len(spell(x)) for w in words for x in w]
        own = known.number()
        assert [int(n) for _, number, *_ in got for n in number] == [own.get(x, -1) for w in words for x in w]
        assert [o.split(b" ") if o else [] for o in rows.column("others").to_pylist()] == [[x for x in w if x not in own] for w in words]
        total = np.bincount([i for w in words for x in w for i in spell(x)], minlength=attention_lm.VOCABULARY + 1)
        assert (attention_lm._subword_counts(attention_lm.coded(docs, spark.sparkContext.broadcast(known), path), known) == total).all()


def test_language_model_without_training_texts(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = attention_lm.score(spark.createDataFrame(list(zip(held, ["a b", "", None], strict=True)), "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 0, 0, 0.0), (1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_gradients_with_empty_places_and_large_scores():
    """Whatever the chunks, and where exponentials would overflow."""
    rng = np.random.default_rng(1)
    ids, targets = rng.integers(0, 50, (300, 16)), rng.integers(0, 64, (300, 16))
    ids[3, 5:], targets[3, 5:], targets[7] = -1, -1, -1
    bias = rng.standard_normal((attention_lm.INPUTS, attention_lm.CLASSES))
    for factor in (1.0, 6.0):
        params = [p.astype(np.float64) * factor for p in attention_lm.init()]
        o, _ = attention_lm.attend(params, ids, 0)
        z = bias[np.maximum(ids, 0)] + o @ params[5]
        p = np.exp(z - z.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        live = (targets >= 0) & (ids >= 0)
        p[np.arange(300)[:, None], np.arange(16), np.maximum(targets, 0)] -= 1
        p *= live[..., None] / live.sum()
        got = attention_lm.gradients(params, bias, ids, targets)
        assert all(np.isfinite(g).all() for g in got)
        assert np.allclose(got[5], o.reshape(-1, attention_lm.WIDTH).T @ p.reshape(-1, attention_lm.CLASSES), rtol=1e-6, atol=1e-9)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    params = [p.astype(np.float64) for p in attention_lm.init()]
    bias = rng.standard_normal((attention_lm.INPUTS, attention_lm.CLASSES))
    ids, targets = rng.integers(0, 50, (3, 16)), rng.integers(0, 64, (3, 16))

    def loss(ps):
        o, _ = attention_lm.attend(ps, ids, 0)
        z = bias[ids] + o @ ps[5]
        z -= np.log(np.exp(z).sum(2, keepdims=True))
        return -np.take_along_axis(z, targets[..., None], 2).mean()

    grads = attention_lm.gradients(params, bias, ids, targets)
    for k, at in ((0, (int(ids[0, 0]), 1)), (1, (3, 2)), (2, (1, 1)), (3, (2, 0)), (4, (0, 3)), (5, (1, 7))):
        up, down = [p.copy() for p in params], [p.copy() for p in params]
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert grads[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-2, abs=1e-6)


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 12)) * rng.uniform(0.5, 2, (400, 1))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0] * 3), (1020, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20).collect()
    found, hits = Counter(), 0
    for r in got:
        found[r.query_id] += 1
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id])) and r.query_id != r.vec_id
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(400), -s.round(12)))[:20].tolist())
        hits += len(best & {r.vec_id for r in got if r.query_id == q})
    assert set(found.values()) == {20} and len(found) == 20 and hits / 400 >= 0.9
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_block_search_of_many_queries():
    """4,000 rows and 200 queries at once against brute force."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((4000, 16))
    v[50:90] = v[50]
    ids, largest = np.arange(4000) * 3, float(np.sqrt((v * v).sum(1).max()))
    matrix = rng.standard_normal((17, neighbours.PROJECTIONS))
    projected = neighbours._project(v, largest, matrix)
    q, k = np.arange(0, 4000, 20), 20
    factor = neighbours.chi_square_quantile(0.97, neighbours.PROJECTIONS)
    whose, own, score = neighbours.search_block(ids, v, projected, ids[q], v[q], np.full(len(q), -np.inf), k, largest, matrix, factor)
    hits = 0
    for i in q:
        s = (v * v[i]).sum(1)
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:k]
        mine = whose == ids[i]
        assert mine.sum() == k and np.array_equal(score[mine], (v[own[mine] // 3] * v[i]).sum(1)) and (np.diff(score[mine]) <= 0).all()
        hits += len(set(own[mine].tolist()) & set(ids[best].tolist()))
    assert hits / (len(q) * k) >= 0.9


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard(docs, 8).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert len(got) == docs.count() and set(size) == set(range(8))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(8))
    # a cut is off by half a document at most, and a shard has a cut on either side at each of three levels
    assert max(size.values()) - min(size.values()) <= 3 * max(r["size"] for r in got)
    assert sharding.shard(docs.limit(0), 8).count() == 0


def test_an_outlier_leaves_the_shards_even(spark):
    rows = [(i, f"short text {i % 3}", "en", "s") for i in range(4000)] + [(5000, "x" * 8_000_000, "en", "s")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).collect()
    assert len(got) == 4001 and max(Counter(r.shard for r in got).values()) < 4000 and len({r.shard for r in got}) > 1
    rows = rows[:-1]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).collect()
    assert set(Counter(r.shard for r in got).values()) <= set(range(499, 502))


def test_shards_of_repeated_and_null_rows(spark):
    rows = [(7, "the same row", "en", "s")] * 300 + [(None, "a text", None, None)] * 100 + [(None, f"b {i}", None, None) for i in range(100)] + [(8, None, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS node", "2 AS size", "3 AS draw", "4 AS shard", "5 AS kept")
    got = sharding.shard(docs, 4, ("node", "kept")).collect()
    assert len(got) == 501 and set(Counter(r.shard for r in got)) == {0, 1, 2, 3} and {r.node for r in got} == {1}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(4))
    assert all(abs(sum(r["size"] for r in got if r.shard == s) - sum(r["size"] for r in got) / 4) < 60 for s in range(4))
    with pytest.raises(ValueError, match="size"):
        sharding.shard(docs, 4, ("size",))


def test_mixture_never_repeats_in_an_epoch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs, {}, budget=0.7, epochs=1).collect()
    assert len({r.doc_id for r in got}) == len(got) and 0 < len(got) < docs.count()


def test_mixture_edges(spark):
    rows = [(i, "a b c" if i % 4 else None, "en", f"s{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert Counter(r.epoch for r in mixing.mix(docs, {}, budget=5.0, epochs=1).collect()) == {1: 40}
    none = mixing.mix(docs, {"source": {"s1": 0}}, budget=0.9, epochs=1).collect()
    assert none and "s1" not in {r.source for r in none}
    clash = docs.selectExpr("*", "'mine' AS domain", "'f' AS full", "1 AS tokens", "2 AS rest", "3 AS epoch", "4 AS _range", "5 AS budget")
    got = mixing.mix(clash, {}, budget=0.5, epochs=1, names=("d", "e")).collect()
    assert {(r.domain, r.full, r.tokens, r.epoch, r.budget) for r in got} == {("mine", "f", 1, 3, 5)}
    assert mixing.mix(docs.limit(0), {}, budget=0.5).count() == 0
    empty = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "", "x", "y")], docs.schema)
    assert Counter(r.doc_id for r in mixing.mix(empty, {}, budget=0.5).collect()) == {1: 2, 2: 1}
    with pytest.raises(ValueError, match="whole number"):
        mixing.mix(docs, {"lang": {"en": -1}}, budget=0.5)


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b c " + item.upper() + " d e"), (2, "clean text of some words here"), (3, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    found = decontaminate.matches(docs, bench)
    assert [(r.doc_id, r.item_id, r.start_word) for r in found.collect()] == [(1, 7, 3)]
    assert {r.doc_id for r in decontaminate.clean(docs, found).collect()} == {2, 3, 4}
    again = docs.union(spark.createDataFrame([(1, "another text, which is clean"), (None, item), (None, "clean"), (1, "a b c " + item.upper() + " d e")], docs.schema))
    kept = decontaminate.clean(again, decontaminate.keyed_matches(again, bench)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(2, "clean text of some words here"), (3, None), (4, ""), (1, "another text, which is clean"), (None, "clean")])


def test_the_index_prunes_and_keeps_the_radius():
    rng = np.random.default_rng(2)
    index = decontaminate.ItemIndex(30, 5, [(i, rng.integers(0, 1 << 62, 26).astype(np.uint64)) for i in range(200)])
    other = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    assert len(index.candidates(other)) < 0.1 * 500 * 200
    near = []
    for f in index.prints[:100]:
        for b in rng.choice(64, decontaminate.RADIUS, replace=False):
            f = f ^ (np.uint64(1) << np.uint64(b))
        near.append(f)
    near = np.concatenate([np.array(near, np.uint64), other])
    wanted = {(w, i) for w, f in enumerate(near) for i, g in enumerate(index.prints) if int(np.bitwise_count(f ^ g)) <= decontaminate.RADIUS}
    assert {(w, i) for w, i, _ in index.near(near)} == wanted and {(w, w) for w in range(100)} <= wanted


def test_decontamination_recall_of_all_windows(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    items = [(i, [rng.choice(words) for _ in range(rng.choice([15, 30, 60]))]) for i in range(20)]
    docs = []
    for d in range(150):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        _, own = rng.choice(items)
        own = list(own)
        for _ in range(rng.randint(0, 2)):
            own[rng.choice([0, 1, -1, -2, rng.randrange(len(own))])] = "changed"
        docs.append((d, w + own + [rng.choice(words) for _ in range(rng.randint(0, 60))]))
    wanted = set()
    for d, w in docs:
        for i, item in items:
            n = len(item)
            b = Counter(tuple(item[j : j + 5]) for j in range(n - 4))
            for p in range(len(w) - n + 1):
                a = Counter(tuple(w[j : j + 5]) for j in range(p, p + n - 4))
                both = sum(min(c, b[x]) for x, c in a.items())
                if both / (2 * (n - 4) - both) >= 0.8:
                    wanted.add((d, i))
    rows = spark.createDataFrame([(d, " ".join(w), "x", 0.5) for d, w in docs], "doc_id long, text string, item_id string, similarity double")
    found = decontaminate.matches(rows, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(wanted) > 60 and got <= wanted and len(got) >= 0.9 * len(wanted)


def test_decontamination_edges(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, item), (1, item), (2, "z " * 300_000 + item), (None, item), (3, item + " x " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (7, "other words of the same id"), (8, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.start_word) for r in decontaminate.matches(docs, bench).collect())
    assert got == {(d, i, p): n for i in (7, 8) for d, p, n in ((1, 0, 2), (2, 300_000, 1), (None, 0, 1), (3, 0, 1))}
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_of_short_items(spark):
    items = [(1, "Solo"), (3, "three little words"), (4, "an item of four"), (5, "this one has five words")]
    texts = [t for _, t in items] + [f"lead in {t.upper()} and more text after it" for _, t in items] + [f"ends with {t}" for _, t in items] + ["three little", "little words three", "unrelated text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    wanted = set()
    for d, t in enumerate(texts):
        w = t.lower().split()
        for i, item in items:
            x = item.lower().split()
            wanted |= {(d, i, p, len(x)) for p in range(len(w)) if w[p : p + len(x)] == x}
    assert len(wanted) == 12 and {(r.doc_id, r.item_id, r.start_word, r.n_words) for r in found.collect()} == wanted
    assert {r.doc_id for r in decontaminate.clean(docs, found).collect()} == {12, 13, 14}


def test_classifier_on_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    rows = quality.classify(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert rows and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.8
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifier_edges(spark):
    schema = "doc_id long, text string, score double, predicted string"
    rows = [(1, None, 42.0, "mine"), (2, "", 1.0, None), (2, "", 1.0, None), (3, "word " * 200_000, 0.0, "x")]
    docs = spark.createDataFrame(rows, schema)
    for labels in ([], [(1, 1), (2, 1)], [(1, 1), (2, 0), (2, 0), (3, None)]):  # no label, one class, both
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.classify(docs, model, ("s", "p")).collect()
        assert len(got) == 4 and {r.score for r in got} == {42.0, 1.0, 0.0} and all(0 <= r.s <= 1 and r.p == (r.s >= 0.3) for r in got)
    assert quality.classify(docs.limit(0), model).count() == 0
