"""LM scoring with a small causal self-attention model, trained in numpy on subword ids.

A word is scored by a mixture. For a known word: the attention model's probability of the class of
its first subword, times the word's share of the training words of that class. For any word: the
product of its subwords' probabilities under the attention model and of its end. The mixture's weight is the
Good-Turing estimate of unseen words. Subwords come from a public tokenizer (never trained here), a
word at a time.

The attention model predicts the class of the next subword: the commonest subwords are classes of
their own, the others share classes by frequency; inside a class a subword has its share of the training
counts. Class logits are smoothed bigram logits plus one attention head over the context window.

Texts are read twice: for the word counts, and to be written as numbers of the common words, with the
other words and their subwords beside them. All later passes take their subwords from there.

Word, subword and bigram counts cover every subword of all training documents. The head is trained on every subword
of all training documents: windows of CONTEXT subwords, one after the other, cover each text, and each is
learned from in one of the rounds, by local Adam steps of a task whose parameters are averaged after the round.
For scoring, windows of CONTEXT subwords overlap by half: each scores its second half, so every subword is scored once with at least half a window before it, also where a long text is
scored in parts; all windows of a batch of documents go through one masked attention.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from skygrid.llm.common import lower_words, small_batches, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Ids of the tokenizer's vocabulary; the next one is the end of a text.
VOCABULARY = 50_256
END = b"\n"
#: Model: input classes, output classes (of which SINGLE hold one subword), width, context.
INPUTS, CLASSES, SINGLE, WIDTH, CONTEXT = 1024, 64, 40, 8, 16
#: Words whose counts and subwords all tasks get (at most so many rows, below 2 ** 24 - 1); the rest are joined.
COMMON_WORDS = 300_000
#: Training: rounds of averaging, which share the windows; windows of an Adam step.
ROUNDS, STEP = 2, 256
#: Windows computed at a time, in training and in scoring (of half as many logits each): memory stays in a core's cache.
CHUNK, SCORED = 128, 512
#: Words scored at a time (a longer text is scored in parts), and distinct words whose subwords a task remembers.
PART, REMEMBERED = 30_000, 300_000


class Subwords:
    """Subword ids of words (bytes), remembered up to a bound."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("words", pat_str=r" ?[^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[bytes, tuple[int, ...]] = {END: (VOCABULARY,)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        ids = self.encode_word(word)
        if len(self.known) < REMEMBERED:
            self.known[word] = ids
        return ids

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        if word == END:
            return self.known[END]
        text = " " + word.decode("utf-8", "replace")
        return tuple(chain.from_iterable(self.encode(text[i : i + 256]) for i in range(0, len(text), 256)))

    def __call__(self, words: list[bytes]) -> list[tuple[int, ...]]:
        get = self.known.get
        return [get(w) or self.__missing__(w) for w in words]

    def together(self, words: list[bytes]) -> list[int]:
        """Subwords of words, one word after the other; none is remembered."""
        if words and max(map(len, words)) < 256 and END not in words:  # each is one piece, so one call encodes all
            return self.encode(" " + b" ".join(words).decode("utf-8", "replace"))
        return list(chain.from_iterable(map(self.encode_word, words)))

    def groups(self, batch: pa.RecordBatch):
        """(subword ids, number of them in each text) of texts, about PART words at a time."""
        held, size = [], 0
        for text in chain(batch.column(0).to_pylist(), [...]):
            if held and (text is ... or size >= PART):
                length = np.fromiter((sum(map(len, t)) for t in held), np.int64, len(held))
                yield np.fromiter(chain.from_iterable(chain.from_iterable(held)), np.int64, int(length.sum())), length
                held, size = [], 0
            if text is not ...:
                held.append(self([*lower_words(text), END]))
                size += len(held[-1])


@lru_cache(maxsize=1)
def subwords(path: str) -> Subwords:
    """One a Python worker, kept from task to task: reading the vocabulary takes longer than many a task."""
    return Subwords(path)


class Classes:
    """Input and output class of each subword, and its log share inside its output class, from counts."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.inputs = np.empty(len(counts), np.int32)
        self.inputs[order] = np.minimum(np.arange(len(counts)), INPUTS // 2 - 1)
        rest = order[INPUTS // 2 - 1 :]
        self.inputs[rest] = INPUTS // 2 - 1 + rest % (INPUTS // 2)
        self.out = np.empty(len(counts), np.int32)
        self.out[order[:SINGLE]] = np.arange(SINGLE)
        half = (CLASSES - SINGLE) // 2
        for kind in (0, 1):  # word starts and continuations apart
            own = order[SINGLE:][starts[order[SINGLE:]] == kind]
            mass = np.cumsum(counts[own] + 1.0)
            self.out[own] = SINGLE + kind * half + np.minimum((mass / mass[-1] * half).astype(int), half - 1) if len(own) else 0
        self.start = np.zeros(CLASSES, np.float32)
        self.start[self.out[starts == 0]] = 1
        total = np.bincount(self.out, counts + 1.0, CLASSES)
        self.share = np.log((counts + 1.0) / total[self.out]).astype(np.float32)


def init(seed: int = 3) -> list[np.ndarray]:
    """Embedding, positions, query, key, value and output matrices."""
    r = np.random.default_rng(seed)
    shapes = ((INPUTS, WIDTH), (CONTEXT, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH, CLASSES))
    return [(r.standard_normal(s) * (0.5 if i < 2 else 0.3)).astype(np.float32) for i, s in enumerate(shapes)]


def attend(params: list[np.ndarray], ids: np.ndarray, first: int) -> tuple:
    """Masked attention of windows ids (n, CONTEXT; -1: nothing there), queries from place ``first`` on."""
    e, pos, wq, wk, wv, _ = params
    x = e[np.maximum(ids, 0)] + pos
    q, k, v = x[:, first:] @ wq, x @ wk, x @ wv
    s = q @ k.transpose(0, 2, 1) * np.float32(WIDTH**-0.5)
    allowed = np.arange(CONTEXT) <= np.arange(first, CONTEXT)[:, None]
    s = np.where(allowed & (ids >= 0)[:, None, :], s, np.float32(-1e4))
    s -= s.max(2, keepdims=True)
    a = np.exp(s)
    a /= a.sum(2, keepdims=True)
    return a @ v, (x, q, k, v, a)


#: What a place adds to the scores of the places after it.
CAUSAL = np.where(np.tri(CONTEXT, dtype=bool), 0, -1e30).astype(np.float32)


def _room(held: dict, name: str, *shape: int, dtype) -> np.ndarray:
    """A piece of memory that is kept under its name from call to call."""
    if name not in held or held[name].size < math.prod(shape) or held[name].dtype != dtype:
        held[name] = np.empty(math.prod(shape), dtype)
    return held[name][: math.prod(shape)].reshape(shape)


def gradients(params: list[np.ndarray], bias: np.ndarray, ids: np.ndarray, targets: np.ndarray, held: dict | None = None) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over targets (n, CONTEXT; -1: none), CHUNK windows at a time.

    Logits are not scaled to probabilities: what they are multiplied with is, as it has fewer columns.
    """
    e, pos, wq, wk, wv, wo = params
    kind, held, scale = e.dtype, {} if held is None else held, np.asarray(WIDTH**-0.5, e.dtype)
    w3 = np.concatenate([wq * scale, wk, wv], 1)
    there = ids >= 0
    holes = not there[:, 0].all() or bool((there[:, 1:] & ~there[:, :-1]).any())  # places at a window's end are seen by none before them
    live = (targets >= 0) & there
    ids, targets = np.maximum(ids, 0), np.maximum(targets, 0)
    weight = (live / max(1, live.sum())).astype(kind)
    ones, key_ones, steep = np.ones((CLASSES, 1), kind), np.ones((CONTEXT, 1), kind), float(np.abs(wo).sum(0).max())
    gw3, gwo, gx = np.zeros_like(w3), np.zeros_like(wo), _room(held, "gx", ids.size, WIDTH, dtype=kind)
    woc = np.ascontiguousarray(wo.T)
    for at in range(0, len(ids), CHUNK):
        own = slice(at, at + CHUNK)
        rows, hits, share = ids[own].ravel(), targets[own].ravel(), weight[own].reshape(-1, 1)
        n = len(rows) // CONTEXT
        x = e.take(rows, axis=0)
        x.reshape(n, CONTEXT, WIDTH)[:] += pos
        qkv = (x @ w3).reshape(n, CONTEXT, 3 * WIDTH)
        q, k, v = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
        a = np.matmul(q, k.transpose(0, 2, 1), out=_room(held, "a", n, CONTEXT, CONTEXT, dtype=kind))
        tame = -80 < a.min() and a.max() < 80  # so no exponential overflows
        a += CAUSAL
        if holes:
            a += np.where(there[own], 0, -1e30).astype(kind)[:, None]
        if holes or not tame:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a /= (a.reshape(-1, CONTEXT) @ key_ones).reshape(n, CONTEXT, 1)
        o = (a @ v).reshape(-1, WIDTH)
        p = np.matmul(o, wo, out=_room(held, "p", len(rows), CLASSES, dtype=kind))
        p += bias.take(rows, axis=0, out=_room(held, "bias", len(rows), CLASSES, dtype=kind), mode="clip")
        if not max(-float(o.min()), float(o.max())) * steep < 60:
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        total = p @ ones
        p[np.arange(len(p)), hits] -= total[:, 0]
        share = share / total
        gwo += (p.T @ (o * share)).T
        go = ((p @ woc) * share).reshape(n, CONTEXT, WIDTH)
        g = np.empty_like(qkv)
        np.matmul(a.transpose(0, 2, 1), go, out=g[..., 2 * WIDTH :])
        ga = np.matmul(go, v.transpose(0, 2, 1), out=_room(held, "ga", n, CONTEXT, CONTEXT, dtype=kind))
        ga *= a
        a *= (ga.reshape(-1, CONTEXT) @ key_ones).reshape(n, CONTEXT, 1)
        ga -= a
        np.matmul(ga, k, out=g[..., :WIDTH])
        np.matmul(ga.transpose(0, 2, 1), q, out=g[..., WIDTH : 2 * WIDTH])
        gw3 += x.T @ g.reshape(-1, 3 * WIDTH)
        np.matmul(g.reshape(-1, 3 * WIDTH), w3.T, out=gx[at * CONTEXT : at * CONTEXT + len(rows)])
    rows = ids.ravel()
    ge = np.stack([np.bincount(rows, column, len(e)) for column in gx.T], 1).astype(kind)
    gq, gk, gv = np.split(gw3, 3, 1)
    return [ge, gx.reshape(-1, CONTEXT, WIDTH).sum(0), gq * scale, gk, gv, gwo]


class Adam:
    """Steps of Adam on parameters of its own."""

    def __init__(self, params: list[np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = [p.copy() for p in params], rate, 0
        self.m, self.v, self.held = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], {}

    def step(self, bias: np.ndarray, ids: np.ndarray, targets: np.ndarray) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, gradients(self.params, bias, ids, targets, self.held), self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all docs, the end of a text among them; counted in each partition before the shuffle."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            items = list(seen.items())
            for at in range(0, len(items), 100_000):
                part = items[at : at + 100_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in part], pa.binary()), "c": pa.array([c for _, c in part], pa.int64())})
            seen.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(lower_words(text))
                seen[END] += 1
            if len(seen) > 500_000:
                yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """The commonest training words, numbered from the commonest on, with their counts and subwords."""

    def __init__(self, words: list[bytes], counts: np.ndarray, pieces: list[bytes]):
        self.words = b" ".join(words)
        self.counts = np.asarray(counts, np.int64)
        self.length = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 2
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(pieces), np.uint16)
        self.opens = None

    def number(self) -> dict[bytes, int]:
        """Each word's number."""
        return {w: i for i, w in enumerate(self.words.split(b" "))} if len(self.counts) else {}

    def ready(self, path: str) -> Lexicon:
        """With the subwords that begin a word: they are the only ones that begin with a blank, or the end of a text."""
        if self.opens is None:
            self.opens = ~continuations(path)
        return self

    def words_of(self, low: list[bytes], high: list[bytes], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, -1 for a word that is not common; subwords; how many each word has) of coded texts, one after the other."""
        number = np.frombuffer(b"".join(high), np.uint8).astype(np.int64)
        number <<= 16
        number |= np.frombuffer(b"".join(low), np.uint16)
        other = np.flatnonzero(number == OTHER)
        number[other] = -1
        own = np.frombuffer(b"".join(pieces), np.uint16)
        first = np.flatnonzero(self.opens[own])
        if len(self.counts):
            length, at = self.length[number], self.start[number]
        else:
            length, at = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        length[other], at[other] = np.diff(first, append=len(own)), first + len(self.flat)
        at -= np.cumsum(length) - length
        at = np.repeat(at, length)
        at += np.arange(len(at))
        return number, np.concatenate([self.flat, own])[at].astype(np.int64), length

    def coded(self, batch: pa.RecordBatch):
        """(place in the batch of a first text, number of words of it and of those after it, words_of) of texts, about PART words at a time."""
        low, high, pieces = (batch.column(c).to_pylist() for c in ("low", "high", "pieces"))
        at, size = 0, 0
        for i, text in enumerate(high):
            size += len(text)
            if size >= PART or i + 1 == len(high):
                own = slice(at, i + 1)
                yield at, np.fromiter(map(len, high[own]), np.int64, i + 1 - at), *self.words_of(low[own], high[own], pieces[own])
                at, size = i + 1, 0

    def groups(self, batch: pa.RecordBatch):
        """As ``Subwords.groups``, of coded texts."""
        for _, size, _, ids, length in self.coded(batch):
            yield ids, np.add.reduceat(length, np.cumsum(size) - size)


#: Number of all words that are not common.
OTHER = (1 << 24) - 1


@lru_cache(maxsize=1)
def continuations(path: str) -> np.ndarray:
    """Whether each subword goes on with a word."""
    with open(path, "rb") as f:
        return np.array([not base64.b64decode(line.split()[0]).startswith(b" ") for line in f] + [False])


def lexicon(counts: DataFrame, path: str, least: int) -> Lexicon:
    """Of the words at least as common as ``least``."""

    def run(batches):
        encode = subwords(path)
        for batch in batches:
            pieces = [np.array(i, np.uint16).tobytes() for i in encode(batch.column("word").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(pieces, pa.binary())], ["word", "c", "pieces"])

    got = counts.where(F.col("c") >= least).select("word", "c").mapInArrow(run, "word binary, c long, pieces binary").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return Lexicon(got["word"].to_pylist(), got["c"].to_numpy(), got["pieces"].to_pylist())


def least_common(counts: DataFrame) -> int:
    """The count from which on words are common: those with at least that many are at most COMMON_WORDS."""
    least, held = 1 << 62, 0
    for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c")).limit(COMMON_WORDS).collect():
        if held + r.k > COMMON_WORDS:
            break
        least, held = r.c, held + r.k
    return least


def coded(docs: DataFrame, shared, path: str) -> DataFrame:
    """docs with, in place of the text, the numbers of its words (two low bytes, one high byte), the other words, and their subwords.

    A text ends with END. Words that are not in the broadcast lexicon have the number OTHER; a blank is between them.
    """
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        get, encode = None, subwords(path)
        for batch in batches:
            get = get or shared.value.number().get
            out: list[list[bytes]] = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                words = [*lower_words(text), END]
                number = np.fromiter(map(get, words, repeat(OTHER)), np.uint32, len(words))
                others = [words[i] for i in np.flatnonzero(number == OTHER).tolist()]
                ids = encode.together(others)
                for column, value in zip(out, (number.astype(np.uint16).tobytes(), (number >> 16).astype(np.uint8).tobytes(), b" ".join(others), np.array(ids, np.uint16).tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, pa.binary()) for c in out)], [*names, "low", "high", "others", "pieces"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in names) + "low binary, high binary, others binary, pieces binary")


def _summed(seen: np.ndarray):
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])


def _added(docs: DataFrame, run, size: int) -> np.ndarray:
    """Sums over tasks, by place, of the ``size`` numbers that run gives."""
    out = np.zeros(size, np.int64)
    for r in docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    return out


def _subword_counts(docs: DataFrame, words: Lexicon) -> np.ndarray:
    """Count of each subword in coded docs whose word counts the lexicon's are from."""

    def run(batches):
        seen = np.zeros(VOCABULARY + 1, np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if part:
                    seen += np.bincount(np.frombuffer(part, np.uint16), minlength=len(seen))
        yield from _summed(seen)

    common = np.zeros(VOCABULARY + 1, np.int64)
    np.add.at(common, words.flat, np.repeat(words.counts, words.length))
    return common + _added(docs.select("pieces"), run, VOCABULARY + 1)


def _windows(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subwords before, subwords) of texts with so many ids each, as rows of CONTEXT (-1: nothing there); a text starts after an end.

    A text's windows follow one another, so each of its ids is in one window.
    """
    rows = -(-lengths // CONTEXT)
    first = np.cumsum(rows) - rows
    at = np.arange(len(ids)) + np.repeat(first * CONTEXT - (np.cumsum(lengths) - lengths), lengths)
    x, y = np.full(int(rows.sum()) * CONTEXT, -1, np.int64), np.full(int(rows.sum()) * CONTEXT, -1, np.int64)
    y[at] = ids
    x[at[1:]] = ids[:-1]
    x[first * CONTEXT] = VOCABULARY
    return x.reshape(-1, CONTEXT), y.reshape(-1, CONTEXT)


def _training_windows(batches, encode: Subwords | Lexicon, turn: int):
    """_windows of the texts of a task, some at a time: of its windows, numbered through, those whose number falls to this round."""
    number = 0
    for batch in batches:
        for ids, length in encode.groups(batch):
            x, y = _windows(ids, length)
            mine = slice((turn - number) % ROUNDS, None, ROUNDS)
            number += len(x)
            yield x[mine], y[mine]


def _bigrams(docs: DataFrame, counts: DataFrame, path: str, shared, known=None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (input class, output class) over all pairs of neighbouring subwords, and of words by the class of their first.

    A text starts after an end, so every subword is the second of one pair. Both results are of fixed size. docs are coded
    by the broadcast lexicon ``known``, or are texts.
    """
    if known is None:
        known = docs.sparkSession.sparkContext.broadcast(lexicon(counts, path, least_common(counts)))
        docs = coded(docs, known, path)

    def run(batches):
        c, words, seen = shared.value, known.value.ready(path), np.zeros(INPUTS * CLASSES + CLASSES, np.int64)
        before, after = c.inputs.astype(np.int64) * CLASSES, c.out.astype(np.int64)
        for batch in batches:
            for ids, _ in words.groups(batch):  # texts one after the other: each starts after the end of the one before
                y = after[ids]
                seen[INPUTS * CLASSES :] += np.bincount(y[words.opens[ids]], minlength=CLASSES)
                y += before[np.concatenate([[VOCABULARY], ids[:-1]])]
                seen[: INPUTS * CLASSES] += np.bincount(y, minlength=INPUTS * CLASSES)
        yield from _summed(seen)

    out = _added(docs.select("low", "high", "pieces"), run, INPUTS * CLASSES + CLASSES)
    return out[: INPUTS * CLASSES].reshape(INPUTS, CLASSES), out[INPUTS * CLASSES :]


class Model:
    def __init__(self, params: list[np.ndarray], bias: np.ndarray, classes: Classes, words: np.ndarray):
        self.params, self.bias, self.classes = params, bias, classes
        self.words = np.log(np.maximum(words, 1))  # log count of training words by the class of their first subword

        e, pos, wq, wk, wv, wo = params
        half = CONTEXT // 2
        # queries stand in the second half of a window; keys and values anywhere; an input has one row of each table
        self.q, self.pq = (e @ wq) * np.float32(WIDTH**-0.5), (pos[half:] @ wq) * np.float32(WIDTH**-0.5)
        self.k, self.pk, self.v, self.pv = e @ wk, pos @ wk, e @ wv, pos @ wv
        self.mask = np.where(np.arange(CONTEXT) <= np.arange(half, CONTEXT)[:, None], 0, -1e4).astype(np.float32)
        self.sums = np.stack([np.ones(CLASSES, np.float32), classes.start], 1)
        norm = lambda t, u: float(np.sqrt(((np.abs(t).max(0) + np.abs(u).max(0)) ** 2).sum()))
        # no score or logit reaches this, so exponentials cannot overflow unless it is large
        self.tame = max(norm(self.q, self.pq) * norm(self.k, self.pk), norm(self.v, self.pv) * float(np.sqrt((wo**2).sum(0)).max())) < 60

    def class_scores(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability (natural) of each id's class, and of a word's start there.

        ids are those of several texts with so many ids each (at least one); a text starts after an end.
        """
        half = CONTEXT // 2
        blocks = -(-lengths // half)
        first = np.cumsum(blocks) - blocks
        at = np.arange(len(ids)) + np.repeat(first * half - (np.cumsum(lengths) - lengths), lengths)
        x, y = np.zeros(int(blocks.sum()) * half, np.int64), np.zeros(int(blocks.sum()) * half, np.int64)
        y[at] = self.classes.out[ids]
        x[at[1:]] = self.classes.inputs[ids[:-1]]
        x[first * half] = self.classes.inputs[VOCABULARY]
        x = x.reshape(-1, half)
        opens = np.zeros(len(x), bool)
        opens[first] = True
        x = np.concatenate([np.concatenate([x[:1], x[:-1]]), x], 1)
        out, ends, held, share = np.empty(len(y), np.float32), np.empty(len(y), np.float32), {}, np.ones((CONTEXT, 1), np.float32)
        room = lambda name, *shape: _room(held, name, *shape, dtype=np.float32)
        for c in range(0, len(x), SCORED):
            w, own = x[c : c + SCORED], slice(c * half, (c + SCORED) * half)
            n, late = len(w), w[:, half:].ravel()
            q, k, v = (t.take(i, axis=0, out=room(m, i.size, WIDTH), mode="clip").reshape(n, -1, WIDTH) for m, t, i in (("q", self.q, late), ("k", self.k, w.ravel()), ("v", self.v, w.ravel())))
            q += self.pq
            k += self.pk
            v += self.pv
            s = np.matmul(q, k.transpose(0, 2, 1), out=room("s", n, half, CONTEXT))
            s += self.mask
            s[opens[c : c + SCORED], :, :half] = -1e4  # nothing comes before a text
            if not self.tame:
                s -= s.max(2, keepdims=True)
            np.exp(s, out=s)
            o = (s @ v).reshape(-1, WIDTH)
            o /= s.reshape(-1, CONTEXT) @ share
            logits = np.matmul(o, self.params[5], out=room("logits", n * half, CLASSES))
            logits += self.bias.take(late, axis=0, out=room("bias", n * half, CLASSES), mode="clip")
            if not self.tame:
                logits -= logits.max(1, keepdims=True)
            hit = logits[np.arange(len(logits)), y[own]]
            np.exp(logits, out=logits)
            total = np.log(logits @ self.sums)
            out[own], ends[own] = hit - total[:, 0], total[:, 1] - total[:, 0]
        return out[at], ends[at]


def fit(docs: DataFrame, counts: DataFrame, path: str, known=None) -> Model:
    """Model of training docs whose word counts are ``counts``; docs are coded by the broadcast lexicon ``known``, or are texts."""
    spark = docs.sparkSession
    if known is None:
        known = spark.sparkContext.broadcast(lexicon(counts, path, least_common(counts)))
        docs = table(coded(docs.select("text"), known, path))
    total = _subword_counts(docs, known.value)
    classes = Classes(total, continuations(path).astype(int))
    shared = spark.sparkContext.broadcast(classes)

    seen, words = _bigrams(docs, counts, path, shared, known)
    prior = (np.bincount(classes.out, total, CLASSES) + 1) / (total.sum() + CLASSES)
    bias = np.log((seen + 20 * prior) / (seen.sum(1, keepdims=True) + 20)).astype(np.float32)
    params = init()
    params[5][:] *= 0.1
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast((params, bias, classes, turn))

        def step(batches, now=now):
            params, bias, c, turn = now.value
            adam, done = Adam(params, 0.01 / (1 + turn)), 0
            inputs, out = np.append(c.inputs, -1), np.append(c.out, -1)  # -1, nothing there, stays so
            held, size = [], 0

            def learn(x, y):
                nonlocal done
                for at in range(0, len(x), STEP):
                    adam.step(bias, x[at : at + STEP], y[at : at + STEP])
                done += len(x)

            for x, y in _training_windows(batches, known.value.ready(path), turn):
                held.append((inputs[x], out[y]))
                size += len(x)
                if size >= 16 * STEP:
                    x, y = map(np.concatenate, zip(*held, strict=True))
                    whole = len(x) // STEP * STEP
                    learn(x[:whole], y[:whole])
                    held, size = [(x[whole:], y[whole:])], len(x) - whole
            if held:
                learn(*map(np.concatenate, zip(*held, strict=True)))
            flat = np.concatenate([p.ravel() for p in adam.params]).astype(np.float64) * done
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat))), pa.array(np.concatenate([[done], flat]))], ["i", "x"])

        sums = docs.select("low", "high", "pieces").mapInArrow(step, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        if sums and sums[0].x > 0:
            flat, at, new = np.array([r.x for r in sums[1:]]) / sums[0].x, 0, []
            for p in params:
                new.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
                at += p.size
            params = new
    return Model(params, bias, classes, words)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text mod 7 is 2 (a null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per document (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from documents that are not held out. Words are lower-cased (A-Z); the end of a text counts as
    a token, so null and empty texts have one. Repeated rows are trained on and scored each. Without
    training documents all counts are 0. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    training = docs.where(~held_out(F.col("doc_id")))
    counts = table(word_counts(training))
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    mixed = min(0.5, max(0.01, once / n)) if n else 1.0
    least = least_common(counts)
    known = spark.sparkContext.broadcast(lexicon(counts, path, least))
    # the number travels with the row into a written table, so it is drawn once
    numbered = table(coded(docs.withColumn("uid", F.monotonically_increasing_id()), known, path))
    learned = spark.sparkContext.broadcast(fit(numbered.where(~held_out(F.col("doc_id"))), counts, path, known))

    def run(batches):
        model, lex = learned.value, known.value.ready(path)
        seen = np.append(lex.counts, 0)  # number -1: not common
        base_of = np.append(np.log10((lex.counts + 1) / (n + v + 1)), 0)
        count_log = np.append(np.log((1 - mixed) * lex.counts), 0) if n else np.zeros(1)

        def scored(number, ids, length, size, lead=0, look=0):
            """Of texts of so many words: their words, common ones, base and score of these; and text and log probabilities (a count, by subwords) of each other word.

            Of ids, ``lead`` before and ``look`` after a part of one longer text are context only.
            """
            text, start = np.cumsum(size) - size, np.cumsum(length) - length
            at_all, ends_all = (x.astype(np.float64) for x in model.class_scores(ids, np.add.reduceat(length, text) + lead + look))
            own = slice(lead, len(ids) - look)
            ids, at_class, ends = ids[own], at_all[own], ends_all[own]
            after = np.append(ends[start[1:]], 0)
            after[text + size - 1] = ends_all[-1] if look else 0
            at_class[start] -= ends[start]  # where a word starts, only start classes count
            sub = np.add.reduceat(at_class + model.classes.share[ids], start) + after
            each = at_class[start] - model.words[model.classes.out[ids[start]]]
            known = number >= 0
            x = np.where(known, np.logaddexp(count_log[number] + each, math.log(mixed) + sub) / math.log(10), 0)
            rest = np.flatnonzero(~known)
            sums = (size, *(np.add.reduceat(z, text) for z in (known.astype(np.int64), base_of[number], x)))
            return sums, np.searchsorted(text, rest, "right") - 1, each[rest], sub[rest]

        def pieces(number, ids, length, size):
            """(place of the first text, arguments of scored): all texts together, or where one is longer than PART, each by itself in parts.

            Before a part: enough to fill the windows as in the whole text. The first two halves of a window only give context
            (a text starts after an end, which is not so here), and a third one may be shared with the part before. After: one id.
            """
            if size.max() <= PART:
                yield 0, (number, ids, length, size)
                return
            half, end, begin = CONTEXT // 2, np.cumsum(length), 0
            for i, words in enumerate(size.tolist()):
                zero = end[begin] - length[begin]
                for w in range(begin, begin + words, PART):
                    to = min(w + PART, begin + words)
                    a, b = end[w] - length[w] - zero, end[to - 1] - zero
                    before, behind = max(0, a - 2 * half - a % half), b + (to < begin + words)
                    yield i, (number[w:to], ids[zero + before : zero + behind], length[w:to], np.array([to - w]), int(a - before), int(behind - b))
                begin += words

        names = ("uid", "doc_id", "word", "n", "known", "base", "x")
        for batch in batches:
            uids, doc_ids = batch.column("uid").to_numpy(), batch.column("doc_id")
            others = batch.column("others").to_pylist()
            for first, size, *texts in lex.coded(batch):
                left = iter(chain.from_iterable(o.split(b" ") for o in others[first : first + len(size)] if o))
                for i, args in pieces(*texts, size):
                    (n_words, n_known, base, x), whose, each, sub = scored(*args)
                    own = slice(first + i, first + i + len(n_words))
                    own_ids = doc_ids.slice(own.start, len(n_words))
                    yield pa.RecordBatch.from_arrays([pa.array(uids[own]), own_ids, pa.array([b"\n%d" % u for u in uids[own].tolist()], pa.binary()), *map(pa.array, (n_words, n_known, base, x))], names)
                    if len(whose):
                        words = pa.array([next(left) for _ in range(len(whose))], pa.binary())
                        ones = np.ones(len(whose), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(uids[own][whose]), pa.nulls(len(whose), pa.int64()), words, *map(pa.array, (ones, ones - 1, each, sub))], names)

    # a row is a document with the sums of its common words, or one other word (base: log probability a count)
    parts = table(numbered.mapInArrow(run, "uid long, doc_id long, word binary, n long, known long, base double, x double"))
    joined = parts.join(counts.where(F.col("c") < least), "word", "left")
    whole = (F.substring("word", 1, 1) == F.lit(b"\n")) & (F.length("word") > 1)
    c = F.coalesce("c", F.lit(0))
    # sums of logarithms: a long word's probability is far below the smallest double
    a, b = F.log(F.lit(1 - mixed) * c) + F.col("base"), F.lit(math.log(mixed)) + F.col("x")
    both = F.when(c > 0, F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))).otherwise(b) / math.log(10)
    one = joined.select(
        "uid",
        "doc_id",
        F.when(whole, F.col("n")).otherwise(0).alias("n"),
        F.when(whole, F.col("known")).otherwise((c > 0).cast("long")).alias("known"),
        F.when(whole, F.col("base")).otherwise(F.log10((c + 1) / F.lit(float(n + v + 1)))).alias("base"),
        F.when(whole, F.col("x")).otherwise(both).alias("score"),
    )
    out = one.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
