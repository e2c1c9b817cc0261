"""N-gram Jaccard join with signature trees, as connected components.

Documents with equal shingle sets are one class, stood for by its smallest doc_id. Two linked sets
share one of their first n - ceil(t n) + 1 shingles in any common order (prefix filter). The order
puts shingles of frequent words last, so what two prefixes share is nearly always a real copy. A
shared prefix shingle is a bucket; inside a bucket a signature tree finds the links.

1. Every class is routed to one bucket it shares; the bucket's trees link whole sets. Buckets that are
   cut into several blocks are dealt to blocks once more, by another hash, so that what each block of a
   large group of near copies has joined becomes one component.
2. The last rounds cover every bucket where different components still meet: trees over bitmap
   sketches rule out what cannot reach the similarity. Of the pairs left, a bucket sends spanning
   forests over the components that meet there (64 in the first round, 64 times as many in each next
   one); these are verified exactly, the components they link become one, and buckets that held
   pairs back are searched again, until none does.

A pair that meets in several buckets is looked at in the first of them (more often only if that is
not among the first of each set's). A bucket of m sets
sends at most m - 1 pairs a forest, never all pairs of two components, and a
pair inside one component is never looked at again. Buckets are cut into blocks of bounded size in
step 1; in step 2 by set size, and those with more than ``CELL`` sets into slices that meet two at
a time (slices of one and the same component need not meet), so no group is collected whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from skygrid.llm import signature_tree as st
from skygrid.llm.common import by_key, components, dealt, grouped, lower_words, rolling, small_batches, table, text_hash, word_hashes

#: A word is frequent from this share of all words; so there are at most as many such words.
FREQUENT = 1 / 50_000
#: Shingles and documents that a block of a bucket holds at most.
BLOCK_SHINGLES, BLOCK_DOCS = 2_000_000, 1_000
#: Sets of a bucket and band that a slice holds at most; two slices meet in a task at a time.
CELL = 1_000
#: Buckets of a class that its rows name, for a pair to be looked at in one bucket only; a pair that meets later may be looked at again.
FIRST = 16
#: Bits of a shingle's hash that name its bucket, tokens that a task packs at a time. Two shingles of one name share a bucket, which costs a look and no link.
NAME_BITS, PACK = 42, 2_000_000
#: Spanning forests of candidate pairs that a bucket sends in the first round, and their growth.
FORESTS, GROWTH = 64, 64
#: Bits of a sketch: two a shingle of the band's largest set, as a power of two between these.
SKETCH_BITS = (512, 1 << 18)


def band(n: int, num: int, den: int) -> int:
    """Sets that can be linked lie in the same band of sizes or in the next."""
    return n if num == den else int(math.log(n) / math.log(den / num) + 1e-9)


def band_bits(b: int, num: int, den: int) -> int:
    largest = b if num == den else math.exp((b + 1) * math.log(den / num))
    low, high = SKETCH_BITS
    return min(high, max(low, 1 << int(2 * largest - 1).bit_length()))


def folded(sketch: bytes, bits: int) -> np.ndarray:
    """The sketch that the same set has at fewer bits."""
    words = np.frombuffer(sketch, np.uint64)
    while len(words) * 64 > bits:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def frequent_words(docs: DataFrame, share: float = FREQUENT) -> np.ndarray:
    """Sorted hashes of the words that make up ``share`` of the corpus or more, from counts over all documents.

    Each partition reports the words above the share of its own words (so at most 1 / share of them);
    the order of shingles needs only be the same everywhere, so that is enough.
    """

    def count(batches):
        from collections import Counter

        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = lower_words(text)
                n += len(words)
                seen.update(words)
            if len(seen) > 1_000_000:  # words this rare cannot reach the share of this partition's words so far
                seen = Counter({w: c for w, c in seen.items() if c > 1})
        common = [(w, c) for w, c in seen.items() if c >= share * n]
        yield pa.RecordBatch.from_pydict({"h": pa.array([np.uint64(xxh64_intdigest(w)).astype(np.int64) for w, _ in common], pa.int64()), "c": pa.array([c for _, c in common], pa.int64()), "n": pa.array([0] * len(common), pa.int64())})
        yield pa.RecordBatch.from_pydict({"h": pa.array([0], pa.int64()), "c": pa.array([0], pa.int64()), "n": pa.array([n], pa.int64())})

    counts = table(docs.select("text").mapInArrow(count, "h long, c long, n long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("c") >= max(1.0, share * total)).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def _shingles(words: list[bytes], k: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how many frequent words each has."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(words) < k:
        return np.array([xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64), np.zeros(1, np.int64)
    h = word_hashes(words)
    common = np.zeros(len(h), np.int64)
    if len(frequent):
        common = (frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h).astype(np.int64)
    sets, first = np.unique(rolling(h, k), return_index=True)
    return sets, np.convolve(common, np.ones(k, np.int64), "valid")[first]


def set_key(s: np.ndarray) -> bytes:
    """128-bit digest of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _names(prefix: np.ndarray) -> bytes:
    """The bucket names of prefix shingles, NAME_BITS each and nothing between them."""
    bits = np.unpackbits(prefix.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return np.packbits(bits[:, :NAME_BITS]).tobytes()


def _named(prefix: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket names of a column of ``_names`` or of lists of shingles, and how many each row has."""
    if not pa.types.is_binary(prefix.type):
        return prefix.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - NAME_BITS), np.diff(prefix.offsets.to_numpy())
    rows = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(x) * 8 // NAME_BITS * NAME_BITS).reshape(-1, NAME_BITS) for x in prefix.to_pylist()]
    length = np.fromiter(map(len, rows), np.int64, len(rows))
    wide = np.zeros((int(length.sum()), 64), np.uint8)
    if len(wide):
        wide[:, 64 - NAME_BITS :] = np.concatenate(rows)
    return np.packbits(wide).view(">u8").astype(np.uint64), length


def _prefixes(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, th, n, key, prefix): hash of the text, set size, digest of the set (null: empty), packed names of the prefix shingles."""

    def run(batches):
        for batch in batches:
            n, keys, prefix = [], [], []
            for text in batch.column("text").to_pylist():
                s, common = _shingles(lower_words(text), k, frequent)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                p = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                prefix.append(_names(s[np.lexsort((s, common))[:p]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "th", "n", "key", "prefix"])

    return _texts(docs).mapInArrow(run, "doc_id long, th long, n long, key binary, prefix binary")


def _texts(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_hash(text).alias("th"), text.alias("text"))


def _own_sets(texts: list, keys: list, k: int) -> list[np.ndarray | None]:
    """The set of each text; None where it is not the class's (another row with the same doc_id)."""
    sets = (_shingles(lower_words(t), k, np.empty(0, np.uint64))[0] for t in texts)
    return [s if set_key(s) == key else None for s, key in zip(sets, keys, strict=True)]


def _packed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: small ones of a wide type take little."""
    return zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def _unpacked(packs: list[bytes], kind: type) -> list[np.ndarray]:
    width = np.dtype(kind).itemsize
    return [np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(width, -1).T).view(kind).ravel() for x in packs]


def _shared(heads: DataFrame) -> DataFrame:
    """(bucket, cid, n): the buckets that more than one class of heads (cid, n, prefix) names, with these classes.

    Names travel once, packed by their first bits with the classes next to them; a task holds one such piece at a time.
    """

    def pack(batches):
        held, size = [], 0

        def flush():
            name, cid, n = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(name, kind="stable")
            name, cid, n = name[order], cid[order], n[order]
            low = (name & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            at = np.flatnonzero(np.diff(name >> np.uint64(32), prepend=np.uint64(1 << 63)))
            cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(name)], strict=True))
            piece = (name[at] >> np.uint64(32)).astype(np.int32)
            rows = [(np.diff(low[a:b], prepend=np.uint32(0)), cid[a:b], n[a:b]) for a, b in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(piece)] + [pa.array([_packed(x) for x in c], pa.binary()) for c in zip(*rows, strict=True)], ["piece", "names", "cids", "ns"])

        for batch in batches:
            flat, length = _named(batch.column("prefix"))
            if len(flat):
                held.append((flat, *(np.repeat(batch.column(c).to_numpy(), length) for c in ("cid", "n"))))
                size += len(flat)
            if size >= PACK:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def unpack(batches):
        for (piece,), (names, cids, ns) in grouped(batches, ["piece"], ["names", "cids", "ns"]):
            name = np.concatenate([np.cumsum(x, dtype=np.uint32) for x in _unpacked(names, np.uint32)]).astype(np.int64) | piece << 32
            cid, n = (np.concatenate(_unpacked(x, np.int64)) for x in (cids, ns))
            order = np.lexsort((cid, name))
            name, cid, n = name[order], cid[order], n[order]
            own = np.append(True, (name[1:] != name[:-1]) | (cid[1:] != cid[:-1]))  # a class names a bucket once
            name, cid, n = name[own], cid[own], n[own]
            more = name[1:] == name[:-1]
            kept = np.flatnonzero(np.append(more, False) | np.append(False, more))
            for k in range(0, len(kept), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[kept[k : k + 100_000]]) for x in (name, cid, n)], ["bucket", "cid", "n"])

    packed = heads.select("cid", "n", "prefix").mapInArrow(pack, "piece int, names binary, cids binary, ns binary")
    return dealt(packed, "piece").mapInArrow(unpack, "bucket long, cid long, n long")


def _zipped(routed: DataFrame) -> DataFrame:
    """routed (cid, c, bucket, block, key, text) with each text compressed, which is less to shuffle."""

    def run(batches):
        for batch in batches:
            texts = [zlib.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], ["cid", "c", "bucket", "block", "key", "text"])

    return routed.select("cid", "c", "bucket", "block", "key", "text").mapInArrow(run, "cid long, c long, bucket long, block long, key binary, text binary")


def _linked(routed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(v, c): each component that rows (bucket, block, cid, c, key, text) of a block link to a smaller one, and the smallest."""

    def run(batches):
        for _, (cids, c, keys, texts) in grouped(batches, ["bucket", "block"], ["cid", "c", "key", "text"]):
            if min(c) < max(c):
                own = {cid: (s, x) for cid, s, x in zip(cids, _own_sets([zlib.decompress(t).decode("utf-8", "surrogatepass") for t in texts], keys, k), c, strict=True) if s is not None}
                found = st.linked([s for s, _ in own.values()], [x for _, x in own.values()], num, den)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["v", "c"])

    return dealt(_zipped(routed), "bucket", "block").mapInArrow(run, "v long, c long")


def _groups(rows: DataFrame) -> DataFrame:
    """(bucket, band) that can hold new links: components meet there and a row is at home.

    A passage of many shingles gives many buckets the same members; of those one is enough. Members are
    compared by their number and a 128-bit digest.
    """
    digest = lambda seed: F.bit_xor(F.xxhash64("cid", "home", F.lit(seed)))
    met = rows.groupBy("bucket", "band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.bool_or("home").alias("any"), F.count(F.lit(1)).alias("m"), digest(0).alias("x"), digest(1).alias("y"))
    return met.where("lo < hi and any").groupBy("m", "x", "y").agg(F.min(F.struct("bucket", "band")).alias("g")).select("g.bucket", "g.band", "m")


def _cells(rows: DataFrame, cell: int) -> DataFrame:
    """rows (bucket, band, home, cid, c, m) of groups of m rows with the cells (x, y) they meet in.

    A group of up to ``cell`` rows is one cell. A larger one is cut into slices: those of a component
    with more than half a slice of rows hold only it, the other components are dealt to slices whole. A
    cell holds two slices, unless both are of one component.
    """
    small = rows.where(F.col("m") <= cell).select("bucket", "band", "home", "cid", "c", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    if not rows.where(F.col("m") > cell).limit(1).count():
        return small
    hot = rows.where(F.col("m") > cell)
    held = hot.groupBy("bucket", "band", "c").agg(F.count(F.lit(1)).alias("k")).withColumn("big", F.col("k") * 2 > cell)
    parts = held.groupBy("bucket", "band").agg(F.ceil(F.sum(F.when(~F.col("big"), F.col("k")).otherwise(0)) / cell).alias("parts"))
    pieces = F.when(F.col("big"), F.ceil(F.col("k") / cell)).otherwise(1)
    held = held.join(parts, ["bucket", "band"]).select("bucket", "band", "c", pieces.cast("long").alias("pieces"), F.when(F.col("big"), F.col("c")).alias("pure"), F.pmod(F.xxhash64("c"), F.greatest("parts", F.lit(1)).cast("long")).alias("at"))
    slice_of = lambda piece: F.when(F.col("pure").isNotNull(), F.xxhash64("c", piece)).otherwise(F.col("at"))
    cut = table(hot.join(held, ["bucket", "band", "c"]).select("bucket", "band", "home", "cid", "c", "pure", slice_of(F.pmod(F.xxhash64("cid"), F.col("pieces"))).alias("s")))
    slices = cut.select("bucket", "band", "s", "pure").distinct()
    other = slices.select("bucket", "band", F.col("s").alias("t"), F.col("pure").alias("other"))
    pairs = slices.join(other, ["bucket", "band"]).where((F.col("s") == F.col("t")) & F.col("pure").isNull() | (F.col("s") != F.col("t")) & ~F.coalesce(F.col("pure") == F.col("other"), F.lit(False)))
    meet = pairs.select("bucket", "band", "s", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"))
    return small.unionByName(cut.join(meet, ["bucket", "band", "s"]).select("bucket", "band", "home", "cid", "c", "x", "y"))


def spanning(i: np.ndarray, j: np.ndarray, forests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that join two trees of a forest (rows: forests, columns: each set's tree), and whether any is left over.

    A pair goes to the first forest in which its sets are in different trees; the forests are updated.
    """
    taken, rest = [], np.arange(len(i))
    for tree in forests:
        while True:
            rest_open = tree[i[rest]] != tree[j[rest]]
            if not rest_open.any():
                break
            at = int(rest_open.argmax())
            e = rest[at]
            taken.append(e)
            tree[tree == tree[j[e]]] = tree[i[e]]
            rest = np.delete(rest, at)
    return np.array(taken, np.int64), rest


def _candidates(rows: DataFrame, num: int, den: int, count: int) -> DataFrame:
    """Pairs of rows (bucket, band, x, y, home, cid, n, c, sketch, buckets) that the trees cannot rule out, as ``count`` spanning forests a cell.

    buckets: those before this one, of the first of the class's in that band; a pair belongs to the smallest that both have.
    Result (a, b, ca, cb, bucket, band): classes, their components and, in a row without classes, a group that held pairs back.
    """
    columns, kinds = ["a", "b", "ca", "cb", "bucket", "band"], [pa.int64()] * 5 + [pa.int32()]

    def run(batches):
        for (bucket, b, _, _), (home, ids, n, c, sketch, buckets) in grouped(batches, ["bucket", "band", "x", "y"], ["home", "cid", "n", "c", "sketch", "buckets"]):
            if min(c) == max(c):
                continue
            order = np.lexsort((ids, n))
            marks = np.array([folded(sketch[i], band_bits(b, num, den)) for i in order])
            size, c = np.array(n, np.int64)[order], np.array(c, np.int64)[order]
            names, group = np.unique(c, return_inverse=True)
            ids, home = np.array(ids, np.int64)[order], np.array(home, bool)[order]
            forests, more, lower = np.tile(group, (min(count, len(names)), 1)), False, {}

            def before(k):
                """The class's buckets before this one."""
                if k not in lower:
                    lower[k] = set(buckets[order[k]])
                return lower[k]

            for i, j in st.traverse(st.build(marks, size, group), num, den):
                own = home[i] | home[j]
                i, j = i[own], j[own]
                first = np.array([before(x).isdisjoint(before(y)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j = i[first], j[first]
                if count < len(names):
                    both = np.bitwise_count(marks[i] & marks[j]).sum(1)
                    likely = np.argsort(-both / (size[i] + size[j]), kind="stable")  # the most alike first
                    i, j = i[likely], j[likely]
                    pick, rest = spanning(i, j, forests)
                    more = more or len(rest) > 0
                    i, j = i[pick], j[pick]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], ids[j], c[i], c[j])] + [pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int32())], columns)
            if more:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, bucket, b), kinds, strict=True)], columns)

    return dealt(rows, "bucket", "band", "x", "y").mapInArrow(run, "a long, b long, ca long, cb long, bucket long, band int")


def _sketches(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(cid, n, own, sketch): size, its band, bitmap of the shingles as wide as the next band calls for."""

    def run(batches):
        for batch in batches:
            cids = batch.column("cid").to_pylist()
            found = [(i, s) for i, s in zip(cids, _own_sets(batch.column("text").to_pylist(), batch.column("key").to_pylist(), k), strict=True) if s is not None]
            own = [band(len(s), num, den) for _, s in found]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array(own, pa.int32()), pa.array([st.bitmap(s, band_bits(b + 1, num, den)).tobytes() for (_, s), b in zip(found, own, strict=True)], pa.binary())], ["cid", "n", "own", "sketch"])

    return docs.mapInArrow(run, "cid long, n long, own int, sketch binary")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): components of the pairs (a, b, ca, cb) of classes whose whole sets reach the similarity. texts: (cid, key, text)."""

    def run(batches):
        for batch in batches:
            sets = [_own_sets(batch.column(t).to_pylist(), batch.column(key).to_pylist(), k) for t, key in (("x", "kx"), ("y", "ky"))]
            keep = []
            for s, t in zip(*sets, strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True)) if s is not None and t is not None else 0
                keep.append(both > 0 and both * den >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("ca"), batch.column("cb")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, key, t: texts.select(F.col("cid").alias(c), F.col("key").alias(key), F.col("text").alias(t))
    return pairs.join(side("a", "kx", "x"), "a").join(side("b", "ky", "y"), "b").select("ca", "cb", "kx", "ky", "x", "y").mapInArrow(run, "a long, b long").distinct()


def merged(comp: DataFrame | None, names: DataFrame) -> DataFrame:
    """Labels (v, c) of classes after components became ``names`` (v, c); classes alone so far are components of their own."""
    if comp is None:
        return table(names.unionByName(names.select(F.col("c").alias("v"), "c").distinct()))
    new = comp.join(names.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
    return table(new.unionByName(names).groupBy("v").agg(F.min("c").alias("c")))


def labelled(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Per document (doc_id, th, n_shingles, component, component_id); th: hash of the text, component: a label without meaning.

    Words are lower-cased (A-Z). A text of fewer words is one shingle; one without words (null, empty)
    has an empty set and no component, and its component_id is its doc_id. component_id is the
    smallest doc_id reachable by links (null if only null ones are). Rows that repeat a doc_id and text
    give equal rows; rows that share a doc_id but not the text are linked each on its own. Equal sets,
    however many, are one class. An empty table gives an empty one; extra columns take no part.
    """
    small_batches(docs.sparkSession)
    frequent = frequent_words(docs)
    sets = table(_prefixes(docs, k, num, den, frequent))
    # drawn once, as the table is written
    classes = table(sets.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("first"), F.max("n").alias("n")).select("key", "n", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("th"), F.monotonically_increasing_id().alias("cid")))
    at = lambda d: d["doc_id"].eqNullSafe(classes["rep"]) & (d["th"] == classes["th"])
    heads = sets.where("n > 0").join(classes, (sets["key"] == classes["key"]) & at(sets))
    stored_twice = heads.groupBy("cid").count().where("count > 1").limit(1).count() > 0
    shared = table(_shared(heads.select("cid", classes["n"], "prefix")))
    texts, comp = _texts(docs), None

    def fresh():
        """Rows of shared, with component c, in buckets where different components meet."""
        now = shared.withColumn("c", F.col("cid")) if comp is None else shared.join(comp.withColumnRenamed("v", "cid"), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
        apart = now.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
        return table(now.join(apart, "bucket"))

    def wanted(ids: DataFrame) -> DataFrame:
        """The texts of ids (cid, ...), one a class, with the classes' keys."""
        named = ids.join(classes.select("cid", "key", "rep", F.col("th").alias("rth")), "cid")
        out = by_key(texts, table(named), texts["doc_id"].eqNullSafe(F.col("rep")) & (texts["th"] == F.col("rth"))).drop("doc_id", "th", "rep", "rth")
        return out.dropDuplicates(ids.columns) if stored_twice else out

    left = fresh()
    for turn in (0, 1):
        route = left.groupBy("cid", "n", "c").agg(F.min("bucket").alias("bucket"))
        full = route.groupBy("bucket").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
        full = table(full.where(F.col("blocks") > turn))
        if not full.limit(1).count():
            break
        route = route.join(full, "bucket").select("cid", "c", "bucket", F.pmod(F.xxhash64("cid", F.lit(turn)), "blocks").alias("block"))
        found = table(_linked(wanted(route), k, num, den))
        if found.limit(1).count():
            # in the first turn each class is in one block, so its block's label is its component
            comp = merged(comp, found if comp is None else components(found.select(F.col("v").alias("a"), F.col("c").alias("b"))))
            left = fresh()
    if left.limit(1).count():
        sketch = table(_sketches(wanted(left.select("cid").distinct()), k, num, den))
        rows = left.select("bucket", "cid", "c").join(sketch.select("cid", "own"), "cid")
        rows = table(rows.withColumn("band", F.explode(F.array("own", F.col("own") + 1))).withColumn("home", F.col("band") == F.col("own")).drop("own"))
        groups, count = table(_groups(rows)), FORESTS
        while groups.limit(1).count():
            # a class has at most as many buckets as its prefix has shingles; the first ones tell nearly all pairs that met before
            open_ = table(rows.join(groups, ["bucket", "band"]))
            met = open_.groupBy("cid", "band").agg(F.slice(F.array_sort(F.collect_set("bucket")), 1, FIRST).alias("buckets"))
            placed = _cells(open_, CELL).join(met, ["cid", "band"]).withColumn("buckets", F.filter("buckets", lambda x: x < F.col("bucket")))  # those before
            placed = placed.join(sketch.select("cid", "n", "sketch"), "cid")  # last, so that a sketch is dealt once before it goes to its cells
            pairs = table(_candidates(placed.select("bucket", "band", "x", "y", "home", "cid", "n", "c", "sketch", "buckets"), num, den, count))
            try_now = table(pairs.where("a is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("ca").alias("ca"), F.max("cb").alias("cb")))
            edges = None
            if try_now.limit(1).count():
                ids = try_now.select(F.col("a").alias("cid")).union(try_now.select(F.col("b").alias("cid"))).distinct()
                edges = table(_verified(try_now, table(wanted(ids)), k, num, den))
            names = components(edges) if edges is not None and edges.limit(1).count() else None
            if names is not None:
                comp = merged(comp, names)
            back = pairs.where("a is null").select("bucket", "band").distinct()
            if not back.limit(1).count():
                break
            rows, count = rows.join(back, ["bucket", "band"], "left_semi"), count * GROWTH
            if names is not None:
                rows = rows.join(names.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").withColumn("c", F.coalesce("to", "c")).drop("to")
            rows = table(rows)
            groups = table(_groups(rows))
    out = sets.join(classes.select("key", "cid", "rep"), "key", "left")
    if comp is None:
        out = out.withColumn("component", F.col("cid")).withColumn("component_id", F.col("rep"))
    else:
        first = comp.join(classes.select(F.col("cid").alias("v"), "rep"), "v").groupBy("c").agg(F.min("rep").alias("least"))
        told = comp.join(first, "c").select(F.col("v").alias("cid"), "c", "least")
        out = out.join(told, "cid", "left").withColumn("component", F.coalesce("c", "cid")).withColumn("component_id", F.when(F.col("c").isNotNull(), F.col("least")).otherwise(F.col("rep")))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Per document (doc_id, n_shingles, component_id), as ``labelled`` states them, for similarity num / den or more."""
    return labelled(docs, k, num, den).select("doc_id", "n_shingles", "component_id")
