"""Secret scan against plain Python and SQL; the battery on random strings, words and paths."""

import random
import re
import string
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from skygrid.llm import oracles, secret_scan
from tests.llm.test_oracles import sql_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    line = ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in sorted(found))
    return *(sum(f[1] == k for f in found) for k in range(3)), sha256(line.encode()).hexdigest()


def texts():
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    out = [None, "", " ", "nothing here", f"Password: {hexes(30)}", f'"api_key" = "{hexes(24)}" apikey=ab token=token=abcdef', "secret=token:abcdefghij", "to\u017fken PASS\u017fWORD=abcdefg secret=\u212aabcdef", "AKIA" + "A" * 15, "AKIAKIA" + "Z9" * 10, "\U0001f600\u00e9 " + hexes(24) + "\U0001f600" + hexes(23), hexes(24), "AKIA" * 6]
    out += [" ".join(rng.choice([hexes(rng.randint(20, 50)), "secret='x.y-z/1234='", "word", "AKIA" + "7" * rng.randint(10, 30)]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    return out + [" ".join(hexes(24) + "g" for _ in range(2000))] + ["the same line with token: 0123456789abcdef01234567"] * 60


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("secrets") / "d.parquet")
    rows = [(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, random int, hex string").repartition(3).write.parquet(path)
    return spark.read.parquet(path), path + "/*.parquet", rows


def test_base_spans_equal_plain_python(docs):
    df, _, rows = docs
    got = secret_scan.scan(df)
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got.collect()) == Counter((i, *base(t)) for i, t, _, _ in rows)
    for r in got.collect():
        kept = ",".join(s for s in r.spans.split(",") if not s.startswith("random"))
        assert sha256(kept.encode()).hexdigest() == r.base_sha256


def test_all_spans_equal_sql(docs):
    df, path, _ = docs
    got = secret_scan.scan(df)
    assert Counter(map(tuple, got.collect())) == sql_rows(oracles.secret_scan_spans(), path, got.columns)


def test_places_over_blocks(spark, docs, monkeypatch):
    whole = Counter(map(tuple, secret_scan.scan(docs[0]).collect()))
    monkeypatch.setattr(secret_scan, "BLOCK", 3)
    assert Counter(map(tuple, secret_scan.scan(docs[0]).collect())) == whole


def test_random_strings_are_told_from_words_and_paths(spark):
    rng = random.Random(4)
    alphabets = {"hex_upper": string.digits + "ABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.digits + string.ascii_lowercase, "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_"}
    words = "the of and station report measure north wind temperature value record science history process system people work number general public field order water state house".split()
    rows, i = [], 0
    for alphabet in alphabets.values():
        for _ in range(60):
            rows.append((i, "key " + "".join(rng.choices(alphabet, k=rng.randint(24, 60))), True))
            i += 1
    for shape in ("".join, "-".join, "_".join, "/".join, lambda w: "".join(x.title() for x in w)):
        for _ in range(60):
            rows.append((i, "path " + shape(rng.choices(words, k=rng.randint(5, 9))), False))
            i += 1
    rows += [(i + 1, "n 1234567890123456789012345", False), (i + 2, "z " + "a" * 500, False), (i + 3, "q abcdefghijklmnopqrstuvwxyz0123456789", False)]
    found = {r.doc_id for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, planted boolean")).where(F.col("spans").contains("random")).collect()}
    planted = {r[0] for r in rows if r[2]}
    assert len(found & planted) >= 0.93 * len(planted)
    assert len(found - planted) <= 0.02 * (len(rows) - len(planted))


def test_empty_table_and_null_distribution(spark):
    assert secret_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(1)
    rows = [("".join(rng.choices(string.ascii_letters + string.digits, k=rng.choice([20, 32, 64]))),) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "t string").withColumn("s", secret_scan.score(F.col("t"), F.lit("base62")))
    below = {b: frame.where(F.col("s") <= b).count() / 3000 for b in (secret_scan.MIDDLE, secret_scan.LAST)}
    assert all(abs(share - secret_scan.null_share(b)) < 0.1 for b, share in below.items())
