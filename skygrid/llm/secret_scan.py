"""Secret scan by patterns and by a battery of randomness tests, in SQL functions only.

Patterns give the base spans. Besides, every run of 20 or more characters of base64 or base64url is a
candidate. Its encoding is the smallest alphabet that holds it (hex, base32, base36, base62, base64,
base64url; decimal numbers are no secrets), and under that encoding three statistics compare it with
independent uniform draws: chi-squared of the symbol counts, runs of character classes (digits, upper,
lower, other), and serial correlation of neighbours' places in the alphabet. Each has mean 0 and variance 1
for a random string and grows with structure; the largest of the three is the candidate's score.

Random strings fill the scores below the null distribution's median and are few above 2.5; words and
paths reach down the more the shorter they are. So each (encoding, length class) gets its own threshold
from counts over all candidates: the largest up to 2.5 where those below it exceed what the null
distribution, scaled to the candidates under its median, expects by at most a share ``FDR`` of
them and two standard deviations. A candidate at or under the threshold is a span of kind ``random``.

One scan writes gaps and lengths of the matches, not texts; places are running sums over those, taken in
blocks so that a text of many matches costs no square. Nothing is shuffled but the counts (26 bins a
class).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrid.llm.common import table

KINDS = ("assign", "access", "hex", "random")
_WORDS = ("password", "passwd", "secret", "token", "api_?key")


def either_case(word: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)


#: Of hex and access only matches that are long enough, which are the same spans; a short assign still uses up its text.
PATTERNS = {
    "assign": "(" + "|".join(map(either_case, _WORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "random": "[A-Za-z0-9+/_-]{20,}={0,2}",
}
SECRET = 6
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name: (pattern of the whole token, alphabet, sizes of its character classes), smallest first.
ENCODINGS = {
    "decimal": ("[0-9]+", "", ()),
    "hex_lower": ("[0-9a-f]+", DIGITS + "abcdef", (10, 6)),
    "hex_upper": ("[0-9A-F]+", DIGITS + "ABCDEF", (10, 6)),
    "base32": ("[A-Z2-7]+", UPPER + "234567", (26, 6)),
    "base36": ("[a-z0-9]+", DIGITS + LOWER, (10, 26)),
    "base62": ("[A-Za-z0-9]+", UPPER + LOWER + DIGITS, (26, 26, 10)),
    "base64": ("[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/", (26, 26, 10, 2)),
    "base64url": ("[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "-_", (26, 26, 10, 2)),
}
#: First lengths of the length classes.
LENGTHS = (20, 28, 40, 64)
#: Scores are counted in tenths: the last that may pass, and the one nearest to the null median.
LAST, MIDDLE = 25, 10
FDR = 0.05
#: Matches whose places are summed one after the other.
BLOCK = 256
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def null_share(tenths: int) -> float:
    """Share of random strings whose three statistics, one of them by its size, are all at most so many tenths."""
    phi = 0.5 * (1 + math.erf(tenths / 10 / math.sqrt(2)))
    return phi * phi * (2 * phi - 1)


def class_moments(sizes: tuple[int, ...]) -> tuple[float, float]:
    """Chance that two neighbours differ in class, and the covariance of two such events side by side."""
    shares = [s / sum(sizes) for s in sizes]
    change = 1 - sum(p * p for p in shares)
    return change, sum(p * (1 - p) ** 2 for p in shares) - change * change


def matches(text: Column, pattern: str, short: Column | None = None, **fields) -> Column:
    """Array of (gap before, n characters, fields of the match) of all matches in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = lambda before, m: F.struct(F.length(before).alias("gap"), F.length(m).alias("n"), *(f(m).alias(k) for k, f in fields.items()))
    zipped = F.filter(F.zip_with(F.split(text, pattern, -1), found, one), lambda x: x["n"].isNotNull())
    kinds = "".join(f",{k}:string" for k in fields)
    return F.when(text.rlike(pattern), zipped).otherwise(F.array().cast(f"array<struct<gap:int,n:int{kinds}>>"))


def places(found: Column, kind: int) -> Column:
    """(start, kind, end) of each match from gaps and lengths; ``found`` must be a stored column."""
    none, at0 = F.array().cast(_SPANS), F.lit(0).cast("long")
    step = lambda acc, m: F.struct((acc["at"] + m["gap"] + m["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + m["gap"] + m["n"]).alias("end")))).alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(found, b * BLOCK + 1, F.lit(BLOCK)), F.struct(at0.alias("at"), none.alias("out")), step))
    moved = lambda acc, b: F.transform(b["out"], lambda s: F.struct((acc["at"] + s["start"]).alias("start"), s["kind"].alias("kind"), (acc["at"] + s["end"]).alias("end")))
    join = lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved(acc, b))).alias("out"))
    whole = F.aggregate(blocks, F.struct(at0.alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")), join, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(found) > 0, whole).otherwise(none)


def _by_encoding(encoding: Column, value) -> Column:
    out = F.lit(None)
    for name, (_, alphabet, sizes) in ENCODINGS.items():
        if alphabet:
            out = F.when(encoding == name, F.lit(value(alphabet, sizes))).otherwise(out)
    return out


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def encoding_of(body: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (pattern, alphabet, _) in reversed(ENCODINGS.items()):
        out = F.when(body.rlike(f"^{pattern}$"), F.lit(name if alphabet else None)).otherwise(out)
    return out


def score(body: Column, encoding: Column) -> Column:
    """The largest of the three statistics, in tenths, rounded up."""
    n = F.length(body).cast("double")
    k = _by_encoding(encoding, lambda a, s: float(len(a)))
    change = _by_encoding(encoding, lambda a, s: class_moments(s)[0])
    beside = _by_encoding(encoding, lambda a, s: class_moments(s)[1])
    signs = F.split(body, "")

    def battery(chars: Column) -> Column:
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
        uniform = (k * squares / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        classes = F.translate(body, UPPER + LOWER + DIGITS + "+/-_", "A" * 26 + "a" * 26 + "0" * 10 + "////")
        runs = F.length(classes) - F.length(F.regexp_replace(classes, r"(?<=(.))\1", ""))  # neighbours alike
        changes = n - 1 - runs
        few = ((n - 1) * change - 0.5 - changes) / F.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * beside)
        place = F.transform(chars, lambda c: F.instr(_by_encoding(encoding, lambda a, s: a), c) - 1 - (k - 1) / 2)
        serial = let(place, lambda x: F.aggregate(F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a * b), F.lit(0.0), lambda acc, p: acc + F.coalesce(p, F.lit(0.0))))
        correlation = F.abs(serial) / ((k * k - 1) / 12 * F.sqrt(n - 1))
        return F.ceil(F.round(10 * F.greatest(uniform, few, correlation), 6)).cast("int")

    return F.when(encoding.isNotNull(), let(signs, battery))


def _class(encoding: Column, body: Column) -> Column:
    size = F.lit(0)
    for i, least in enumerate(LENGTHS):
        size = F.when(F.length(body) >= least, F.lit(i)).otherwise(size)
    return F.concat_ws(":", encoding, size.cast("string"))


def thresholds(counts: DataFrame) -> DataFrame:
    """(group, most): the last score in tenths that passes, from counts (group, tenths, n) of all candidates."""
    upto = F.array(*(F.coalesce(F.sum(F.when(F.col("tenths") <= b, F.col("n"))), F.lit(0)) for b in range(LAST + 1)))
    expected = F.array(*(F.lit(null_share(b) / null_share(MIDDLE)) for b in range(LAST + 1)))
    fits = lambda b: F.col("upto")[b] - F.col("upto")[MIDDLE] * F.col("expected")[b] <= FDR * F.col("upto")[b] + 2 * F.sqrt(F.col("upto")[b])
    sums = counts.groupBy("group").agg(upto.alias("upto")).withColumn("expected", expected)
    return sums.select("group", F.array_max(F.filter(F.sequence(F.lit(MIDDLE), F.lit(LAST)), fits)).alias("most"))


def scan(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) as doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Places are code points, ends exclusive. ``base_sha256`` hashes the base spans as
    kind:start:end, by start, then kind as listed, joined by commas; ``spans`` is that text with the
    random ones added, which may cover a base span too. Null and empty texts have no spans: counts of 0,
    the hash of the empty text, empty spans. Texts are read whole, however long, and one with very many matches
    is still one row. Repeated rows are rows of their own. Other columns are ignored, whatever their
    names. An empty table gives an empty one.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    token = lambda m: m
    kept = {k: {} for k in KINDS} | {"assign": {"secret": lambda m: F.regexp_extract(m, PATTERNS["assign"], 2)}, "random": {"token": token}}
    found = table(docs.select(docs["doc_id"].alias("doc_id"), *(matches(text, PATTERNS[k], **kept[k]).alias(k) for k in KINDS)))
    body = lambda m: F.rtrim(m["token"], F.lit("="))
    judged = F.transform("random", lambda m: let(body(m), lambda b: let(encoding_of(b), lambda e: F.struct(_class(e, b).alias("group"), score(b, e).alias("tenths")))))
    spans = {k: places(F.col(k), i) for i, k in enumerate(KINDS)}
    spans["assign"] = F.filter(F.zip_with(spans["assign"], F.transform("assign", lambda m: F.length(m["secret"]) >= SECRET), lambda s, ok: F.when(ok, s)), lambda s: s.isNotNull())
    placed = table(found.select("doc_id", *(spans[k].alias(k) for k in KINDS), judged.alias("judged")))
    counts = placed.select(F.explode("judged").alias("j")).where("j.tenths is not null").select("j.*").withColumn("tenths", F.least(F.greatest("tenths", F.lit(0)), F.lit(LAST + 1)))
    limits = thresholds(counts.groupBy("group", "tenths").agg(F.count(F.lit(1)).alias("n")))
    limits = table(limits.agg(F.map_from_entries(F.collect_list(F.struct("group", "most"))).alias("limits")))  # an entry an encoding and length class
    passed = F.filter(F.zip_with("random", "judged", lambda s, j: F.when(j["tenths"] <= F.try_element_at("limits", j["group"]), s)), lambda s: s.isNotNull())
    shown = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.concat("assign", "access", "hex")
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return placed.withColumn("limits", limits.scalar()).select("doc_id", *sizes, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.concat(base, passed)).alias("spans"))
