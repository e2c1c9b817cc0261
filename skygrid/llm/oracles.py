"""DuckDB SQL of the training-data queries whose results SQL can state. Each takes the definition, not the operator's way."""

from __future__ import annotations

from skygrid.llm import secret_scan
from skygrid.llm.sharding import DIMS, tree

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of UTF-8 texts: the table from its polynomial (a fixed value), then byte by byte. ``strings`` must have a column s.
_CRC = """crc_step(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tb FROM crc_step WHERE k = 8),
crcs AS (SELECT s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))), lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1]))) AS crc FROM (SELECT s, hex(encode(s)) AS h FROM strings), crc_table)"""


def substring_dedup(window: int = 35) -> str:
    """Every window of every document, counted; a word goes if one of the windows over it occurs twice."""
    return f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - {window} + 2)) AS i, w FROM d),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {window} - 1], ' ')) AS h FROM starts),
bad AS (SELECT doc_id, i FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY 1 HAVING count(*) > 1)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
near AS (SELECT words.doc_id, words.i, word, max(bad.i) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN bad ON words.doc_id = bad.doc_id AND words.i = bad.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS k FROM near GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def suffix_dedup(length: int = 100) -> str:
    """Every string of every document with its first start; a byte goes if a string over it is not that first one."""
    return f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, h, octet_length(h) AS n FROM d),
starts AS (SELECT doc_id, i, hash(h[i : i + {length - 1}]) AS x FROM (SELECT doc_id, h, unnest(range(1, n - {length} + 2)) AS i FROM b)),
first AS (SELECT x, min(doc_id * 1000000000 + i) AS f FROM starts GROUP BY 1),
again AS (SELECT doc_id, i FROM starts JOIN first USING (x) WHERE doc_id * 1000000000 + i > f),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM again)),
spans AS (SELECT doc_id, r, min(i) AS a, max(i) + {length} AS e FROM runs GROUP BY 1, 2),
gaps AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 1) AS p FROM spans),
parts AS (SELECT doc_id, sum(e - a) AS gone, count(*) AS n_spans, max(e) AS last, string_agg(hex(h[p : a - 1]), '' ORDER BY a) AS k FROM gaps JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, '') || hex(h[coalesce(last, 1) : n]))) AS kept_sha256 FROM b LEFT JOIN parts USING (doc_id)"""


def jaccard_components(k: int = 3, num: int = 9, den: int = 10) -> str:
    """All pairs of different sets that share a shingle, their overlap counted; components by recursion from each set."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' ')))) END AS s FROM d),
c AS (SELECT min(doc_id) AS v, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT v, n, unnest(s) AS g FROM c),
e AS (SELECT a.v AS a, b.v AS b FROM x a JOIN x b ON a.g = b.g AND a.v <> b.v AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
r AS (SELECT v, v AS c FROM c UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON c.v = m.v"""


def _weight_sql(level: str, weights: dict[str, dict[str, int]]) -> str:
    own = weights.get(level, {})
    return f"CASE {level} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in own.items()) + " ELSE 1 END" if own else "1"


def mixture(weights: dict[str, dict[str, int]], budget: float, epochs: int, seed: int = 1) -> str:
    """Budgets level by level, then the running sum of tokens over each whole leaf. Leaves under a weight of 0 are no leaves there."""
    levels = ["domain", "lang", "source"]
    weighed = " AND ".join(f"{_weight_sql(level, weights)} > 0" for level in levels)
    parts = [
        f"slim AS (SELECT doc_id, CASE WHEN md5(coalesce(source, '')) < '8' THEN 'a' ELSE 'b' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len({_WORDS.format('text')}), 0) AS tokens FROM documents)",
        f"leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {epochs} AS cap FROM slim GROUP BY 1, 2, 3)",
        f"usable AS (SELECT * FROM leaf WHERE {weighed})",
        f"a0 AS (SELECT CAST(floor(coalesce(sum(tokens), 0)::BIGINT * {budget}e0) AS BIGINT) AS budget FROM leaf)",
    ]
    for i, level in enumerate(levels):
        keys, above = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
        join = f"JOIN a{i} USING ({above})" if i else "CROSS JOIN a0"
        by = f"PARTITION BY {above} " if i else ""
        parts += [
            f"h{i} AS (SELECT {keys}, cap, weight, budget FROM (SELECT {keys}, sum(cap)::BIGINT AS cap, {_weight_sql(level, weights)} AS weight FROM usable GROUP BY {keys}) {join})",
            f"l{i} AS (SELECT *, (budget - coalesce(sum(cap) OVER ({by}ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) / (sum(weight) OVER ({by}ORDER BY cap / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lev FROM h{i})",
            f"a{i + 1} AS (SELECT {keys}, CAST(greatest(0, CASE WHEN m IS NULL THEN cap ELSE least(cap, floor(m * weight)) END) AS BIGINT) AS budget FROM (SELECT *, max(CASE WHEN cap / weight > lev THEN lev END) OVER ({by or 'PARTITION BY 1'}) AS m FROM l{i}))",
        ]
    place = f"md5('{seed}:' || {{}} || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))"
    parts += [
        f"plan AS (SELECT leaf.*, budget, least({epochs}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END) AS f FROM leaf JOIN a3 USING (domain, lang, source))",
        "q AS (SELECT *, budget - f * tokens AS rest FROM plan)",
        f"o AS (SELECT s.*, q.f, q.rest, q.budget, q.tokens AS whole, {place.format('(q.f + 1)')} AS spot FROM slim s JOIN q USING (domain, lang, source))",
        "u AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY spot) AS upto FROM o)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch FROM u, range(1, {epochs + 1}) r(e) WHERE e <= f OR (e = f + 1 AND upto <= rest AND NOT (budget = 0 AND whole > 0))"


def kd_shards(shards: int = 40) -> str:
    """Each level sorts its nodes' rows whole and cuts them where the middle of a row's bytes passes the left part's share."""
    levels = tree(shards)
    parts = [
        "strings AS (SELECT DISTINCT s FROM (SELECT text AS s FROM documents UNION ALL SELECT CAST(lang AS VARCHAR) FROM documents UNION ALL SELECT CAST(source AS VARCHAR) FROM documents UNION ALL SELECT '') WHERE s IS NOT NULL)",
        _CRC,
        "n0 AS (SELECT d.doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, t.crc AS crc, CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || t.crc), 1, 9) AS BIGINT) AS draw, [CAST(octet_length(encode(coalesce(text, ''))) + 16 AS DOUBLE), CAST(len(coalesce(text, '')) AS DOUBLE), CAST(l.crc % 1024 AS DOUBLE), CAST(s.crc % 1024 AS DOUBLE)] AS x, 1 AS node FROM documents d JOIN crcs t ON t.s = coalesce(d.text, '') JOIN crcs l ON l.s = coalesce(CAST(d.lang AS VARCHAR), '') JOIN crcs s ON s.s = coalesce(CAST(d.source AS VARCHAR), ''))",
    ]
    for i, nodes in enumerate(levels[:-1]):
        split = ", ".join(f"({n}, {k})" for n, (k, _) in nodes.items() if k > 1)
        spans = ", ".join(f"max(x[{j}]) - min(x[{j}]) AS w{j}" for j in range(1, DIMS + 1))
        alls = ", ".join(f"max(h{j}) - min(l{j}) AS w{j}" for j in range(1, DIMS + 1))
        ends = ", ".join(f"max(x[{j}]) AS h{j}, min(x[{j}]) AS l{j}" for j in range(1, DIMS + 1))
        share = lambda j: f"CASE WHEN o.w{j} > 0 THEN g.w{j} / o.w{j} ELSE 0 END"
        ratios = "[" + ", ".join(share(j) for j in range(1, DIMS + 1)) + "]"
        parts += [
            f"k{i}(node, k) AS (VALUES {split})",
            f"g{i} AS (SELECT node, k, sum(size)::BIGINT AS bytes, {spans}, {ends} FROM n{i} JOIN k{i} USING (node) GROUP BY 1, 2)",
            f"o{i} AS (SELECT {alls} FROM g{i})",
            f"d{i} AS (SELECT g.node, g.k, g.bytes, list_position({ratios}, list_max({ratios})) AS dim FROM g{i} g, o{i} o)",
            f"c{i} AS (SELECT n.*, d.k, d.bytes, sum(size) OVER (PARTITION BY n.node ORDER BY x[coalesce(d.dim, 1)], draw)::BIGINT AS upto FROM n{i} n LEFT JOIN d{i} d ON n.node = d.node)",
            f"n{i + 1} AS (SELECT doc_id, size, crc, draw, x, CASE WHEN k IS NULL THEN node WHEN k * (2 * upto - size) <= 2 * bytes * (k // 2) THEN 2 * node ELSE 2 * node + 1 END AS node FROM c{i})",
        ]
    last = ", ".join(f"({n}, {first})" for n, (_, first) in levels[-1].items())
    return f"WITH RECURSIVE {', '.join(parts)}, f(node, shard) AS (VALUES {last}) SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY draw) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM n{len(levels) - 1} JOIN f USING (node)"


def importance_resampling(buckets: int = 10_000, percent: int = 25, least: int = 20, seed: int = 7) -> str:
    """Features as strings, their CRCs by the table, counts and means by grouping, ranks by one sort."""
    words = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    feats = "len(w) AS n_words, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f"
    return f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {feats} FROM (SELECT doc_id, {words} AS w FROM documents)),
items AS (SELECT {feats} FROM (SELECT {words} AS w FROM benchmark)),
df AS (SELECT r, unnest(f) AS s FROM docs), bf AS (SELECT unnest(f) AS s FROM items),
strings AS (SELECT s FROM df UNION SELECT s FROM bf),
{_CRC},
dc AS (SELECT r, crc % {buckets} AS b FROM df JOIN crcs USING (s)), bc AS (SELECT crc % {buckets} AS b FROM bf JOIN crcs USING (s)),
ds AS (SELECT b, count(*) AS s FROM dc GROUP BY 1), bs AS (SELECT b, count(*) AS t FROM bc GROUP BY 1),
tot AS (SELECT (SELECT count(*) FROM dc) AS ss, (SELECT count(*) FROM bc) AS tt),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (ss + {buckets}) / (CAST(s + 1 AS DOUBLE) * (tt + {buckets})))) AS BIGINT) AS g FROM ds LEFT JOIN bs USING (b), tot),
w AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS g FROM dc JOIN gain USING (b) GROUP BY 1),
scored AS (SELECT doc_id, n_words, coalesce(n, 0) AS n_features, coalesce(CAST(floor(g / n) AS BIGINT), 0) AS weight, CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM docs LEFT JOIN w USING (r)),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM scored),
ranks AS (SELECT *, CASE WHEN n_words >= {least} THEN row_number() OVER (PARTITION BY n_words >= {least} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS k, floor({percent} * count(*) FILTER (WHERE n_words >= {least}) OVER () / 100) AS most FROM noisy)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN k <= most THEN CAST(k AS BIGINT) END AS rank FROM ranks"""


def merkle_manifest(levels: int = 8) -> str:
    """One CTE a level, for up to 8 ** levels rows a lang: groups that still have several nodes are hashed by runs of eight."""
    framed = lambda v: f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(framed(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    parts = [
        "strings AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents)",
        _CRC,
        f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || lang, '') AS k, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(_LOWER)} ELSE {leaf('text')} END AS f FROM documents JOIN crcs ON s = coalesce(CAST(doc_id AS VARCHAR), ''))",
        "l0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, leaf AS h FROM d)",
        "p0 AS (SELECT doc_id, d.k, leaf, f, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, '' AS sibs FROM d)",
    ]

    def climb(tag: str, key: str, n: int) -> None:
        """Levels n to n + levels of nodes (key, i, h) and of the rows' places in them."""
        for j in range(n, n + levels):
            parts.extend([
                f"m{tag}{j} AS (SELECT {key}, count(*) AS many FROM l{j} GROUP BY 1)",
                f"l{j + 1} AS (SELECT {key}, CASE WHEN many > 1 THEN i // 8 ELSE i END AS i, CASE WHEN many > 1 THEN sha256(string_agg(h, '' ORDER BY l.i)) ELSE min(h) END AS h FROM l{j} l JOIN m{tag}{j} USING ({key}) GROUP BY {key}, many, CASE WHEN many > 1 THEN i // 8 ELSE i END)",
                f"s{j} AS (SELECT l.{key}, l.i, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i < l.i), '') AS a, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i > l.i), '') AS z FROM l{j} l JOIN l{j} o ON l.{key} = o.{key} AND l.i // 8 = o.i // 8 GROUP BY 1, 2)",
                f"p{j + 1} AS (SELECT doc_id, p.k, leaf, CASE WHEN many > 1 THEN sha256(a || f || z) ELSE f END AS f, CASE WHEN many > 1 THEN p.i // 8 ELSE p.i END AS i, sibs || a || z AS sibs FROM p{j} p JOIN m{tag}{j} m ON m.{key} = p.{key} JOIN s{j} s ON s.{key} = p.{key} AND s.i = p.i)" if tag == "a" else
                f"p{j + 1} AS (SELECT doc_id, p.k, p.g, leaf, sub, CASE WHEN many > 1 THEN sha256(a || f || z) ELSE f END AS f, CASE WHEN many > 1 THEN p.i // 8 ELSE p.i END AS i, sibs || a || z AS sibs FROM p{j} p JOIN m{tag}{j} m ON m.{key} = p.{key} JOIN s{j} s ON s.{key} = p.{key} AND s.i = p.i)",
            ])

    climb("a", "k", 0)
    n = levels + 1
    parts += [
        f"l{n} AS (SELECT 0 AS g, row_number() OVER (ORDER BY k) - 1 AS i, h FROM l{levels})",
        f"p{n} AS (SELECT doc_id, p.k, 0 AS g, leaf, l.h AS sub, f, dense_rank() OVER (ORDER BY p.k) - 1 AS i, sibs FROM p{levels} p JOIN l{levels} l ON l.k = p.k)",
    ]
    climb("b", "g", n)
    return f"WITH RECURSIVE {', '.join(parts)} SELECT doc_id, leaf, sub AS subroot, h AS root, sha256(sibs) AS proof_sha256, f AS folded_root, f = h AS verified FROM p{n + levels} JOIN l{n + levels} USING (g)"


def secret_scan_spans() -> str:
    """A row a match with its place by running sums; the statistics by lists of the token's characters; thresholds by grouping."""
    c = secret_scan
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(f"SELECT r, {i} AS kind, generate_subscripts(m, 1) AS i, unnest(m) AS m, p FROM (SELECT r, regexp_extract_all(t, {quoted(c.PATTERNS[k])}) AS m, string_split_regex(t, {quoted(c.PATTERNS[k])}) AS p FROM d)" for i, k in enumerate(c.KINDS))
    full = "CASE " + " ".join(f"WHEN regexp_full_match(b, '{pattern}') THEN " + (f"'{name}'" if alphabet else "NULL") for name, (pattern, alphabet, _) in c.ENCODINGS.items()) + " END"
    rows = ", ".join(f"('{name}', '{a}', {len(a)}e0, {c.class_moments(s)[0]!r}, {c.class_moments(s)[1]!r})" for name, (_, a, s) in c.ENCODINGS.items() if a)
    sizes = "CASE " + " ".join(f"WHEN n >= {least} THEN {i}" for i, least in reversed(list(enumerate(c.LENGTHS)))) + " ELSE 0 END"
    nulls = ", ".join(f"({b}, {c.null_share(b)!r} / {c.null_share(c.MIDDLE)!r})" for b in range(c.MIDDLE, c.LAST + 1))
    kind = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(c.KINDS)) + " END"
    line = f"string_agg({kind} || ':' || a || ':' || z, ',' ORDER BY a, kind)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
pos AS (SELECT r, kind, i, m, len(m) AS n, sum(len(p[i]) + len(m)) OVER (PARTITION BY r, kind ORDER BY i)::BIGINT AS z FROM f),
spans AS (SELECT r, kind, m, z - n AS a, z FROM pos WHERE kind <> 0 OR len(regexp_extract(m, {quoted(c.PATTERNS["assign"])}, 2)) >= {c.SECRET}),
enc(e, alpha, k, ch, bes) AS (VALUES {rows}),
tok AS (SELECT r, a, z, b, len(b) AS n, string_split(b, '') AS cs, {full} AS e FROM (SELECT *, rtrim(m, '=') AS b FROM spans WHERE kind = 3)),
cls AS (SELECT *, list_transform(cs, lambda x: CASE WHEN x BETWEEN 'A' AND 'Z' THEN 1 WHEN x BETWEEN 'a' AND 'z' THEN 2 WHEN x BETWEEN '0' AND '9' THEN 3 ELSE 4 END) AS cl, list_transform(cs, lambda x: instr(alpha, x) - 1 - (k - 1) / 2) AS x FROM tok JOIN enc USING (e)),
stat AS (SELECT r, a, z, e || ':' || {sizes} AS g,
  (k * list_sum(list_transform(list_distinct(cs), lambda x: CAST((n - len(replace(b, x, ''))) ** 2 AS DOUBLE))) / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS s1,
  ((n - 1) * ch - 0.5e0 - len(list_filter(range(1, n), lambda i: cl[i] <> cl[i + 1]))) / sqrt((n - 1) * ch * (1 - ch) + 2 * (n - 2) * bes) AS s2,
  abs(list_sum(list_transform(range(1, n), lambda i: x[i] * x[i + 1]))) / ((k * k - 1) / 12 * sqrt(n - 1)) AS s3 FROM cls),
sc AS (SELECT r, a, z, g, ceil(round(10 * greatest(s1, s2, s3), 6)) AS s FROM stat),
nul(b, x) AS (VALUES {nulls}),
cum AS (SELECT g, b, x, count(*) FILTER (WHERE s <= b) AS u, count(*) FILTER (WHERE s <= {c.MIDDLE}) AS mid FROM sc, nul GROUP BY 1, 2, 3),
lim AS (SELECT g, max(b) AS most FROM cum WHERE u - mid * x <= {c.FDR} * u + 2 * sqrt(u) GROUP BY 1),
every AS (SELECT r, kind, a, z FROM spans WHERE kind < 3 UNION ALL SELECT r, 3, a, z FROM sc JOIN lim USING (g) WHERE s <= most),
per AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2, {line.replace("a, kind)", "a, kind) FILTER (WHERE kind < 3)")} AS base, {line} AS spans FROM every GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)"""
