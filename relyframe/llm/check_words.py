"""DuckDB SQL for the queries on spelling, periodic runs and fingerprints, with the checksums they need written as expressions."""

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _nibbles() -> list[int]:
    """The sixteen entries of the CRC-32 table by half bytes."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_NIBBLES = "(CAST([" + ", ".join(map(str, _nibbles())) + "] AS BIGINT[]))"


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text expression, two half bytes at a time."""
    half = "xor({c} >> 4, " + _NIBBLES + "[1 + (xor({c}, {n}) & 15)])"
    low = half.format(c="s", n="b")
    both = half.format(c=f"({low})", n="(b >> 4)")
    codes = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda s, b: {both}, 4294967295::BIGINT), 4294967295)"


# XXH64's primes, fixed by its definition.
_P = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
_MOD = "18446744073709551616::UHUGEINT"


def _mul(x: str, y: int) -> str:
    return f"(({x})::UHUGEINT * {y}::UHUGEINT % {_MOD})"


def _rotl(x: str, r: int) -> str:
    return f"((({x})::UHUGEINT * {1 << r}::UHUGEINT % {_MOD}) + (({x})::UHUGEINT // {1 << (64 - r)}::UHUGEINT))"


def _add(x: str, y: str) -> str:
    return f"((({x})::UHUGEINT + ({y})::UHUGEINT) % {_MOD})"


def _xor(x: str, y: str) -> str:
    return f"xor(({x})::UHUGEINT, ({y})::UHUGEINT)"


def _round(acc: str, lane: str) -> str:
    return _mul(_rotl(_add(acc, _mul(lane, _P[1])), 31), _P[0])


def _shift(x: str, r: int) -> str:
    return _xor(x, f"({x})::UHUGEINT // {1 << r}::UHUGEINT")


def xxh64_steps(source: str, seed: int) -> str:
    """Common table expressions that end in ``hashed(g, h)`` for the distinct texts g of ``source``."""
    lane = "('0x' || substr(rev, length(rev) - 2 * ({at} + {n}) + 1, 2 * {n}))::UHUGEINT"
    start = [(seed + _P[0] + _P[1]) % 2**64, (seed + _P[1]) % 2**64, seed, (seed - _P[0]) % 2**64]
    stripes = ",\n".join(
        f"CASE WHEN len >= 32 THEN list_reduce(list_transform(range(len // 32), lambda k: {lane.format(at=f'(32 * k + {8 * i})', n=8)}), lambda acc, v: {_round('acc', 'v')}, {start[i]}::UHUGEINT) END AS a{i}"
        for i in range(4)
    )
    merged = _add(_add(_rotl("a0", 1), _rotl("a1", 7)), _add(_rotl("a2", 12), _rotl("a3", 18)))
    steps = [f"b0 AS MATERIALIZED (SELECT g, len, rev, a0, a1, a2, a3, CASE WHEN len >= 32 THEN {merged} ELSE {(seed + _P[4]) % 2**64}::UHUGEINT END AS h FROM st)"]
    for i in range(4):
        mixed = _add(_mul(_xor("h", _round("0", f"a{i}")), _P[0]), str(_P[3]))
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT g, len, rev, a0, a1, a2, a3, CASE WHEN len >= 32 THEN {mixed} ELSE h END AS h FROM b{i})")
    eight = _add(_mul(_rotl(_xor("acc", _round("0", "v")), 27), _P[0]), str(_P[3]))
    four = _add(_mul(_rotl(_xor("h", _mul(lane.format(at="(len - len % 8)", n=4), _P[0])), 23), _P[1]), str(_P[2]))
    one = _mul(_rotl(_xor("acc", _mul("v", _P[4])), 11), _P[0])
    steps.append(f"t0 AS MATERIALIZED (SELECT g, len, rev, {_add('h', 'len')} AS h FROM b4)")
    steps.append(f"t1 AS MATERIALIZED (SELECT g, len, rev, list_reduce(list_transform(range((len % 32) // 8), lambda k: {lane.format(at='(len - len % 32 + 8 * k)', n=8)}), lambda acc, v: {eight}, h) AS h FROM t0)")
    steps.append(f"t2 AS MATERIALIZED (SELECT g, len, rev, CASE WHEN len % 8 >= 4 THEN {four} ELSE h END AS h FROM t1)")
    steps.append(f"t3 AS MATERIALIZED (SELECT g, list_reduce(list_transform(range(len % 4), lambda k: {lane.format(at='(len - len % 4 + k)', n=1)}), lambda acc, v: {one}, h) AS h FROM t2)")
    steps.append(f"t4 AS MATERIALIZED (SELECT g, {_mul(_shift('h', 33), _P[1])} AS h FROM t3)")
    steps.append(f"t5 AS MATERIALIZED (SELECT g, {_mul(_shift('h', 29), _P[2])} AS h FROM t4)")
    steps.append(f"hashed AS MATERIALIZED (SELECT g, ({_shift('h', 32)})::UBIGINT AS h FROM t5)")
    # Bytes in reverse order as hex digits, so that a lane of little-endian bytes reads as one number.
    hexed = "array_to_string(list_reverse(list_transform(range(octet_length(encode(g))), lambda i: substr(hex(encode(g)), 2 * i + 1, 2))), '')"
    return (
        f"st0 AS MATERIALIZED (SELECT g, octet_length(encode(g)) AS len, {hexed} AS rev FROM (SELECT DISTINCT g FROM {source})),\n"
        f"st AS MATERIALIZED (SELECT g, len, rev, {stripes} FROM st0),\n" + ",\n".join(steps)
    )


_BITS = [f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN 1::UBIGINT << {b} ELSE 0::UBIGINT END" for b in range(64)]

CHECKS = {
    "op11_spelling_variants": f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all({_lowered("coalesce(text, '')")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
c AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run),
h AS MATERIALIZED (SELECT doc_id, run, n, CASE WHEN doc_id IS NOT NULL THEN {crc32("doc_id::VARCHAR || ':' || run")} ELSE 1 END AS h FROM c),
v AS MATERIALIZED (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM h GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (
    SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
    UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = cut.short
    UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = cut.short),
best AS MATERIALIZED (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near),
f AS MATERIALIZED (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
    FROM v LEFT JOIN best ON best.word = v.word AND place = 1),
chain(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.tip WHERE f.form IS NOT NULL),
root AS (SELECT chain.word, chain.tip AS root FROM chain JOIN f ON f.word = chain.tip WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN root ON root.word = f.word
""",
    "op12_periodic_runs": f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS ws, {crc32("doc_id::VARCHAR")} AS h FROM documents),
plan AS MATERIALIZED (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w),
x AS MATERIALIZED (
    SELECT doc_id, n, unnest(range(n)) AS i,
           unnest(list_transform(range(n), lambda i: ws[CAST(1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END AS INT)])) AS word FROM plan),
same AS MATERIALIZED (
    SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same),
stretch AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM isle GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
    SELECT x.doc_id, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (gone.i IS NULL), '') AS text FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM run) WHERE place = 1)
SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * top.length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN per ON per.doc_id = w.doc_id LEFT JOIN top ON top.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
    "op13_simhash_near_dedup": f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_lowered("text"))} AS ws FROM documents),
s AS MATERIALIZED (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
{xxh64_steps("s", 42)},
bits AS (SELECT doc_id, {" | ".join(_BITS)} AS fp FROM s JOIN hashed USING (g) GROUP BY doc_id),
f AS MATERIALIZED (SELECT w.doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM w LEFT JOIN bits ON bits.doc_id = w.doc_id),
d AS MATERIALIZED (SELECT fp, min(doc_id) AS rep FROM f GROUP BY fp),
e AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM d a JOIN d b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
reach(root, node) AS (SELECT rep, rep FROM d UNION SELECT reach.root, e.b FROM reach JOIN e ON e.a = reach.node),
low AS (SELECT root, min(node) AS component_id FROM reach GROUP BY root)
SELECT f.doc_id, lower(lpad(hex(f.fp), 16, '0')) AS fingerprint, component_id FROM f JOIN d ON d.fp = f.fp JOIN low ON low.root = d.rep
""",
}
