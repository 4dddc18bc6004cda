"""The SQL of op6, op9 and op10, for DuckDB: the contracts' results by other ways than the operators'."""

from __future__ import annotations

# The five primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED, WORD = 42, 1 << 64


def _big(n: int) -> str:
    return f"'{n}'::UHUGEINT"


def _cut(x: str) -> str:
    return f"(({x}) % {_big(WORD)})"


def _turned(x: str, bits: int) -> str:
    return f"((({x}) * {_big(1 << bits)}) % {_big(WORD)} + ({x}) // {_big(1 << (64 - bits))})"


def _times(x: str, prime: int) -> str:
    return _cut(f"({x}) * {_big(PRIMES[prime])}")


def _plus(x: str, prime: int) -> str:
    return _cut(f"{x} + {_big(PRIMES[prime])}")


def _number(at: str, width: int) -> str:
    """The little-endian number of so many bytes at a place; back is the hex of the bytes in reverse."""
    return f"('0x' || substr(back, (2 * (n - ({at}) - {width}) + 1)::BIGINT, {2 * width}))::UBIGINT::UHUGEINT"


def _fold(first: str, count: str, at: str, width: int, step: str) -> str:
    """The value v after step, from first, for each of count numbers c of so many bytes, the k-th at a place."""
    return f"list_reduce(list_prepend({first}, list_transform(range({count}), lambda k: {_number(at, width)})), lambda v, c: {step})"


def _simhash_sql() -> str:
    """Words and shingles, XXH64 of each distinct shingle in steps of 32, 8, 4 and 1 bytes, majority bits, all links, all that is reached."""
    p = PRIMES
    lanes = [(SEED + p[0] + p[1]) % WORD, (SEED + p[1]) % WORD, SEED, (SEED - p[0]) % WORD]
    lane = ", ".join(f"{_fold(_big(x), 'n // 32', f'32 * k + {8 * j}', 8, _times(_turned(_cut(f'v + c * {_big(p[1])}'), 31), 0))} AS v{j}" for j, x in enumerate(lanes))
    start = _cut(" + ".join(_turned(f"v{j}", bits) for j, bits in enumerate((1, 7, 12, 18))))
    mixed = [_plus(_times(f"xor(a, {_times(_turned(_times(f'v{j}', 1), 31), 0)})", 0), 3) for j in range(4)]
    eight = _plus(_times(_turned(f"xor(v, {_times(_turned(_times('c', 1), 31), 0)})", 27), 0), 3)
    four = _plus(_times(_turned(f"xor(a, {_times(_number('pos', 4), 0)})", 23), 1), 2)
    one = _times(_turned(f"xor(v, {_times('c', 4)})", 11), 0)
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
    return rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT r, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM words WHERE len(w) > 0)
), bytes AS (
  SELECT s, octet_length(encode(s))::BIGINT AS n, array_to_string(list_reverse(regexp_extract_all(hex(encode(s)), '..')), '') AS back FROM (SELECT DISTINCT s FROM shingles)
), lanes AS MATERIALIZED (SELECT *, {lane} FROM bytes
), started AS (SELECT *, {start} AS a FROM lanes
), mixed0 AS MATERIALIZED (SELECT * REPLACE ({mixed[0]} AS a) FROM started
), mixed1 AS MATERIALIZED (SELECT * REPLACE ({mixed[1]} AS a) FROM mixed0
), mixed2 AS MATERIALIZED (SELECT * REPLACE ({mixed[2]} AS a) FROM mixed1
), mixed3 AS MATERIALIZED (SELECT * REPLACE ({mixed[3]} AS a) FROM mixed2
), begun AS (
  SELECT s, n, back, n // 32 * 32 AS pos, {_cut(f"CASE WHEN n >= 32 THEN a ELSE {_big((SEED + p[4]) % WORD)} END + n::UHUGEINT")} AS a FROM mixed3
), eights AS MATERIALIZED (
  SELECT s, n, back, pos + (n - pos) // 8 * 8 AS pos, {_fold("a", "(n - pos) // 8", "pos + 8 * k", 8, eight)} AS a FROM begun
), fours AS MATERIALIZED (
  SELECT s, n, back, CASE WHEN n - pos >= 4 THEN pos + 4 ELSE pos END AS pos, CASE WHEN n - pos >= 4 THEN {four} ELSE a END AS a FROM eights
), ones AS MATERIALIZED (SELECT s, {_fold("a", "n - pos", "pos + k", 1, one)} AS a FROM fours
), once AS MATERIALIZED (SELECT s, {_times(f"xor(a, a // {_big(1 << 33)})", 1)} AS a FROM ones
), twice AS MATERIALIZED (SELECT s, {_times(f"xor(a, a // {_big(1 << 29)})", 2)} AS a FROM once
), hashes AS MATERIALIZED (SELECT s, xor(a, a // {_big(1 << 32)})::UBIGINT AS h FROM twice
), counted AS (SELECT r, {bits} AS p FROM shingles JOIN hashes USING (s) GROUP BY r
), prints AS MATERIALIZED (SELECT words.r, doc_id, coalesce(p, 0::UBIGINT) AS p FROM words LEFT JOIN counted ON words.r = counted.r
), nodes AS MATERIALIZED (SELECT p, min(doc_id) AS least FROM prints GROUP BY p
), links AS MATERIALIZED (SELECT a.p AS a, b.p AS b FROM nodes a, nodes b WHERE a.p <> b.p AND bit_count(xor(a.p, b.p)) <= 4
), reached AS (SELECT p, p AS q FROM nodes UNION SELECT reached.p, links.b FROM reached JOIN links ON reached.q = links.a
), components AS (SELECT reached.p, min(least) AS component_id FROM reached JOIN nodes ON reached.q = nodes.p GROUP BY reached.p
)
SELECT doc_id, lpad(lower(to_hex(p)), 16, '0') AS fingerprint, component_id FROM prints JOIN components USING (p)
"""


SIMHASH_SQL = _simhash_sql()

#: The patterns in SQL's dialect, and what a match needs.
KINDS = (
    (1, "assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(s, '{}', 2)) >= 8"),
    (2, "access", "AKIA[A-Z0-9]+", "length(s) >= 16"),
    (3, "hex", "[0-9a-f]+", "length(s) >= 32"),
    (5, "jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "true"),
    (6, "prefixed", "(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,})", "true"),
)


def _matches(place: int, kind: str, pattern: str, needs: str) -> str:
    """Spans of one kind: a match starts after the pieces between matches, and the matches, before it."""
    return f"""SELECT r, {place} AS place, '{kind}' AS kind, a, a + length(s) AS z FROM (
    SELECT r, m[k] AS s, (list_sum(list_transform(p[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0))::BIGINT AS a
    FROM (SELECT r, m, p, unnest(range(1, len(m) + 1)) AS k FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d))
  ) WHERE {needs.format(pattern)}"""


SECRETS_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), b AS (
  SELECT r, unnest(string_split(t, '-----BEGIN ')) AS s, generate_subscripts(string_split(t, '-----BEGIN '), 1) AS k FROM d
), pem AS (
  SELECT r, sum(length(s) + 11) OVER (PARTITION BY r ORDER BY k) - length(s) - 11 AS a, k, s, regexp_extract(s, '^([A-Z ]{{0,40}}PRIVATE KEY)-----', 1) AS label FROM b
), spans AS (
  {" UNION ALL ".join(_matches(*k) for k in KINDS)}
  UNION ALL
  SELECT r, 4, 'pem', a - 11, a + greatest(
      length(regexp_extract(s, '^[A-Z ]{{0,40}}PRIVATE KEY-----[A-Za-z0-9+/=\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]*(?:-----END [A-Z ]{{0,40}}PRIVATE KEY-----)?')),
      CASE WHEN contains(substr(s, length(label) + 6), '-----END ' || label || '-----')
        THEN length(label) + 5 + strpos(substr(s, length(label) + 6), '-----END ' || label || '-----') - 1 + length(label) + 14 ELSE 0 END)
  FROM pem WHERE k > 1 AND label <> ''
), f AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat_ws(':', kind, a::BIGINT, z::BIGINT), ',' ORDER BY a, place) FILTER (place <= 3) AS base, string_agg(concat_ws(':', kind, a::BIGINT, z::BIGINT), ',' ORDER BY a, place) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f ON d.r = f.r
"""

REMOVAL_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), s AS (
  SELECT r, i, md5(b[i + 1 : i + 400]) AS g FROM (SELECT r, b, unnest(range(n - 399)) AS i FROM d WHERE n >= 400)
), f AS (
  SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1
), e AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM f
), k AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM e
), gone AS (
  SELECT r, run, min(i) AS a, max(i) + 400 AS z FROM k GROUP BY r, run
), kept AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM gone
  UNION ALL SELECT d.r, max(z), any_value(n) FROM d JOIN gone ON d.r = gone.r GROUP BY d.r
), left_over AS (
  SELECT d.r, string_agg(substr(hex(b), 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM d JOIN kept ON d.r = kept.r GROUP BY d.r
), sums AS (
  SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM gone GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, hex(b)))) AS kept_sha256
FROM d LEFT JOIN left_over ON d.r = left_over.r LEFT JOIN sums ON d.r = sums.r
"""
