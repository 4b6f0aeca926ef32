"""SQL for the fingerprints and their components: XXH64 spelled out in DuckDB's 128-bit integers, step by step."""

from __future__ import annotations

#: Fixed values of XXH64: its five primes.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
P1, P2, P3, P4, P5 = PRIMES
WORD = 1 << 64


def number(x: int) -> str:
    return f"{x % WORD}::UHUGEINT"


def added(*parts: str) -> str:
    return f"(({' + '.join(parts)}) % {WORD}::UHUGEINT)"


def times(a: str, prime: int) -> str:
    return f"(({a}) * {number(prime)} % {WORD}::UHUGEINT)"


def turned(x: str, by: int) -> str:
    """Rotated to the left. x is written twice, so it should be a name."""
    return f"((({x}) << {by}) % {WORD}::UHUGEINT | (({x}) >> {64 - by}))"


def lane(hex_text: str, at: str, size: int) -> str:
    """The little-endian integer of so many bytes at a place."""
    return rf"CAST('0x' || regexp_replace(reverse(substr({hex_text}, 2 * ({at}) + 1, {2 * size})), '(.)(.)', '\2\1', 'g') AS UBIGINT)::UHUGEINT"


def let(name: str, value: str, then: str) -> str:
    """then, with a name for a value that it uses more than once."""
    return f"list_transform([{value}], lambda {name}: {then})[1]"


def mixed(acc: str, step: str, by: int, prime: int, more: int) -> str:
    """One step of the end: the accumulator with a step's value, turned, multiplied and moved on."""
    return let("x", f"xor({acc}, {step})", added(times(turned("x", by), prime), number(more)))


def round_of(start: str, value: str) -> str:
    return let("y", added(start, times(value, P2)), times(turned("y", 31), P1))


def merged(acc: str, value: str) -> str:
    return added(times(f"xor({acc}, {round_of('0::UHUGEINT', value)})", P1), number(P4))


def xxh64_steps(seed: int) -> list[tuple[str, str]]:
    """(table, SELECT) of each step, from a table s (shingle) to a table hashed (shingle, h)."""
    stripes = lambda k: f"list_transform(range(0, n // 32), lambda i: {lane('hx', f'32 * i + {8 * k}', 8)})"
    starts = (seed + P1 + P2, seed + P2, seed, seed - P1)
    run = lambda k: f"list_reduce(list_prepend({number(starts[k])}, {stripes(k)}), lambda a, b: {round_of('a', 'b')})"
    four = added(*(turned(f"v{k}", r) for k, r in zip(range(4), (1, 7, 12, 18), strict=True)))
    words = f"list_transform(range(0, (n % 32) // 8), lambda i: {lane('hx', '32 * (n // 32) + 8 * i', 8)})"
    halves = f"list_transform(range(0, (n % 8) // 4), lambda i: {lane('hx', '8 * (n // 8)', 4)})"
    single = f"list_transform(range(0, n % 4), lambda i: {lane('hx', '4 * (n // 4) + i', 1)})"
    reduced = lambda acc, values, step: f"list_reduce(list_prepend({acc}, {values}), lambda a, b: {step})"
    return [
        ("b", "SELECT shingle, hex(encode(shingle)) AS hx, octet_length(encode(shingle)) AS n FROM (SELECT DISTINCT shingle FROM s)"),
        ("long", "SELECT *, " + ", ".join(f"{run(k)} AS v{k}" for k in range(4)) + " FROM b WHERE n >= 32"),
        ("whole", f"SELECT shingle, hx, n, {merged(merged(merged(merged(four, 'v0'), 'v1'), 'v2'), 'v3')} AS acc FROM long"),
        (
            "begun",
            f"SELECT shingle, hx, n, {
                added('acc', 'n::UHUGEINT')
            } AS acc FROM (SELECT * FROM whole UNION ALL SELECT shingle, hx, n, {number(seed + P5)} FROM b WHERE n < 32)",
        ),
        ("eights", f"SELECT shingle, hx, n, {reduced('acc', words, mixed('a', round_of('0::UHUGEINT', 'b'), 27, P1, P4))} AS acc FROM begun"),
        ("fours", f"SELECT shingle, hx, n, {reduced('acc', halves, mixed('a', times('b', P1), 23, P2, P3))} AS acc FROM eights"),
        ("ones", f"SELECT shingle, {reduced('acc', single, mixed('a', times('b', P5), 11, P1, 0))} AS acc FROM fours"),
        ("first", f"SELECT shingle, {times('xor(acc, acc >> 33)', P2)} AS acc FROM ones"),
        ("second", f"SELECT shingle, {times('xor(acc, acc >> 29)', P3)} AS acc FROM first"),
        ("hashed", "SELECT shingle, CAST(xor(acc, acc >> 32) AS UBIGINT) AS h FROM second"),
    ]


def oracle(seed: int, shingle: int, max_bits: int, word: str) -> str:
    joined = " || ' ' || ".join(f"ws[i + {k}]" for k in range(1, shingle + 1))
    ones = " | ".join(f"(CASE WHEN 2 * sum(CAST((h >> {b}) & 1 AS BIGINT)) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64))
    steps = ",\n".join(f"{name} AS ({select})" for name, select in xxh64_steps(seed))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= {shingle} THEN list_transform(range(0, len(ws) - {shingle - 1}), lambda i: {joined}) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
{steps},
p AS (SELECT doc_id, {ones} AS code FROM s JOIN hashed USING (shingle) GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(code, 0::UBIGINT) AS code FROM w LEFT JOIN p USING (doc_id)),
k AS (SELECT DISTINCT code FROM f), e AS (SELECT x.code AS a, y.code AS b FROM k x JOIN k y ON bit_count(xor(x.code, y.code)) <= {max_bits}),
r(a, b) AS (SELECT code, code FROM k UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT r.a AS code, min(f.doc_id) AS component_id FROM r JOIN f ON f.code = r.b GROUP BY r.a)
SELECT doc_id, lower(lpad(hex(code), 16, '0')) AS fingerprint, component_id FROM f JOIN g USING (code)
"""
