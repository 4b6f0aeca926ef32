"""SQL for the SpotSigs query: signatures by joins of positions, their hashes spelled out."""

from __future__ import annotations

from .simhash_sql import xxh64_steps

#: The seed of Spark's xxhash64.
SEED = 42


_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"


def signatures(anchors: tuple[str, ...], chain: int, stretch: int) -> str:
    """Tables from w (doc_id, edited, ws) on: z (doc_id, edited, sig) has the sorted hashes of every text that has words."""
    steps = ",\n".join(f"{name} AS ({select})" for name, select in xxh64_steps(SEED))
    same = "c{0}.doc_id = a.doc_id AND c{0}.edited = a.edited AND c{0}.rank = a.rank + {0}"
    content = " ".join(f"JOIN content c{k} ON {same.format(k)}" for k in range(1, chain + 1))
    inside = " ".join(f"JOIN runs c{k} ON {same.format(k)} AND c{k}.run = a.run" for k in range(1, chain + 1))
    follow = " || ".join(f"' ' || c{k}.word" for k in range(1, chain + 1))
    signed = "CASE WHEN h >= 9223372036854775808 THEN CAST(h::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(h AS BIGINT) END"
    return f"""
p AS (SELECT doc_id, edited, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
q AS (SELECT *, word IN ({", ".join(f"'{x}'" for x in sorted(set(anchors)))}) AS common FROM p),
ranked AS (SELECT *, count(*) FILTER (WHERE NOT common) OVER (PARTITION BY doc_id, edited ORDER BY pos) AS rank FROM q),
content AS (SELECT doc_id, edited, word, rank, pos - rank AS run FROM ranked WHERE NOT common),
runs AS (SELECT * FROM content QUALIFY count(*) OVER (PARTITION BY doc_id, edited, run) >= {stretch}),
found AS (SELECT a.doc_id, a.edited, '#' || a.word || {follow} AS shingle FROM ranked a {content} WHERE a.common
  UNION SELECT a.doc_id, a.edited, a.word || {follow} FROM runs a {inside}),
alone AS (SELECT doc_id, edited, array_to_string(ws, ' ') AS shingle FROM w ANTI JOIN found USING (doc_id, edited) WHERE len(ws) > 0),
s AS (SELECT * FROM found UNION ALL SELECT * FROM alone),
{steps},
z AS (SELECT doc_id, edited, list_sort(list(DISTINCT {signed})) AS sig FROM s JOIN hashed USING (shingle) GROUP BY ALL)"""


def oracle(anchors: tuple[str, ...], chain: int, stretch: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM documents),
n AS (SELECT d.doc_id, d.t, d.next_id, d.t[1 : length(d.t) - length(d.t) // 2] || x.t[1 : length(d.t) // 2] AS u FROM d JOIN d x ON x.doc_id = d.next_id),
w AS (SELECT doc_id, false AS edited, {_WORDS.format("t")} AS ws FROM n UNION ALL SELECT doc_id, true, {_WORDS.format("u")} FROM n),
{signatures(anchors, chain, stretch)},
o AS (SELECT n.*, coalesce(a.sig, []) AS own, coalesce(b.sig, []) AS other, coalesce(c.sig, []) AS following FROM n
  LEFT JOIN z a ON a.doc_id = n.doc_id AND NOT a.edited LEFT JOIN z b ON b.doc_id = n.doc_id AND b.edited LEFT JOIN z c ON c.doc_id = n.next_id AND NOT c.edited)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(u) AS edited_sha256, {digest("own")} AS fingerprint, {digest("other")} AS edited_fingerprint,
       {likeness("own", "other")} AS near_edited, {likeness("own", "following")} AS near_next FROM o
"""


def links_oracle(anchors: tuple[str, ...], chain: int, stretch: int, threshold: float) -> str:
    return f"""
WITH w AS (SELECT doc_id, false AS edited, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
{signatures(anchors, chain, stretch)},
m AS (SELECT w.doc_id, coalesce(sig, []) AS sig FROM w LEFT JOIN z USING (doc_id)),
k AS (SELECT sig, min(doc_id) AS class_id FROM m GROUP BY sig), e AS (SELECT class_id, len(sig) AS n, unnest(sig) AS h FROM k),
c AS (SELECT a.class_id AS one, b.class_id AS two, a.n + b.n AS n, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.class_id <> b.class_id GROUP BY ALL),
l AS (SELECT one AS class_id, count(*) AS n_links FROM c WHERE CAST(shared AS DOUBLE) / (n - shared) >= CAST({threshold} AS DOUBLE) GROUP BY one)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM m JOIN k USING (sig) LEFT JOIN l USING (class_id)
"""


def digest(sig: str) -> str:
    return f"len({sig}) || '-' || md5(coalesce(array_to_string({sig}, ','), ''))"


def likeness(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE CAST({shared} AS DOUBLE) / greatest(len({a}) + len({b}) - {shared}, 1) END"
