"""Quality rules by repetition coverage.

The words of a text become integer ids; numpy computes rolling hashes of all windows of several lengths from them. A window found
twice or more marks its words, the first occurrence included. The share of a text's characters that marked words and repeated
lines hold decides, window length by window length.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; a text shorter than a window has no such
windows; rows are judged alone, so repeated rows get the same verdict; an empty table gives an empty result; extra columns of any
name pass through ``keep`` untouched, and through ``judged`` too but for one that has the result's name, which gets another (``aside``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, aside

SYMBOLS = "#*$%&|<>"
#: A text fails if words inside repeated windows of so many words hold more than this share of its word characters. Widely used
#: published limits: the longer the window, the less of it is normal.
WINDOW_LIMITS = {3: 0.5, 5: 0.45, 7: 0.4, 10: 0.35}
#: Share of lines that repeat an earlier line, and of characters in them.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.4, 0.45
#: Symbols for each word.
SYMBOL_LIMIT = 0.3
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 50, 3, 50

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)

_LONG, _DOUBLE, _BOOLEAN = T.LongType(), T.DoubleType(), T.BooleanType()
FIELDS = {
    "n_words": _LONG,
    "word_chars": _LONG,
    "n_symbols": _LONG,
    "n_dup_lines": _LONG,
    "n_repeat_words": _LONG,
    "base_failed": _BOOLEAN,
    "dup_line_share": _DOUBLE,
    "dup_line_chars_share": _DOUBLE,
    "symbol_share": _DOUBLE,
    **{f"window_{n}_share": _DOUBLE for n in WINDOW_LIMITS},
    "reason": T.StringType(),
    "kept": _BOOLEAN,
}


def repeated_windows(ids: np.ndarray, n: int, kinds: int, rolled: np.ndarray | None = None) -> np.ndarray:
    """True for each word that lies in a window of n words found twice or more. rolled: the windows' rolling hashes, if known;
    without them, windows are compared exactly where ids fit and by hash otherwise."""
    marked = np.zeros(len(ids), bool)
    if len(ids) <= n:
        return marked
    if rolled is None:
        bits = max(1, int(kinds).bit_length())
        if bits * n <= 63:
            rolled = np.zeros(len(ids) - n + 1, np.int64)
            for k in range(n):
                rolled = (rolled << bits) | ids[k : len(ids) - n + 1 + k]
        else:
            rows = np.stack([ids[k : len(ids) - n + 1 + k] for k in range(n)], axis=1)
            rolled = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return marked
    twice = np.zeros(len(ranked), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(ids) + 1, np.int32)
    starts = order[twice]
    edge[starts] += 1
    np.subtract.at(edge, starts + n, 1)
    return np.cumsum(edge[:-1]) > 0


def rolling(ids: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Polynomial hashes modulo 2^64 of all windows of each length; each length extends the one before."""
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    spread ^= spread >> np.uint64(29)
    out, now, size = {}, np.zeros(len(ids), np.uint64), 0
    for n in lengths:
        while size < n and len(now):
            now = (now if size == 0 else now[:-1]) * _STEP + spread[size:]
            size += 1
        out[n] = now if size == n else np.zeros(0, np.uint64)
    return out


def measure(text: str | None) -> tuple:
    """The values of FIELDS for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    first = set(lines)
    n_dup = len(lines) - len(first)
    symbols = sum(map(text.count, SYMBOLS))
    if not n:
        return (0, 0, symbols, n_dup, 0, True, 0.0, 0.0, 0.0, *[0.0] * len(WINDOW_LIMITS), "few words", False)
    at = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[at]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    sizes = np.add.reduceat((inside & ((at & 0xC0) != 0x80)).astype(np.int64), starts)
    chars = int(sizes.sum())
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        base, shares = 0, dict.fromkeys(WINDOW_LIMITS, 0.0)
    else:
        exact = repeated_windows(ids, BASE_WINDOW, len(known))
        base, shares, hashes = int(exact.sum()), {}, rolling(ids, sorted(WINDOW_LIMITS)) if exact.any() else {}
        for length in WINDOW_LIMITS:
            marked = repeated_windows(ids, length, len(known), hashes[length]) if hashes else exact
            shares[length] = float(sizes[marked].sum()) / chars
    line_share = n_dup / len(lines)
    dup_chars = (sum(map(len, lines)) - sum(map(len, first))) / sum(map(len, lines)) if n_dup else 0.0
    base_failed = n < MIN_WORDS or 100 * base > BASE_PERCENT * n
    reason = None
    if n < MIN_WORDS:
        reason = "few words"
    elif base_failed:
        reason = "repeated words"
    elif any(shares[k] > limit for k, limit in WINDOW_LIMITS.items()):
        reason = "repeated windows"
    elif line_share > LINE_LIMIT or dup_chars > LINE_CHARS_LIMIT:
        reason = "repeated lines"
    elif symbols / n > SYMBOL_LIMIT:
        reason = "symbols"
    return (n, chars, symbols, n_dup, base, base_failed, line_share, dup_chars, symbols / n, *shares.values(), reason, reason is None)


@F.arrow_udf(T.StructType([T.StructField(k, v) for k, v in FIELDS.items()]))
def quality(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kinds = {_LONG: pa.int64(), _DOUBLE: pa.float64(), _BOOLEAN: pa.bool_()}
    for batch in texts:
        rows = [measure(x.as_py()) for x in batch]
        yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kinds.get(t, pa.string())) for k, t in enumerate(FIELDS.values())], list(FIELDS))


def judged(df: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """df with a struct column of all measures."""
    df, [text] = aside(df, [into], [text])
    return df.withColumn(into, quality(F.col(text)))


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes; all columns as they were. Only the text goes to Python."""
    passes: Column = quality(F.col(text))["kept"]
    return df.filter(passes)


_WINDOWS = ", ".join(
    f"string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS w{n}" for n in WINDOW_LIMITS
)
#: A window of n words is marked if it is whole and occurs twice; a word is marked if one of the n windows that hold it is.
_TWICE = ", ".join(
    f"pos <= n_words - {n - 1} AND count(*) FILTER (WHERE pos <= n_words - {n - 1}) OVER (PARTITION BY doc_id, w{n}) > 1 AS t{n}" for n in WINDOW_LIMITS
)
_MARKED = ", ".join(
    f"coalesce(bool_or(t{n}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS m{n}" for n in WINDOW_LIMITS
)
_SHARES = ", ".join(f"coalesce(CAST(sum(length(word)) FILTER (WHERE m{n}) AS DOUBLE), 0) / sum(length(word)) AS s{n}" for n in WINDOW_LIMITS)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
p AS (SELECT doc_id, len(ws) AS n_words, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
a AS (SELECT *, {_WINDOWS} FROM p), b AS (SELECT *, {_TWICE} FROM a), c AS (SELECT *, {_MARKED} FROM b),
r AS (SELECT doc_id, count(*) FILTER (WHERE m{BASE_WINDOW}) AS n_repeat_words, {_SHARES} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, line, count(*) AS n, octet_length(encode(line)) AS size
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line),
g AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum(n - 1) AS DOUBLE) / sum(n) AS lines, CAST(sum((n - 1) * size) AS DOUBLE) / sum(n * size) AS chars
      FROM l GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {BASE_PERCENT} * n_words AS base_failed,
       n_words >= {MIN_WORDS} AND 100 * coalesce(n_repeat_words, 0) <= {BASE_PERCENT} * n_words
       AND {" AND ".join(f"s{n} <= CAST({limit} AS DOUBLE)" for n, limit in WINDOW_LIMITS.items())}
       AND lines <= CAST({LINE_LIMIT} AS DOUBLE) AND chars <= CAST({LINE_CHARS_LIMIT} AS DOUBLE) AND CAST(n_symbols AS DOUBLE) / n_words <= CAST({SYMBOL_LIMIT} AS DOUBLE) AS kept
FROM m LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id)
"""
