"""Near duplicates by SimHash and a Gray-order hierarchical index.

A fingerprint has 64 bits; two documents link if theirs differ in ``max_bits`` or fewer, and documents that links connect form a
component. Equal fingerprints are one node, so a group of copies costs one row. The index (``grayindex``) finds every such link: its upper
nodes are masked bit patterns. The bits are cut into max_bits + r pieces, and a mask is any r of them; two fingerprints that differ in
max_bits or fewer have r pieces in common at least, so they agree under one of the masks. r grows with the number of fingerprints, from 4
masks of 16 bits to 10 of 25, 20 of 32 and on, so that nodes of unrelated fingerprints stay small; every r finds every link. Below a
node, members lie in Gray order, and groups are pruned by the differences of the bits that they share. Tasks emit a spanning forest of
the links that they find rather than all pairs of a group.

For texts that are alike but not so close, ``deduplicated`` takes ``similar``: texts whose five-word shingles are alike to that link too;
they meet in the same index under masks of a longer signature (``similar``).

Defined cases: a text without words has the fingerprint zero, which links like any other; null doc_ids get the component of their
fingerprint and are never the smallest; repeated rows are equal fingerprints; an empty table gives an empty result; extra columns of any
name pass through ``deduplicated`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similar as alike
from .common import free_names, hash128, met_by_key, text_of, written
from .components import connected
from .grayindex import dealt, pairs, signed_rank

BITS, MAX_BITS, SHINGLE, SEED = 64, 3, 3, 42
SIMILAR = alike.LEAST
#: A node holds about so many unrelated fingerprints at most, as a power of two.
NODE_BITS = 6

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the 64-bit hashes of the text's word shingles, repeats included. As a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    joined = map(b" ".join, zip(*(words[k : k + n] for k in range(shingle)), strict=True)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((digest(x, SEED) for x in joined), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([fingerprint(x.as_py()) for x in batch], pa.int64())


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def masks(max_bits: int, count: int = 1) -> list[int]:
    """Masks of so many bits each that ``count`` random codes leave nodes of 2 ** NODE_BITS at most: two codes that differ in max_bits or fewer
    agree under one of them."""
    r = 1
    while BITS * r // (max_bits + r) + NODE_BITS < count.bit_length() and r < 8:
        r += 1
    edges = [round(k * BITS / (max_bits + r)) for k in range(max_bits + r + 1)]
    pieces = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(pieces, r)]


def nodes(codes: DataFrame, keep: list[int]) -> DataFrame:
    """A row (key, gray) for each code under each mask; the key names mask and pattern."""

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rank = signed_rank(x)
            for k, m in enumerate(keep):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), k, np.int32)), pa.array((x & np.uint64(m)).view(np.int64)), pa.array(rank)], ["mask", "pattern", "gray"]
                )

    rows = codes.select("code").mapInArrow(upper, "mask int, pattern long, gray long")
    return dealt(rows.select(F.xxhash64("mask", "pattern").alias("key"), "gray"))


def links(codes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links between the distinct fingerprints in column ``code``: rows (a, b) that connect what all links connect."""
    hit = lambda x, y: np.bitwise_count(x["code"] ^ y["code"]) <= max_bits
    return pairs(nodes(codes, masks(max_bits, codes.count())), {}, max_bits, hit, "code")


def _rooted(docs: DataFrame, doc_id: str, text: str, max_bits: int, similar: float | None = None, exact: bool = False) -> DataFrame:
    """For each row: doc_id, two hashes of the text, fingerprint, and the code that stands for its component. similar: texts that are
    so alike link too, beyond max_bits."""
    h1, h2 = hash128(text_of(text))
    own = [F.col(doc_id).alias("doc_id"), h1.alias("h1"), h2.alias("h2"), fingerprints(text_of(text)).alias("fingerprint")]
    if similar is not None:
        own.append(alike.sketch(text_of(text)).alias("sketch"))
    prints = written(docs.select(*own), "fingerprints")
    codes = written(prints.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("held")), "codes")
    roots = connected(links(codes, max_bits))
    if similar is not None:
        roots = alike.completed(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text", prints, roots, similar, exact=exact)
    of = codes.join(roots.withColumnRenamed("node", "code"), "code", "left").select("code", "least_id", "held", F.coalesce("least", "code").alias("root"))
    least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_code = of.select(F.col("code").alias("fingerprint"), "held", "root").join(least, "root")
    return met_by_key(prints.drop("sketch"), by_code, ["fingerprint"], "held").drop("held")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (64 bits in a long) and component_id: the smallest doc_id that links reach, its own included."""
    return _rooted(docs, doc_id, text, max_bits).select("doc_id", "fingerprint", "component_id")


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, similar: float | None = None, exact: bool = False
) -> DataFrame:
    """One row of each component, that of the smallest doc_id (nulls last; ties: the smallest text hashes; of rows alike in both,
    any one); all columns as they were. similar: five-word shingles so alike link too; exact: also the few that the index leaves out."""
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h1", "h2"]
    first = _rooted(docs, doc_id, text, max_bits, similar, exact).groupBy("root").agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    no_id, own_id, one, two, row = free_names(docs, "no_id", "id", "h1", "h2", "row")
    h1, h2 = hash128(text_of(text))
    named = docs.withColumns({no_id: F.col(doc_id).isNull(), own_id: F.coalesce(F.col(doc_id), F.lit(0)), one: h1, two: h2})
    names = [no_id, own_id, one, two]
    kept = named.join(first.toDF(*names), names, "left_semi")
    return kept.withColumn(row, F.row_number().over(Window.partitionBy(*names).orderBy(two))).filter(F.col(row) == 1).select(*docs.columns)
