"""Texts whose word shingles are alike, met through the Gray-order index.

A text's signature is a code of 64 bits, the SimHash of its set of shingles, and ``BANDS`` bands, each the hash of ``ROWS`` least values of
the set under so many hash functions. Bands are the index's masked bit patterns: texts alike to s agree under one with the chance s ** ROWS,
so texts alike to 0.8 meet under one of 20 at least but for 0.0004 of them, whatever the number of texts; more bands leave fewer out.
Within a node, members lie in the Gray order of their codes.

Members of a node are compared in two rounds, exactly, by their shingles. The first takes each member with its neighbour in Gray order and
with the node's most central member, the one that meets most others over all its nodes: so many pairs as members, which join large
groups of edited copies. The second brings the shingles of members that are still apart into their nodes, and compares there every pair that
nothing connects by then, so that no more links leave a node than it has members. A pair is left out if its codes differ in more than
``REACH`` bits (0.8 means 10 of 64 in the mean; groups of members are pruned by the bits they share) or four bits of each of the least
values differ for more than ``STRAY`` of them (0.8 means 19 of 100, with a deviation of 4): that leaves out 0.0006 of the pairs
alike to just 0.8, fewer of others.

``exact`` adds what the bands left out, by a prefix filter on the sets of shingles: any two texts so alike share one of the first
shingles of their sets in a fixed order. It costs several times as much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash128, met_by_key, remove, text_of, written, written_at
from .components import connected
from .grayindex import arrays, dealt, pairs, signed_rank

LEAST, WORDS, SEED = 0.8, 5, 42
BANDS, ROWS, REACH, STRAY = 20, 5, 24, 32
#: Members of a block that carries shingles.
SET_BLOCK = 256
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Hash functions of the form a * x + b modulo 2^64, fixed by a seed.
_MULTIPLY, _ADD = np.random.default_rng(2024).integers(0, 1 << 63, (2, 4096), np.uint64)
_MULTIPLY = _MULTIPLY * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's word shingles, each once."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - words + 1)
    joined = map(b" ".join, zip(*(found[k : k + n] for k in range(words)), strict=True)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in joined), np.uint64, n))


def words_of(count: int) -> int:
    """64-bit words that hold four bits of so many values."""
    return -(-count // 16)


def signature(text: str | None, bands: int = BANDS, rows: int = ROWS) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Number of shingles, Gray rank of their SimHash, names of the bands, and four bits of each least value; a text without words has no
    bands."""
    found = shingle_set(text)
    if not len(found):
        return 0, 0, np.zeros(0, np.int64), np.zeros(words_of(bands * rows), np.int64)
    ones, low = np.zeros(64, np.int64), np.full(bands * rows, ~np.uint64(0))
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        low = np.minimum(low, (part[:, None] * _MULTIPLY[: bands * rows] + _ADD[: bands * rows]).min(axis=0))
    code = np.packbits(2 * ones > len(found)).view(">u8").astype(np.uint64)
    # A band's name holds its number.
    names = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(bands, rows))]
    four = np.zeros(16 * words_of(bands * rows), np.uint8)
    four[: len(low)] = low & np.uint64(15)
    return len(found), int(signed_rank(code)[0]), np.array(names, np.uint64).view(np.int64), (four[::2] | four[1::2] << 4).view(np.int64)


def stray(x: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
    """Of how many least values the four bits differ, for members with columns m0, m1 and on."""
    out = 0
    for k in range(words):
        off = x[f"m{k}"] ^ y[f"m{k}"]
        off = off | off >> np.uint64(1)
        out = out + np.bitwise_count((off | off >> np.uint64(2)) & np.uint64(0x1111111111111111))
    return out


def signatures(bands: int = BANDS, rows: int = ROWS):  # noqa: ANN201
    kind = T.StructType(
        [T.StructField("n", T.IntegerType()), T.StructField("gray", T.LongType()), *(T.StructField(x, T.ArrayType(T.LongType())) for x in ("bands", "least"))]
    )

    @F.arrow_udf(kind)
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            n, gray, names, four = zip(*(signature(x.as_py(), bands, rows) for x in batch), strict=True) if len(batch) else ((),) * 4
            whole = pa.list_(pa.int64())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int32()), pa.array(gray, pa.int64()), pa.array(names, whole), pa.array(four, whole)], ["n", "gray", "bands", "least"]
            )

    return made


def fits(n_a, n_b, least: float):  # noqa: ANN001, ANN201
    """Sets of these sizes can be so alike."""
    return np.minimum(n_a, n_b) >= least * np.maximum(n_a, n_b) - 1e-9


def neighbours(members: DataFrame, least: float) -> DataFrame:
    """Members of nodes of two or more, with the number of the one before in Gray order where it may be alike and isn't connected
    (near), from rows that ``dealt`` gives. Edges of tasks come as rows of their own."""
    kind, read = arrays({"no": "i8", "n": "i4", "root": "i8"})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(rows: np.ndarray, near: list, edge: bool) -> pa.RecordBatch:
            columns = [
                pa.array(rows["key"]),
                pa.array(signed_rank(rows["code"])),
                *(pa.array(rows[x]) for x in ("no", "n", "root")),
                pa.array(near, pa.int64()),
                pa.array(np.full(len(rows), edge)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["key", "gray", "no", "n", "root", "near", "edge"])

        last, shown, first = np.zeros(0, kind), True, None
        for batch in batches:
            rows = np.concatenate((last, read(batch)))
            if not len(rows):
                continue
            if first is None:
                first = rows[:1]
                yield rows_of(first, [None], True)
            same = rows["key"][1:] == rows["key"][:-1]
            several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            after = np.concatenate(([False], same & (rows["root"][1:] != rows["root"][:-1]) & fits(rows["n"][1:], rows["n"][:-1], least)))
            # The last row of the batch before has been given if it wasn't alone by then.
            several[: len(last)] &= not shown
            near = [int(x) if y else None for x, y in zip(np.concatenate(([0], rows["no"][:-1])), after, strict=True)]
            yield rows_of(rows[several], [x for x, y in zip(near, several, strict=True) if y], False)
            shown = bool(several[-1]) or (len(rows) == len(last) and shown)
            last = rows[-1:]
        if len(last):
            yield rows_of(last, [None], True)

    return members.mapInArrow(work, "key long, gray long, no long, n int, root long, near long, edge boolean")


def ordered(found: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), the lesser number first."""
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike(found: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) those whose texts (no, text) share so much of their shingles, by Jaccard similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, other = None, None
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                # Pairs come in the order of b, so one text's set serves many pairs.
                if b != now:
                    now, other = b, shingle_set(y.as_py())
                mine = shingle_set(x.as_py())
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(shared >= least * (len(mine) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = {x: texts.select(F.col("no").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"}
    both = found.join(sides["a"], "a").join(sides["b"].hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compare, "a long, b long")


def texts_of(docs: DataFrame, text: str, named: DataFrame) -> DataFrame:
    """(no, text) for named: (no, no_id, id, h1, h2). Each text is taken from the one row that names it, so that of a group of copies only
    that one meets another table."""
    h1, h2 = hash128(text_of(text))
    own = docs.select(
        F.col("_id").isNull().alias("no_id"), F.coalesce("_id", F.lit(0)).alias("id"), h1.alias("h1"), h2.alias("h2"), text_of(text).alias("text")
    )
    return own.join(named.select("no", "no_id", "id", "h1", "h2"), ["no_id", "id", "h1", "h2"]).select("no", "text").dropDuplicates(["no"])


def joined(links: DataFrame, named: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (node, least) with links between texts (a, b) of named: (no, root)."""
    of = named.select("no", "root")
    more = links.join(of.select(F.col("no").alias("a"), F.col("root").alias("x")), "a").join(of.select(F.col("no").alias("b"), F.col("root").alias("y")), "b")
    # Links between roots: what was connected before is one node.
    fresh = written(connected(more.select(F.col("x").alias("a"), F.col("y").alias("b"))), "similar-roots")
    moved = roots.alias("r").join(fresh.alias("j"), F.col("r.least") == F.col("j.node"), "left").select(
        "r.node", F.coalesce("j.least", "r.least").alias("least")
    )
    # A root of before has no row of its own.
    return written(moved.union(fresh), "roots")


def checked(docs: DataFrame, text: str, named: DataFrame, found: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """roots with the links of those pairs (a, b) whose texts are alike."""
    found, found_at = written_at(ordered(found), "similar-pairs")
    asked = found.select(F.col("a").alias("no")).union(found.select("b")).distinct()
    texts, texts_at = written_at(texts_of(docs, text, named.join(asked, "no", "left_semi")), "similar-texts")
    roots = joined(alike(found, texts, least), named, roots)
    for path in (found_at, texts_at):
        remove(docs.sparkSession, path)
    return roots


def rooted(named: DataFrame, roots: DataFrame) -> DataFrame:
    """named with the root that its fingerprint has by now."""
    return named.drop("root").join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("least", "fingerprint")
    ).drop("least")


def completed(
    docs: DataFrame, text: str, prints: DataFrame, roots: DataFrame, least: float = LEAST, reach: int = REACH, most: int = STRAY, exact: bool = False
) -> DataFrame:
    """roots (node, least) over fingerprints, with the links of all texts alike to ``least``. docs: a column _id and the text; prints: rows
    (doc_id, h1, h2, fingerprint, sketch) of the same documents. Texts of one fingerprint are connected as it is."""
    spark = docs.sparkSession
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"))).alias("first")
    # Each distinct text, of those that share a fingerprint too, has a number of its own.
    each = prints.filter("sketch.n > 0").groupBy("h1", "h2", "fingerprint").agg(first, F.first("sketch").alias("sketch"))
    each = each.select("fingerprint", "first.no_id", "first.id", "h1", "h2", "sketch", F.monotonically_increasing_id().alias("no"))
    each, each_at = written_at(each, "similar-names")
    named = rooted(each, roots)
    banded = named.select(F.explode("sketch.bands").alias("key"), F.col("sketch.gray").alias("gray"), "no", F.col("sketch.n").alias("n"), "root")
    met, met_at = written_at(neighbours(dealt(banded), least), "similar-members")
    # Where a node goes on in another task, the first row there follows the last one here.
    edges = met.filter("edge").withColumn("after", F.lead(F.struct("no", "n", "root")).over(Window.partitionBy("key").orderBy("gray", "no")))
    edges = edges.filter("after.no <> no and after.root <> root").select(F.col("no").alias("a"), F.col("after.no").alias("b"))
    # An edge row that is alone in its task is a member if its node has rows in others.
    spread = met.filter("edge").groupBy("key").agg(F.count_distinct("no").alias("n")).filter("n > 1").select("key")
    members = met.filter("not edge").union(met.filter("edge").join(spread, "key", "left_semi").select(*met.columns)).drop("edge")
    members, members_at = written_at(members, "similar-nodes")
    # Nodes that are connected already say nothing more.
    still, still_at = written_at(open_nodes(members), "similar-open")
    sized = met_by_key(members, still, ["key"], "size")
    central = sized.groupBy("no").agg(F.sum("size").alias("meets"))
    middle = sized.join(central, "no").groupBy("key", "size").agg(F.max(F.struct("meets", "no", "n", "root")).alias("mid"))
    middle = middle.select("key", "size", F.col("mid.no").alias("b"), F.col("mid.n").alias("n_b"), F.col("mid.root").alias("root_b"))
    middle, middle_at = written_at(middle, "similar-middle")
    can = F.least("n", "n_b") >= least * F.greatest("n", "n_b") - 1e-9
    stars = met_by_key(members, middle, ["key"], "size").filter((F.col("root") != F.col("root_b")) & can).select(F.col("no").alias("a"), "b")
    near = members.filter("near is not null").select(F.col("no").alias("a"), F.col("near").alias("b"))
    roots = checked(docs, text, named, near.union(edges).union(stars), roots, least)
    for path in (still_at, middle_at):
        remove(spark, path)
    # Second round: what is still apart, with its shingles.
    named = rooted(each, roots)
    words = words_of(BANDS * ROWS)
    four = [F.get("sketch.least", F.lit(k)).alias(f"m{k}") for k in range(words)]
    apart = members.select("key", "gray", "no", "n").distinct().join(named.select("no", "root"), "no")
    apart, apart_at = written_at(apart, "similar-apart")
    now = met_by_key(apart, open_nodes(apart), ["key"], "size").join(named.select("no", *four), "no")
    now = now.select("key", "gray", "no", "n", "root", *(f"m{k}" for k in range(words)))

    def hit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        near = (np.bitwise_count(x["code"] ^ y["code"]) <= reach) & (x["root"] != y["root"]) & fits(x["n"], y["n"], least)
        return near & (stray(x, y, words) <= most)

    def same(x: bytes, y: bytes) -> bool:
        mine, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        shared = len(np.intersect1d(mine, other, assume_unique=True))
        return shared >= least * (len(mine) + len(other) - shared)

    now, now_at = written_at(now, "similar-open")
    sets = texts_of(docs, text, named.join(now.select("no").distinct(), "no", "left_semi")).select("no", set_bytes()("text").alias("shingles"))
    sets, sets_at = written_at(sets, "similar-sets")
    extra = {"no": "i8", "n": "i4", "root": "i8"} | {f"m{k}": "u8" for k in range(words)}
    roots = joined(pairs(dealt(now.join(sets, "no")), extra, reach, hit, "no", same, SET_BLOCK), named, roots)
    for path in (met_at, members_at, apart_at, now_at, sets_at):
        remove(spark, path)
    if exact:
        for near_only in (True, False):
            named = rooted(each, roots)
            roots = checked(docs, text, named, prefix_pairs(docs, text, named, least, near_only), roots, least)
    remove(spark, each_at)
    return roots


def set_bytes():  # noqa: ANN201
    @F.arrow_udf(T.BinaryType())
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([shingle_set(x.as_py()).tobytes() for x in batch], pa.binary())

    return made


def sets():  # noqa: ANN201
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([shingle_set(x.as_py()).view(np.int64) for x in batch], pa.list_(pa.int64()))

    return made


def open_nodes(rows: DataFrame) -> DataFrame:
    """(key, size) of nodes whose rows (key, root) are not all connected."""
    found = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
    return found.filter("lo < hi").select("key", "size")


def prefix_pairs(docs: DataFrame, text: str, named: DataFrame, least: float, near_only: bool) -> DataFrame:
    """All pairs of texts (a, b) that may be alike to ``least`` and are not connected: they share a shingle of their prefixes, and their lengths
    and its places leave room for enough. Sets are ordered by how many texts hold a shingle, rare ones first. near_only: only those that
    follow each other by length among the texts with one shingle, so no more pairs than rows."""
    h1, h2 = hash128(text_of(text))
    own = docs.select(
        F.col("_id").isNull().alias("no_id"), F.coalesce("_id", F.lit(0)).alias("id"), h1.alias("h1"), h2.alias("h2"), sets()(text_of(text)).alias("sets")
    )
    every = own.join(named.select("no_id", "id", "h1", "h2", "no", "root"), ["no_id", "id", "h1", "h2"]).dropDuplicates(["no"])
    rows = every.select("no", "root", F.size("sets").alias("n"), F.explode("sets").alias("s"))
    held = rows.groupBy("s").agg(F.count("*").alias("held"))
    place = F.row_number().over(Window.partitionBy("no").orderBy("held", "s")) - 1
    rows = rows.join(held, "s").withColumn("place", place).filter((F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9)) & (F.col("held") > 1))
    rows = rows.select("s", "no", "n", "place", "root")
    names = ("no", "n", "place", "root")
    if near_only:
        after = F.lead(F.struct(*names)).over(Window.partitionBy("s").orderBy(F.desc("n"), "no"))
        both = rows.withColumn("after", after).select(*(F.col(x).alias(f"{x}_a") for x in names), *(F.col(f"after.{x}").alias(f"{x}_b") for x in names))
        longer = F.col("no_b").isNotNull()
    else:
        a, b = (rows.select("s", *(F.col(x).alias(f"{x}_{side}") for x in names)) for side in "ab")
        both, longer = a.join(b, "s"), (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("no_a") < F.col("no_b")))
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    close = (F.col("n_b") >= least * F.col("n_a") - 1e-9) & (room >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    return both.filter((F.col("root_a") != F.col("root_b")) & longer & close).select(F.col("no_a").alias("a"), F.col("no_b").alias("b"))


def sketch(text: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    return signatures(bands, rows)(text)
