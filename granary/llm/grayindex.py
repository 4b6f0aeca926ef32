"""The Gray-order hierarchical index of 64-bit codes, over nodes of any size.

Rows (key, gray, ...) are members of nodes: upper nodes are masked bit patterns, named by ``key``, and below them members lie in Gray
order, which puts codes that differ in few bits side by side. Rows are dealt by ranges of (key, gray) rather than by node, so a node of any
size spreads over tasks. A task cuts a node into blocks of ``BLOCK`` members and blocks into leaves of ``LEAF``; each keeps the bits that
all its members share (the AND and the OR of its members). Two groups are compared only if the bits that both share differ in ``reach``
places or fewer: the differences accumulated so far prune a whole pair of groups at once, blocks first, then leaves. Blocks of one node
that lie apart, in one task or several, meet by their summaries. So everything that pairs of a node connect is connected, and a task gives no
more pairs than members.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

LEAF, BLOCK, SMALL = 64, 1024, 8
TOP = np.uint64(1 << 63)
#: Says of two arrays of members, broadcast against each other, which pairs count.
Hit = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Says of the bodies of two members whether they count after all.
Same = Callable[[bytes, bytes], bool]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the sequence of 64-bit Gray codes."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def code_of(rank: np.ndarray) -> np.ndarray:
    """The code at a place in the sequence of Gray codes."""
    return rank ^ (rank >> np.uint64(1))


def signed_rank(codes: np.ndarray) -> np.ndarray:
    """Ranks as signed integers of the same order."""
    return (gray_rank(codes) ^ TOP).view(np.int64)


def far_apart(and_a, or_a, and_b, or_b):  # noqa: ANN001, ANN201
    """Bits that all members of one group have set and no member of the other has: differences of every pair between them."""
    return np.bitwise_count((and_a & ~or_b) | (and_b & ~or_a))


def leaves(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)


def linked(a: np.ndarray, b: np.ndarray | None, reach: int, hit: Hit, same: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that count within a Gray-sorted block, or between two: pairs of positions, those of b after those of a.
    Leaves are pruned by the bits they share before their members are compared. same: says of two positions whether a pair that ``hit``
    accepts counts; it is asked only for members that nothing connects so far. Members with one ``root`` are connected from the start."""
    other = a if b is None else b
    both = a if b is None else np.concatenate((a, b))
    sa, sb = np.arange(0, len(a), LEAF), np.arange(0, len(other), LEAF)
    (and_a, or_a), (and_b, or_b) = leaves(a["code"], sa), leaves(other["code"], sb)
    near = far_apart(and_a[:, None], or_a[:, None], and_b[None, :], or_b[None, :]) <= reach
    if b is None:
        near = np.triu(near)
    shift, out = (0 if b is None else len(a)), []
    group = np.unique(both["root"], return_inverse=True)[1] if "root" in both.dtype.names else np.arange(len(both))
    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = a[sa[i] : sa[i] + LEAF], other[sb[j] : sb[j] + LEAF]
        hits = hit(x[:, None], y[None, :])
        p, q = np.nonzero(np.triu(hits, 1) if b is None and i == j else hits)
        p, q = p + sa[i], q + sb[j] + shift
        while True:
            fresh = group[p] != group[q]
            p, q = p[fresh], q[fresh]
            if not len(p):
                break
            first = (int(p[0]), int(q[0]))
            if same is None or same(*first):
                out.append(first)
                group[group == group[q[0]]] = group[p[0]]
            else:
                # The next ones that count are looked for one by one; only a link changes the groups.
                k = next((k for k in range(1, len(p)) if same(int(p[k]), int(q[k]))), None)
                if k is None:
                    break
                out.append((int(p[k]), int(q[k])))
                group[group == group[q[k]]] = group[p[k]]
                p, q = p[k:], q[k:]
    return out


def changes(rows: np.ndarray) -> np.ndarray:
    """The places at which another node begins."""
    return np.flatnonzero(rows["key"][1:] != rows["key"][:-1]) + 1


def dealt(members: DataFrame) -> DataFrame:
    """Members by ranges of (key, gray, no), each partition sorted; without a column no, by those of (key, gray)."""
    order = ["key", "gray", *(x for x in members.columns if x == "no")]
    rest = [x for x in members.columns if x not in order]
    return members.select(*order, *rest).repartitionByRange(partitions(members.sparkSession), *order).sortWithinPartitions(*order)


def arrays(extra: dict[str, str]) -> tuple[np.dtype, Callable[[pa.RecordBatch], np.ndarray]]:
    """The type of members with so many columns (name: numpy type) beside key and gray, and a function that reads them."""
    kind = np.dtype([("key", "i8"), ("code", "u8"), *extra.items()])

    def read(batch: pa.RecordBatch) -> np.ndarray:
        new = np.empty(batch.num_rows, kind)
        new["key"] = batch.column(0).to_numpy(zero_copy_only=False)
        new["code"] = code_of(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) ^ TOP)
        for k, name in enumerate(extra, 2):
            new[name] = batch.column(k).to_numpy(zero_copy_only=False)
        return new

    return kind, read


def pairs(members: DataFrame, extra: dict[str, str], reach: int, hit: Hit, name: str, same: Same | None = None, block: int | None = None) -> DataFrame:
    """(a, b): values of column ``name`` of pairs within nodes that ``hit`` accepts, all of which differ in ``reach`` bits at most: so many that
    they connect what all of them connect, and no more rows than members. members: rows (key, gray, the extra columns) as ``dealt`` gives
    them. same: the last column of members is a body, and a pair counts if ``same`` says so of its bodies."""
    kind, read = arrays(extra)
    block = block or BLOCK

    def check(rows: np.ndarray, bodies: dict[int, bytes]) -> Callable[[int, int], bool] | None:
        return None if same is None else lambda i, j: same(bodies[int(rows[name][i])], bodies[int(rows[name][j])])

    def inner(rows: np.ndarray, bodies: dict[int, bytes], first: bool, last: bool) -> pa.RecordBatch:
        """The pairs within blocks of nodes, and a summary of each block whose node goes on in another. first, last: the first and the last
        node may have members elsewhere."""
        out, cut = [], []
        change = changes(rows)
        starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(rows)]))
        large = np.zeros(len(rows), bool)
        for lo, hi in zip(starts[ends - starts > SMALL].tolist(), ends[ends - starts > SMALL].tolist(), strict=True):
            large[lo:hi] = True
            for at in range(lo, hi, block):
                x = rows[at : min(hi, at + block)]
                out += [(at + p, at + q) for p, q in linked(x, None, reach, hit, check(x, bodies))]
        # Nodes of a few members: all at once, each row with the k-th after it.
        small = check(rows, bodies)
        for k in range(1, SMALL):
            alike = (rows["key"][k:] == rows["key"][:-k]) & ~large[k:]
            if not alike.any():
                break
            at = np.flatnonzero(alike)
            at = at[hit(rows[at], rows[at + k])].tolist()
            out += [(p, p + k) for p in at if small is None or small(p, p + k)]
        for n, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            if hi - lo > block or (first and n == 0) or (last and hi == len(rows)):
                cut += [rows[at : min(hi, at + block)] for at in range(lo, hi, block)]
        found = np.array(out, np.int64).reshape(-1, 2)
        a, b = (rows[name][found[:, side]].view(np.int64) if len(found) else np.zeros(0, np.int64) for side in (0, 1))
        none = [None] * len(found)
        word = lambda x: int(x.view(np.int64))
        columns = {
            "a": [*a.tolist(), *[None] * len(cut)],
            "b": [*b.tolist(), *[None] * len(cut)],
            "key": none + [int(x["key"][0]) for x in cut],
            "bits_all": none + [word(np.bitwise_and.reduce(x["code"])) for x in cut],
            "bits_any": none + [word(np.bitwise_or.reduce(x["code"])) for x in cut],
            "lo": none + [int(x["root"].min()) if "root" in extra else 0 for x in cut],
            "hi": none + [int(x["root"].max()) if "root" in extra else 1 for x in cut],
        }
        packed = [pickle.dumps((x.tobytes(), {int(k): bodies[int(k)] for k in x[name]} if same else {})) for x in cut]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns.values()), pa.array(none + packed, pa.binary())], [*columns, "rows"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bodies, border = np.zeros(0, kind), {}, True
        for batch in batches:
            new = read(batch)
            held = np.concatenate((held, new))
            if same:
                bodies.update(zip(new[name].tolist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True))
            while True:
                change = changes(held)
                if len(change) and (change[-1] >= block or len(held) >= 3 * block):
                    # Whole nodes leave; the last one may go on.
                    at, ends, goes_on = int(change[-1]), False, False
                elif not len(change) and len(held) >= 2 * block:
                    at, ends, goes_on = block, True, True
                else:
                    break
                yield inner(held[:at], bodies, border or goes_on, ends)
                held, border = held[at:], goes_on
                bodies = {k: bodies[k] for k in held[name].tolist()} if same else bodies
        if len(held):
            yield inner(held, bodies, border, True)

    found = written(members.mapInArrow(work, "a long, b long, key long, bits_all long, bits_any long, lo long, hi long, rows binary"), "gray-blocks")
    blocks = found.filter("key is not null").select("key", "bits_all", "bits_any", "lo", "hi", "rows").withColumn("block", F.xxhash64("key", "rows"))
    left, right = (blocks.select("key", *(F.col(x).alias(f"{x}_{side}") for x in ("bits_all", "bits_any", "lo", "hi", "block"))) for side in "ab")
    apart = F.bit_count(F.expr("(bits_all_a & ~bits_any_b) | (bits_all_b & ~bits_any_a)"))
    several = F.least("lo_a", "lo_b") < F.greatest("hi_a", "hi_b")
    near = left.join(right, "key").filter((F.col("block_a") < F.col("block_b")) & (apart <= reach) & several).select("block_a", "block_b")
    contents = blocks.select("block", "rows").dropDuplicates(["block"])
    for side in "ab":
        near = near.join(contents.select(F.col("block").alias(f"block_{side}"), F.col("rows").alias(f"rows_{side}")), f"block_{side}")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                (p, some), (q, others) = pickle.loads(x.as_py()), pickle.loads(y.as_py())
                p, q = np.frombuffer(p, kind), np.frombuffer(q, kind)
                rows = np.concatenate((p, q))
                at = np.array(linked(p, q, reach, hit, check(rows, some | others)), np.int64).reshape(-1, 2)
                both = rows[name].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[at[:, 0]]), pa.array(both[at[:, 1]])], ["a", "b"])

    return found.filter("a is not null").select("a", "b").union(near.select("rows_a", "rows_b").mapInArrow(across, "a long, b long"))
