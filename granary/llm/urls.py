"""URL filters over a sorted digest array.

A rule is a host and a path, such as example.net/en/, with a verdict. The index is one file: the rules' 64-bit xxhash keys in
ascending order, the places of the rules' strings, their verdicts, and the strings. The driver writes it to the shared folder, from a
list or, a piece at a time, from a table of rules that tasks have sorted, and Spark ships it to every executor, whose tasks map it into memory, so all workers of an executor share one copy and a lost executor's
successor fetches it anew. A url's candidates are the suffixes of its host at label borders with each path length that rules have;
their keys are probed by one vectorised binary search per batch, every run of equal keys is followed, and the stored string
must equal the candidate, so colliding keys cannot give a wrong answer. Urls never leave their partition.

Defined cases: a null url, or one without "://", has an empty host and path and fits no rule; a url that no rule fits is allowed;
of the rules that fit, the longest wins, of equally long ones that with the longer host, and of equal strings the last one given, in a table
of rules the one that blocks; repeated rows are judged alike; an empty table or rule list is fine; extra columns pass through, one that has
the result's name under another (``aside``).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, aside, partitions, remove, shared_dir, written_at

SEED, MAGIC = 42, b"GRURLS01"
DEFAULT = "allow"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
VERDICTS = ("allow", "block")
_FOLD = str.maketrans(UPPER, LOWER)


def key_of(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode("utf-8", "surrogatepass"), SEED)


def index_bytes(rules: list[tuple[str, str]] | tuple, digest=key_of) -> bytes:  # noqa: ANN001
    """Magic, counts, path lengths, keys, offsets, verdicts and strings; every array starts at a multiple of 8."""
    latest = dict(rules)
    named = sorted((digest(r), r) for r in latest)
    keys = np.array([k for k, _ in named], "<u8")
    texts = [r.encode("utf-8", "surrogatepass") for _, r in named]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64))).astype("<i8")
    lengths = np.array(sorted({len(r) - r.find("/") if "/" in r else 0 for r in latest}), "<i8")
    verdicts = np.array([VERDICTS.index(latest[r]) for _, r in named], "<i8")
    head = np.array([len(named), len(lengths)], "<i8")
    return MAGIC + b"".join(x.tobytes() for x in (head, lengths, keys, offsets, verdicts)) + b"".join(texts)


class DigestArray:
    """The index file, mapped."""

    def __init__(self, path: str, digest=key_of):  # noqa: ANN001
        self.map = np.memmap(path, np.uint8, "r")
        if self.map[:8].tobytes() != MAGIC:
            raise ValueError(f"{path} is no digest array")
        whole = self.map[8 : 8 + (len(self.map) - 8) // 8 * 8].view("<i8")
        n, k = int(whole[0]), int(whole[1])
        self.path_lengths = whole[2 : 2 + k].tolist()
        at = 2 + k
        self.keys, self.offsets, self.verdicts = whole[at : at + n].view("<u8"), whole[at + n : at + 2 * n + 1], whole[at + 2 * n + 1 : at + 3 * n + 1]
        self.texts = self.map[8 + 8 * (at + 3 * n + 1) :]
        self.digest = digest

    def find(self, asked: list[str]) -> np.ndarray:
        """The place of each string, -1 where there is none."""
        out = np.full(len(asked), -1, np.int64)
        if not len(self.keys) or not asked:
            return out
        keys = np.fromiter((self.digest(x) for x in asked), np.uint64, len(asked))
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            want = asked[k].encode("utf-8", "surrogatepass")
            for at in range(int(lo[k]), int(hi[k])):
                if self.texts[self.offsets[at] : self.offsets[at + 1]].tobytes() == want:
                    out[k] = at
        return out

    def text(self, at: int) -> str:
        return self.texts[self.offsets[at] : self.offsets[at + 1]].tobytes().decode("utf-8", "surrogatepass")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path: the host after the first :// up to a slash, question mark or hash, the path up to a question mark or hash."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(_FOLD), tail[:stop]


def suffixes(host: str) -> list[str]:
    """The host and the domains above it."""
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def judge(index: DigestArray, urls: list[str | None], default: str = DEFAULT) -> list[tuple[str, str, str | None, str]]:
    """Host, path, rule and verdict of each url."""
    split = [parts(u) for u in urls]
    # Many urls of a batch share hosts and path beginnings: every candidate is probed once.
    place: dict[str, int] = {}
    of = [[place.setdefault(h + path[:n], len(place)) for h in suffixes(host) for n in index.path_lengths if n <= len(path)] for host, path in split]
    found = index.find(list(place))
    out = []
    for (host, path), candidates in zip(split, of, strict=True):
        hits = [int(found[k]) for k in candidates if found[k] >= 0]
        best = max(hits, key=lambda at: len(index.text(at)), default=None)
        out.append((host, path, None, default) if best is None else (host, path, index.text(best), VERDICTS[index.verdicts[best]]))
    return out


_open: dict[str, DigestArray] = {}


def index_parts(rules: DataFrame) -> Iterator[bytes]:
    """The bytes of ``index_bytes`` for rules (rule, verdict), piece by piece. Tasks sort and pack the rules by ranges of their keys; the driver
    holds one range's column at a time. Of a rule that comes twice, block counts."""
    spark = rules.sparkSession
    once = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    # Spark's xxhash64 is the index's key; turning the top bit makes the order of signed integers that of unsigned ones.
    signed = once.select(F.expr(f"xxhash64(rule) ^ {-(1 << 63)}").alias("turned"), "rule", "verdict")
    order = ["turned", F.col("rule").cast("binary")]
    dealt = signed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, verdicts, texts, n = [], [], [], [], 0
        paths: set[int] = set()
        for batch in batches:
            n += batch.num_rows
            keys.append((batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)).astype("<u8").tobytes())
            rows = batch.column(1).to_pylist()
            whole = [r.encode("utf-8", "surrogatepass") for r in rows]
            sizes.append(np.array([len(x) for x in whole], "<i8").tobytes())
            texts.append(b"".join(whole))
            verdicts.append(np.array([VERDICTS.index(x) for x in batch.column(2).to_pylist()], "<i8").tobytes())
            paths |= {len(r) - r.find("/") if "/" in r else 0 for r in rows}
        if n:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([sorted(paths)], pa.list_(pa.int64()))]
            columns += [pa.array([b"".join(x)], pa.binary()) for x in (keys, sizes, verdicts, texts)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "n", "paths", "keys", "sizes", "verdicts", "texts"])

    kind = "part int, n long, paths array<long>, keys binary, sizes binary, verdicts binary, texts binary"
    made, at = written_at(dealt.mapInArrow(pack, kind), "url-rules")
    column = lambda name: (bytes(r[0]) for r in made.orderBy("part").select(name).toLocalIterator())
    total = made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lengths = np.array(sorted(r[0] for r in made.select(F.explode("paths")).distinct().collect()), "<i8")
    yield MAGIC + np.array([total, len(lengths)], "<i8").tobytes() + lengths.tobytes()
    yield from column("keys")
    end = 0
    yield np.zeros(1, "<i8").tobytes()
    for sizes in column("sizes"):
        ends = end + np.cumsum(np.frombuffer(sizes, "<i8"), dtype=np.int64)
        end = int(ends[-1])
        yield ends.astype("<i8").tobytes()
    yield from column("verdicts")
    yield from column("texts")
    remove(spark, at)


def shipped(spark: SparkSession, rules: list[tuple[str, str]] | tuple | DataFrame) -> str:
    """Writes the index to the shared folder, ships it to the executors and returns its file name there."""
    folder = f"{shared_dir(spark)}/granary"
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/urls-{uuid.uuid4().hex}.draft")
    files = draft.getFileSystem(spark._jsc.hadoopConfiguration())
    out, digest = files.create(draft, True), hashlib.sha256()
    for part in index_parts(rules) if isinstance(rules, DataFrame) else [index_bytes(rules)]:
        digest.update(part)
        for at in range(0, len(part), 1 << 20):
            out.write(bytearray(part[at : at + (1 << 20)]))
    out.close()
    # Its name tells its content, so whoever comes first has written the same.
    name = f"granary-urls-{digest.hexdigest()[:32]}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if files.exists(path) or not files.rename(draft, path):
        files.delete(draft, False)
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return name


def filtered(
    df: DataFrame, url: str = "url", rules: list[tuple[str, str]] | tuple | DataFrame = RULES, into: str = "judged", default: str = DEFAULT
) -> DataFrame:
    """df with a struct column of host, path, rule and verdict. rules: a list, or a table (rule, verdict) of any length."""
    df, [url] = aside(df, [into], [url])
    name = shipped(df.sparkSession, rules)
    kind = T.StructType([T.StructField(x, T.StringType()) for x in ("host", "path", "rule", "verdict")])

    @F.arrow_udf(kind)
    def verdicts(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _open.get(name) or _open.setdefault(name, DigestArray(SparkFiles.get(name)))
        for batch in urls:
            rows = judge(index, batch.to_pylist(), default)
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["host", "path", "rule", "verdict"])

    return df.withColumn(into, verdicts(F.col(url)))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, rhost, rpath, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""
