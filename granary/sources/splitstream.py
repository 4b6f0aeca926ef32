"""Streams of inline bytes and references to objects, as files.

Header, info block, arrays of references, compressed names, compressed body. The body is a sequence of signed 64-bit tags: a negative one
is so many bytes that follow, another the index of an object. Encoding and decoding work on one stream at a time; the tables' side
runs them over rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import ALGORITHMS
from .archive import batched

#: Fixed values of the format.
MAGIC, VERSION, LOG2_BLOCK = b"SplitStream", 0, 12
HEADER, INFO = struct.Struct("<11sBHBBQQ"), struct.Struct("<8QQQ")
OLD_HEADER = struct.Struct("<QQH11sBBB")
#: Content types by the words they spell.
CONTENT_TYPES = {name: int.from_bytes(name.encode(), "little") for name in ("ocilayer", "ociconfg", "ocimanif", "oci_blob")}


class StreamError(ValueError):
    """A file that is no stream, or not the one asked for."""


@dataclass
class Stream:
    content_type: int = 0
    chunks: list[bytes | str] = field(default_factory=list)  # inline bytes, or the hex id of an object
    named_refs: dict[str, str] = field(default_factory=dict)
    total_size: int = 0
    algorithm: str = "sha256"
    object_refs: list[str] = field(default_factory=list)


def merged(chunks: list[bytes | str]) -> Iterator[bytes | str]:
    """Adjacent inline chunks as one, empty ones left out."""
    held: list[bytes] = []
    for c in chunks:
        if isinstance(c, bytes):
            held.append(c)
            continue
        if body := b"".join(held):
            yield body
        held = []
        yield c
    if body := b"".join(held):
        yield body


def encode(stream: Stream) -> bytes:
    """Objects are numbered by first appearance, names sorted."""
    number, _, _ = ALGORITHMS[stream.algorithm]
    objects: dict[str, int] = {}
    refs: dict[str, int] = {}
    body = []
    for c in merged(stream.chunks):
        if isinstance(c, bytes):
            body += [struct.pack("<q", -len(c)), c]
        else:
            body.append(struct.pack("<q", objects.setdefault(c, len(objects))))
    names = "".join(f"{refs.setdefault(target, len(refs))}:{name}\0" for name, target in sorted(stream.named_refs.items(), key=lambda x: x[0].encode()))
    squeeze = zstandard.ZstdCompressor(write_content_size=False)
    parts = [b"".join(map(bytes.fromhex, refs)), b"".join(map(bytes.fromhex, objects)), squeeze.compress(names.encode()), squeeze.compress(b"".join(body))]
    start = HEADER.size + INFO.size
    ranges, at = [], start
    for p in parts:
        ranges.append((at, at + len(p)))
        at += len(p)
    stream_refs, object_refs, named, content = ranges
    info = INFO.pack(*stream_refs, *object_refs, *content, *named, stream.content_type, stream.total_size)
    return HEADER.pack(MAGIC, VERSION, 0, number, LOG2_BLOCK, HEADER.size, start) + info + b"".join(parts)


def inflate(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(data) if data else b""


def decode(data: bytes, content_type: int | None = None, body: bool = True) -> Stream:
    """body: False reads the references alone and leaves the stream compressed."""
    if len(data) < HEADER.size:
        raise StreamError("too short for a header")
    magic, version, _, number, block, begin, end = HEADER.unpack_from(data)
    if magic != MAGIC:
        begin, end, _, magic, version, number, block = OLD_HEADER.unpack_from(data)
        if magic != MAGIC:
            raise StreamError("no magic value")
    algorithm = next((k for k, v in ALGORITHMS.items() if v[0] == number), None)
    if version != VERSION or algorithm is None or block != LOG2_BLOCK:
        raise StreamError("version, algorithm or block size")

    def section(lo: int, hi: int) -> bytes:
        if not lo <= hi <= len(data):
            raise StreamError("a section outside the file")
        return data[lo:hi]

    info = section(begin, end)
    if len(info) < INFO.size:
        raise StreamError("too short an info section")
    *ranges, kind, total = INFO.unpack_from(info)
    if content_type is not None and kind != content_type:
        raise StreamError("another content type")
    size = ALGORITHMS[algorithm][1]

    def ids(part: bytes) -> list[str]:
        if len(part) % size:
            raise StreamError("a piece of a reference")
        return [part[k : k + size].hex() for k in range(0, len(part), size)]

    refs, objects = ids(section(*ranges[0:2])), ids(section(*ranges[2:4]))
    named: dict[str, str] = {}
    items = inflate(section(*ranges[6:8])).split(b"\0")
    if items.pop():
        raise StreamError("names end without a NUL")
    for item in items:
        index, colon, name = item.decode().partition(":")
        if not colon or not index.isdigit() or int(index) >= len(refs):
            raise StreamError(f"the name {item!r}")
        named[name] = refs[int(index)]
    out = Stream(kind, [], named, total, algorithm, objects)
    if body:
        raw, at = inflate(section(*ranges[4:6])), 0
        while at < len(raw):
            if at + 8 > len(raw):
                raise StreamError("a piece of a tag")
            tag = struct.unpack_from("<q", raw, at)[0]
            at += 8
            if tag < 0:
                if at - tag > len(raw):
                    raise StreamError("an inline chunk without its end")
                out.chunks.append(raw[at : at - tag])
                at -= tag
            elif tag >= len(objects):
                raise StreamError("an object out of range")
            else:
                out.chunks.append(objects[tag])
    return out


def headers(files: DataFrame, content: str = "content") -> DataFrame:
    """files with content_type, total_size, object_refs and named_refs; bodies stay compressed. Broken files have an error."""
    kind = "struct<content_type: bigint, total_size: bigint, object_refs: array<string>, named_refs: map<string, string>, error: string>"

    def one(data: bytes) -> tuple:
        try:
            s = decode(data, body=False)
        except (StreamError, zstandard.ZstdError) as e:
            return None, None, None, None, str(e)
        return s.content_type, s.total_size, s.object_refs, list(s.named_refs.items()), None

    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string())
    names = ["content_type", "total_size", "object_refs", "named_refs", "error"]

    def read(data: pa.Array) -> pa.Array:
        found = [one(x.as_py()) for x in data]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names)

    return files.withColumn("_s", F.arrow_udf(read, kind)(F.col(content))).select(*files.columns, "_s.*")


def problems(files: DataFrame, key: str = "name", content: str = "content", size: str = "total_size") -> DataFrame:
    """(key, error) of stream files that can't be read to their end, or whose inline bytes exceed the size in column ``size``."""

    def one(data: bytes | None, total: int | None) -> str | None:
        try:
            s = decode(data or b"")
        except (StreamError, zstandard.ZstdError, UnicodeDecodeError) as e:
            return str(e)
        inner = sum(len(c) for c in s.chunks if isinstance(c, bytes))
        return "another size" if total is not None and (s.total_size != total or inner > total) else None

    def read(data: pa.Array, totals: pa.Array) -> pa.Array:
        return pa.array([one(x.as_py(), n) for x, n in zip(data, totals.to_pylist(), strict=True)], pa.string())

    return files.select(key, F.arrow_udf(read, "string")(content, size).alias("error")).filter("error is not null")


def chunk_rows(files: DataFrame, key: str = "name", content: str = "content") -> DataFrame:
    """(stream_id, seq, kind, inline, object_id) of every chunk."""

    kinds = dict(stream_id=pa.string(), seq=pa.int64(), kind=pa.string(), inline=pa.binary(), object_id=pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, c in enumerate(decode(data.as_py()).chunks):
                    yield (name, k, "inline", c, None) if isinstance(c, bytes) else (name, k, "external", None, c)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), kinds)

    return files.select(F.col(key).cast("string"), content).mapInArrow(work, "stream_id string, seq long, kind string, inline binary, object_id string")


def encoded(chunks: DataFrame, names: DataFrame | None = None, algorithm: str = "sha256") -> DataFrame:
    """(stream_id, content): a file for each stream of (stream_id, seq, inline, object_id, size); names (stream_id, content_type, named_refs)."""
    rows = chunks.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "inline", "object_id"))).alias("c"), F.sum("size").alias("total"))
    rows = rows.join(names, "stream_id", "left") if names is not None else rows.withColumns(
        {"content_type": F.lit(0).cast("long"), "named_refs": F.lit(None).cast("map<string, string>")}
    )

    def files(parts: pa.Array, total: pa.Array, kind: pa.Array, named: pa.Array) -> pa.Array:
        out = []
        # A stream's chunks as two lists: an object for each chunk would take longer than its encoding.
        for p, size, number, refs in zip(parts, total.to_pylist(), kind.to_pylist(), named.to_pylist(), strict=True):
            inline, ids = (p.values.field(k).to_pylist() for k in (1, 2))
            chunks = [i if b is None else b for b, i in zip(inline, ids, strict=True)]
            out.append(encode(Stream(number or 0, chunks, dict(refs or ()), size or 0, algorithm)))
        return pa.array(out, pa.binary())

    return rows.select("stream_id", F.arrow_udf(files, "binary")("c", "total", "content_type", "named_refs").alias("content"))
