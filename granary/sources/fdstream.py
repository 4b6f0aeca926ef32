"""Chunk streams between processes: a signed 64-bit length or index before each chunk; negative lengths are inline bytes."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the most bytes that a reader takes for one inline chunk.
INLINE_LIMIT = 256 << 20


class ChunkError(ValueError):
    """A stream that ends early or has an oversized chunk."""


def write(chunks: Iterator[bytes | int] | list[bytes | int]) -> bytes:
    """Bytes are inline (empty ones write nothing), integers index external chunks."""
    return b"".join(struct.pack("<q", -len(c)) + c if isinstance(c, bytes) else struct.pack("<q", c) for c in chunks if c != b"")


def read(stream: io.BufferedIOBase) -> Iterator[bytes | int]:
    while head := stream.read(8):
        if len(head) < 8:
            raise ChunkError("a piece of a tag")
        tag = struct.unpack("<q", head)[0]
        if tag >= 0:
            if tag >= 1 << 32:
                raise ChunkError("an index beyond 32 bits")
            yield tag
            continue
        if -tag > INLINE_LIMIT:
            raise ChunkError("an inline chunk over the limit")
        body = stream.read(-tag)
        if len(body) < -tag:
            raise ChunkError("an inline chunk without its end")
        yield body


def encoded(chunks: DataFrame) -> DataFrame:
    """(stream_id, content) of chunks (stream_id, seq, inline, number): inline bytes, or the number of an external chunk. A stream is a row, so it
    fits in memory."""
    rows = chunks.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "inline", "number"))).alias("c"))
    one = F.udf(lambda parts: write([bytes(p.inline) if p.inline is not None else p.number for p in parts]), "binary", useArrow=False)
    return rows.select("stream_id", one("c").alias("content"))


def chunk_rows(streams: DataFrame) -> DataFrame:
    """(stream_id, seq, inline, number, error) of streams (stream_id, content); a stream that ends early keeps what comes before, and one row says
    why it ends."""

    def one(content: bytes) -> list[tuple]:
        out: list[tuple] = []
        try:
            for c in read(io.BytesIO(bytes(content))):
                out.append((len(out), c if isinstance(c, bytes) else None, None if isinstance(c, bytes) else c, None))
        except ChunkError as e:
            out.append((len(out), None, None, str(e)))
        return out

    kind = "array<struct<seq: bigint, inline: binary, number: bigint, error: string>>"
    return streams.select("stream_id", F.explode(F.udf(one, kind, useArrow=False)("content")).alias("c")).select("stream_id", "c.*")
