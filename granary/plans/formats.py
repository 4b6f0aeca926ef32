"""Files of binary formats made from the driver's tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import archive, erofs, fdstream
from .registry import table


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, name, body) of a customer's orders as small files: few for each customer."""
    orders = table(spark, sf_dir, "orders")
    body = F.repeat(F.concat("o_orderpriority", F.lit("|")), (F.col("o_orderkey") % 12).cast("int"))
    return orders.select(
        F.col("o_custkey").cast("string").alias("image_id"), F.col("o_orderkey").cast("string").alias("name"), body.cast("binary").alias("body")
    )


FILES = "SELECT CAST(o_custkey AS VARCHAR) AS owner, CAST(o_orderkey AS VARCHAR) AS name, repeat(o_orderpriority || '|', CAST(o_orderkey % 12 AS INTEGER)) AS body FROM orders"


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a tar archive of each customer's orders."""
    made = customer_files(spark, sf_dir).groupBy("image_id").agg(F.collect_list(F.struct("name", "body")).alias("files"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for owner, files in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, bodies = (files.values.field(k).to_pylist() for k in range(2))
                yield owner, archive.written((f"orders/{name}", body) for name, body in sorted(zip(names, bodies, strict=True), key=lambda f: f[0]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return archive.batched(rows(batches), {"path": pa.string(), "content": pa.binary()})

    return made.mapInArrow(work, "path string, content binary")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, content): a file system image of each customer's orders."""
    files = customer_files(spark, sf_dir)
    long = F.octet_length("body") > 64
    nothing = F.lit(None).cast("binary")
    stat = [F.lit(0o644).alias("mode"), F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"), F.lit(1000).cast("long").alias("mtime")]
    path = F.concat(F.lit("/"), "name").cast("binary").alias("path")
    size = F.octet_length("body").cast("long").alias("size")
    leaves = files.select(
        "image_id",
        path,
        F.lit("reg").alias("kind"),
        *stat,
        size,
        F.when(~long, F.col("body")).alias("inline"),
        F.when(long, F.sha2("body", 256)).alias("object_id"),
    )
    roots = files.select("image_id").distinct().select(
        "image_id",
        F.lit("/").cast("binary").alias("path"),
        F.lit("dir").alias("kind"),
        *stat,
        F.lit(0).cast("long").alias("size"),
        nothing.alias("inline"),
        F.lit(None).cast("string").alias("object_id"),
    )
    return erofs.image_rows(leaves.unionByName(roots))


def _executable(release: str | None, cmdline: str | None) -> bytes:
    parts = [(name, body.encode()) for name, body in ((b".osrel", release), (b".cmdline", cmdline)) if body is not None]
    start = 0x40 + 24 + 40 * len(parts)
    heads, bodies = b"", b""
    for name, body in parts:
        heads += struct.pack("<8sIIII", name, len(body), 0, len(body), start + len(bodies)) + bytes(16)
        bodies += body
    return b"MZ" + bytes(0x3A) + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0, len(parts), 0, 0, 0, 0, 0) + heads + bodies


#: A portable executable with sections for a system's release file and a command line.
executable = F.udf(_executable, T.BinaryType(), useArrow=False)


def chunk_streams(turns: DataFrame) -> DataFrame:
    """(stream_id, chunks, external) of conversations' turns written as chunk streams and read back; long turns are external."""
    long = F.octet_length("text") > 64
    chunks = turns.select(
        F.col("conv_id").cast("string").alias("stream_id"),
        F.col("turn").alias("seq"),
        F.when(~long, F.col("text").cast("binary")).alias("inline"),
        F.when(long, F.col("turn")).alias("number"),
    )
    back = fdstream.chunk_rows(fdstream.encoded(chunks))
    return back.groupBy("stream_id").agg(F.count("*").alias("chunks"), F.count("number").alias("external"))
