"""WARC archives: written one gzip member per record, read back sequentially.

Writing: each attempt of a task writes archives of its own in the shared folder, a new one after every ``ROLL`` bytes, under names
that hold the attempt's number, so no attempt touches what another has written. A table of the archives, written last, lists the
files of the attempts that counted; others are never read. Payloads of at least ``REVISIT_MIN`` bytes that occur more than once are stored in the record of the smallest page id; the
others are revisit records that refer to it.

Reading: a task streams its archives front to back in blocks of ``READ`` bytes, inflates member by member, frames each record by
its Content-Length, and checks that the record's digests match its block and payload. Damage is an error that names the file and
place. One record is held at a time.

Defined cases: null html is the empty payload; a null page id is written as "null"; rows that share page id and payload are all
responses if theirs is the smallest id, as none comes before the other; a null url becomes "urn:page:<id>"; control characters
and spaces in urls are percent-coded; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import met_by_key, new_path, partitions, text_of, written

REVISIT_MIN, ROLL, READ, LEVEL = 100, 256 << 20, 1 << 16, 5
VERSION = b"WARC/1.1\r\n"
#: Fixed, so that a task that runs again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that does not hold what it says."""


def record_id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def page_of(identity: str) -> int | None:
    name = identity.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", safe(url) if url else f"urn:page:{page}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(body: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(body) + z.flush()


def members(stream: io.BufferedIOBase, read: int = READ) -> Iterator[tuple[int, bytes]]:
    """Place and content of each gzip member."""
    at, held = 0, b""
    while True:
        held = held or stream.read(read)
        if not held:
            return
        z, out, used = zlib.decompressobj(31), [], 0
        try:
            while not z.eof:
                if not held:
                    held = stream.read(read)
                    if not held:
                        raise WarcError(f"the member at {at} has no end")
                used += len(held)
                out.append(z.decompress(held))
                held = b""
        except zlib.error as e:
            raise WarcError(f"the member at {at}: {e}") from e
        held = z.unused_data
        yield at, b"".join(out)
        at += used - len(held)


def parse(body: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    if not body.startswith(VERSION):
        raise WarcError("no version line")
    end = body.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no end of the header")
    head = {}
    for line in body[len(VERSION) : end].decode("utf-8").split("\r\n"):
        name, found, value = line.partition(":")
        if not found:
            raise WarcError(f"the header line {line!r}")
        head[name.strip().lower()] = value.strip()
    length = int(head.get("content-length", -1))
    block = body[end + 4 : end + 4 + length]
    if length < 0 or len(block) != length or body[end + 4 + length :] != b"\r\n\r\n":
        raise WarcError("the block's length is not Content-Length")
    return head, block


def checked(body: bytes) -> tuple[int | None, str, int, str, str, int | None, bytes]:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of a record whose digests hold."""
    head, block = parse(body)
    if head.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("the block's digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("no end of the HTTP header")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("the payload's length or digest differs")
    return page_of(head["warc-record-id"]), head["warc-target-uri"], size, digest, kind, page_of(head["warc-refers-to"]) if kind == "revisit" else None, payload


def files_at(uri: str):  # noqa: ANN201
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", roll: int = ROLL) -> DataFrame:
    """Writes the archives; the rows (path, records, bytes) of the table that lists them."""
    spark = pages.sparkSession
    root = new_path(spark, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_of(html).alias("html"))
    # Ids and digests alone: which payload has which first page. Counts are aggregated before they are shuffled.
    seen = rows.filter(F.octet_length("html") >= REVISIT_MIN).select("page_id", F.sha2("html", 256).alias("digest"))
    firsts = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = met_by_key(seen, firsts, ["digest"], "n").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    # Written first, so that its size is known: where it is small, it goes to the pages rather than the pages to it.
    marks = written(later.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first"), "warc-marks")
    due = rows.withColumn("digest", F.sha2("html", 256)).join(
        marks, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left"
    )
    due = due.select("page_id", "url", "html", "digest", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files, folder = TaskContext.get(), *files_at(root)
        files.create_dir(folder)
        made: list[tuple[str, int, int]] = []
        out, size, n = None, 0, 0
        name = lambda: f"part-{task.partitionId():06d}-{task.taskAttemptId():010d}-{len(made):04d}.warc.gz"

        def finish() -> None:
            nonlocal out, size, n
            out.close()
            made.append((f"{root}/{name()}", n, size))
            out, size, n = None, 0, 0

        for batch in batches:
            for page, address, html_text, digest, first in zip(*batch.columns, strict=True):
                if out is None:
                    out = files.open_output_stream(f"{folder}/{name()}", compression=None)
                body = member(
                    record(page.as_py(), address.as_py(), html_text.as_buffer().to_pybytes() if html_text.is_valid else b"", digest.as_py(), first.as_py())
                )
                out.write(body)
                size, n = size + len(body), n + 1
                if size >= roll:
                    finish()
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"]
        )

    # The list has a row for each archive: few files hold it.
    listed = due.mapInArrow(work, "path string, records long, bytes long").repartition(max(1, partitions(spark) // 64), "path")
    listed.write.parquet(f"{root}/archives.parquet")
    return spark.read.schema("path string, records long, bytes long").parquet(f"{root}/archives.parquet")


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of the archives listed; with_payload:
    also the payload, empty for revisits."""
    spark: SparkSession = archives.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + with_payload]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, inside = files_at(path)
                rows, n = [], 0
                with files.open_input_stream(inside, compression=None, buffer_size=READ) as stream:
                    for at, body in members(stream):
                        try:
                            rows.append(checked(body))
                        except WarcError as e:
                            raise WarcError(f"{path} at {at}: {e}") from e
                        n += 1
                        if len(rows) == 64:
                            yield give(rows)
                            rows = []
                if n != records:
                    raise WarcError(f"{path} holds {n} records, not {records}")
                yield give(rows)

    dealt = archives.select("path", "records").repartition(partitions(spark))
    return dealt.mapInArrow(
        work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    )


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
