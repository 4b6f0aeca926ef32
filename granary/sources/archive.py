"""Tar archives as rows: entries, and the split into inline bytes and objects that puts the archive together again byte for byte."""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import json
import os
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import verity_bytes
from ..schemas import INLINE_MAX

XATTR = "SCHILY.xattr."
_TYPES = {
    tarfile.REGTYPE: "reg",
    tarfile.AREGTYPE: "reg",
    tarfile.CONTTYPE: "reg",
    tarfile.DIRTYPE: "dir",
    tarfile.LNKTYPE: "hardlink",
    tarfile.SYMTYPE: "lnk",
    tarfile.CHRTYPE: "chr",
    tarfile.BLKTYPE: "blk",
    tarfile.FIFOTYPE: "fifo",
}


#: Rows and bytes of a batch of results.
_ROWS, _BYTES = 8192, 4 << 20


def batched(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches, each full by rows or by the bytes of their binary values: a batch for each file would cost more than most files do."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= _ROWS or size >= _BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))


class ArchiveError(ValueError):
    """An archive that can't be read or holds what isn't supported."""


#: Entry types of a plain header, which say all there is to an entry, and those of them whose content follows.
_PLAIN, _FILLED = frozenset(b"\x0001234567"), frozenset(b"\x0007")


def _number(field: bytes) -> int:
    """An octal number; ValueError for what needs more care."""
    return int(field.partition(b"\0")[0].strip() or b"0", 8)


def _name(field: bytes) -> str:
    return field.partition(b"\0")[0].decode("utf-8", "surrogateescape")


def _plain_members(data: bytes) -> list[tarfile.TarInfo] | None:
    """The entries of an archive that has nothing but plain headers with right sums, as ``tarfile`` reads them in a fraction of its time. None
    for any other archive, also where its end is odd: that is for ``tarfile`` to judge."""
    out, at, end = [], 0, len(data)
    while at + tarfile.BLOCKSIZE <= end:
        head = data[at : at + tarfile.BLOCKSIZE]
        if not head.strip(b"\0"):
            return out or None
        kind = head[156]
        if kind not in _PLAIN or head[0] == 0:
            return None
        try:
            total, mode, uid, gid, size, mtime = map(_number, (head[148:156], head[100:108], head[108:116], head[116:124], head[124:136], head[136:148]))
            major, minor = (_number(head[329:337]), _number(head[337:345])) if kind in b"34" else (0, 0)
        except ValueError:
            return None
        # Zeros add nothing; the sum itself counts as eight blanks.
        if size < 0 or sum(head[:148].replace(b"\0", b"")) + 256 + sum(head[156:].replace(b"\0", b"")) != total:
            return None
        m = tarfile.TarInfo(_name(head[:100]))
        if head[345]:
            m.name = f"{_name(head[345:500])}/{m.name}"
        if kind == 0 and m.name.endswith("/"):
            return None
        m.type, m.mode, m.uid, m.gid, m.size, m.mtime = head[156:157], mode, uid, gid, size, mtime
        m.devmajor, m.devminor, m.offset, m.offset_data = major, minor, at, at + tarfile.BLOCKSIZE
        if kind in b"12":
            m.linkname = _name(head[157:257])
        if kind == 53:
            m.name = m.name.rstrip("/")
        out.append(m)
        at += tarfile.BLOCKSIZE + (-(-size // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE if kind in _FILLED else 0)
    return out if out and at == end else None


def _members(data: bytes) -> Iterator[tarfile.TarInfo]:
    if (plain := _plain_members(data)) is not None:
        yield from plain
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:", encoding="utf-8", errors="surrogateescape") as tar:
            for m in tar:
                if m.sparse is not None or m.type == tarfile.GNUTYPE_SPARSE:
                    raise ArchiveError("sparse entries")
                yield m
    except tarfile.ReadError as e:
        if data.strip(b"\0"):
            raise ArchiveError(str(e)) from e


def absolute(name: bytes) -> bytes:
    """One slash in front, none behind; the root is empty."""
    path = b"/" + name.removeprefix(b"/")
    return b"" if path.rstrip(b"/") == b"" else path.rstrip(b"/")


def _stored(m: tarfile.TarInfo) -> bool:
    return m.isreg() and m.size > INLINE_MAX


def entries(data: bytes, algorithm: str = "sha256") -> Iterator[dict]:
    """Path, kind, stat, content or link of every entry in order."""
    raw = lambda s: os.fsencode(s) if isinstance(s, str) else s
    for n, m in enumerate(_members(data)):
        kind = _TYPES.get(m.type)
        if kind is None:
            raise ArchiveError(f"entry type {m.type!r}")
        body = data[m.offset_data : m.offset_data + m.size] if kind == "reg" else None
        if body is not None and len(body) < m.size:
            raise ArchiveError("the archive ends within an entry")
        target = raw(m.linkname) if kind == "lnk" else absolute(raw(m.linkname)) if kind == "hardlink" else None
        yield {
            "entry_idx": n,
            "path": absolute(raw(m.name)),
            "kind": kind,
            "mode": m.mode & 0o7777,
            "uid": m.uid,
            "gid": m.gid,
            "mtime": int(m.mtime),
            "size": m.size if kind == "reg" else 0,
            "rdev": os.makedev(m.devmajor, m.devminor) if kind in ("chr", "blk") else 0,
            "target": target,
            "inline": body if body is not None and not _stored(m) else None,
            "object_id": verity_bytes(body, algorithm).hex() if body is not None and _stored(m) else None,
            "xattrs": {raw(k.removeprefix(XATTR)): raw(v) for k, v in m.pax_headers.items() if k.startswith(XATTR)},
        }


def split(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(inline or external, bytes) of an archive, adjacent inline bytes joined. Contents of regular files over the inline limit
    are external; headers, padding and all else are inline."""
    at, held = 0, b""
    for m in _members(data):
        if _stored(m):
            if m.offset_data + m.size > len(data):
                raise ArchiveError("the archive ends within an entry")
            held += data[at : m.offset_data]
            if held:
                yield "inline", held
            held = b""
            yield "external", data[m.offset_data : m.offset_data + m.size]
            at = m.offset_data + m.size
    held += data[at:]
    if held:
        yield "inline", held


@functools.cache
def _blank() -> bytes:
    """The header of an empty file without a name, without the sum's digits."""
    head = tarfile.TarInfo("").tobuf(tarfile.USTAR_FORMAT)
    return head[:148] + b" " * 8 + head[156:]


def written(files: Iterator[tuple[str, bytes]]) -> bytes:
    """An archive of regular files, each a name and its content, byte for byte as ``tarfile`` writes it."""
    out, at = [], 0
    for name, body in files:
        raw, size = name.encode(), len(body)
        if name.isascii() and len(raw) <= tarfile.LENGTH_NAME and size < 1 << 33:
            head = b"".join((raw.ljust(100, b"\0"), _blank()[100:124], b"%011o\0" % size, _blank()[136:]))
            head = b"".join((head[:148], b"%06o\0 " % sum(head.replace(b"\0", b"")), head[156:]))
        else:
            member = tarfile.TarInfo(name)
            member.size = size
            head = member.tobuf(tarfile.PAX_FORMAT)
        out += [head, body, bytes(-size % tarfile.BLOCKSIZE)]
        at += len(head) + size + -size % tarfile.BLOCKSIZE
    at += 2 * tarfile.BLOCKSIZE
    return b"".join([*out, bytes(2 * tarfile.BLOCKSIZE + -at % tarfile.RECORDSIZE)])


ENTRY = "archive string, entry_idx long, path binary, kind string, mode int, uid long, gid long, mtime long, size long, rdev long, target binary, inline binary, object_id string, xattrs map<binary, binary>"


def entry_rows(files: DataFrame, key: str = "path", content: str = "content", algorithm: str = "sha256") -> DataFrame:
    """Entries of archives in (key, content)."""
    names = [x.strip().split(" ")[0] for x in ENTRY.replace("map<binary, binary>", "map").split(",")]
    other = dict.fromkeys(("archive", "kind", "object_id"), pa.string()) | dict.fromkeys(("path", "target", "inline"), pa.binary()) | {
        "mode": pa.int32(), "xattrs": pa.map_(pa.binary(), pa.binary())
    }
    kinds = {x: other.get(x, pa.int64()) for x in names}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for e in entries(data.as_py(), algorithm):
                    e |= {"archive": name, "xattrs": list(e["xattrs"].items())}
                    yield tuple(e[x] for x in names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), kinds)

    return files.select(F.col(key).cast("string"), content).mapInArrow(work, ENTRY)


def split_rows(files: DataFrame, key: str = "path", content: str = "content", algorithm: str = "sha256") -> DataFrame:
    """(stream_id, seq, kind, inline, object_id, size, data) of archives in (key, content): data are the bytes of external chunks."""

    kinds = dict(
        stream_id=pa.string(), seq=pa.int64(), kind=pa.string(), inline=pa.binary(), object_id=pa.string(), size=pa.int64(), data=pa.binary()
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, (kind, part) in enumerate(split(body.as_py())):
                    inner = kind == "inline"
                    yield (name, k, kind, part if inner else None, None if inner else verity_bytes(part, algorithm).hex(), len(part), None if inner else part)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), kinds)

    return files.select(F.col(key).cast("string"), content).mapInArrow(
        work, "stream_id string, seq long, kind string, inline binary, object_id string, size long, data binary"
    )


# Records of archives taken apart: NDJSON lines, type 1 for a file and type 2 for a segment of bytes.

#: CRC-64 by ISO 3309's polynomial, reflected, all ones before and after.
_POLYNOMIAL, _ONES = 0xD800000000000000, (1 << 64) - 1


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (_POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


_CRC = np.array(_crc_table(), np.uint64)
#: Bytes of a lane: as many lanes as a content has are worked on at once.
_LANE = 1024


def _steps(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The states of lanes after one byte of each column more."""
    for column in columns:
        state = _CRC[((state ^ column) & np.uint64(255)).astype(np.intp)] ^ (state >> np.uint64(8))
    return state


@functools.cache
def _lane_of_zeros() -> np.ndarray:
    """What a lane of zeros makes of a state, by the state's eight bytes: 8 x 256 words whose sum without carry is the new state."""
    bits = _steps(np.uint64(1) << np.arange(64, dtype=np.uint64), np.zeros((_LANE, 1), np.uint64))
    table = np.zeros((8, 256), np.uint64)
    for k in range(64):
        table[k // 8, (np.arange(256) >> k % 8 & 1).astype(bool)] ^= bits[k]
    return table


def crc64(data: bytes) -> int:
    whole = len(data) // _LANE
    state = _ONES
    if whole > 1:
        lanes = np.frombuffer(data, np.uint8, whole * _LANE).reshape(whole, _LANE).T.astype(np.uint64)
        table = _lane_of_zeros()
        # A checksum is linear: that of all that came before, led through a lane of zeros, and that of the lane alone add up.
        for part in _steps(np.zeros(whole, np.uint64), lanes).tolist():
            for k in range(8):
                part ^= int(table[k, state >> 8 * k & 255])
            state = part
        data = data[whole * _LANE :]
    for byte in data:
        state = int(_CRC[(state ^ byte) & 255]) ^ state >> 8
    return state ^ _ONES


def crc64_matches(data: bytes, expected: str) -> bool:
    """expected: eight bytes, big-endian, in base 64."""
    raw = base64.b64decode(expected)
    return len(raw) == 8 and int.from_bytes(raw, "big") == crc64(data)


def tar_split_lines(data: bytes) -> Iterator[str]:
    """The records of an archive: segments of headers and padding, and files by name, size and checksum."""
    at = position = 0

    def segment(part: bytes) -> str:
        nonlocal position
        position += 1
        return json.dumps({"type": 2, "payload": base64.b64encode(part).decode(), "position": position - 1})

    for m in _members(data):
        yield segment(data[at : m.offset_data])
        at = m.offset_data
        body = data[at : at + m.size] if m.isreg() else b""
        line = {"type": 1, "name": m.name, "position": position} | (
            {"size": len(body), "crc64": base64.b64encode(crc64(body).to_bytes(8, "big")).decode()} if body else {}
        )
        position += 1
        yield json.dumps(line)
        at += len(body)
    if at < len(data):
        yield segment(data[at:])


def from_tar_split(lines: Iterator[str], content_of) -> bytes:  # noqa: ANN001
    """The archive's bytes from its records and a function from a file's name to its content; sizes and checksums must hold."""
    out = []
    for text in lines:
        record = json.loads(text)
        if record["type"] == 2:
            out.append(base64.b64decode(record.get("payload") or ""))
        elif record["type"] == 1:
            if record.get("size"):
                body = content_of(record["name"].removeprefix("./"))
                if len(body) != record["size"] or ("crc64" in record and not crc64_matches(body, record["crc64"])):
                    raise ArchiveError(f"size or checksum of {record['name']}")
                out.append(body)
        else:
            raise ArchiveError(f"record type {record['type']}")
    return b"".join(out)


def sha256_id(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()
