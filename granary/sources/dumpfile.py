"""Trees as text: one line for each path, fields between single spaces, bytes escaped.

path size mode nlink uid gid rdev mtime payload content digest [key=value ...]. A dash is an absent field; a mode after @ marks a hard
link to the payload. Files are read whole by executors, lines keep their number, and a line that breaks a rule is a row with its error.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..schemas import DUMP, INLINE_READ_MAX, PATH_MAX, SYMLINK_MAX, XATTR_NAME_MAX, XATTR_VALUE_MAX

NAMED = {0x5C: "\\\\", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"}
_PLAIN = {b: chr(b) if 0x21 <= b <= 0x7E and b != 0x5C else NAMED.get(b, f"\\x{b:02x}") for b in range(256)}
_BACK = {"\\": b"\\", "n": b"\n", "r": b"\r", "t": b"\t"}
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|.|\Z)", re.S)
KINDS = {0o04: "dir", 0o10: "reg", 0o12: "lnk", 0o02: "chr", 0o06: "blk", 0o01: "fifo", 0o14: "sock"}


class LineError(ValueError):
    """What is wrong with a line."""


def escape(data: bytes, equals: bool = False, optional: bool = True) -> str:
    """optional: empty is a dash, and a lone dash is written as its code. equals: = is escaped, as in attributes."""
    if optional and not data:
        return "-"
    if optional and data == b"-":
        return "\\x2d"
    text = "".join(map(_PLAIN.__getitem__, data))
    return text.replace("=", "\\x3d") if equals else text


def unescape(text: str, most: int | None = None) -> bytes:
    out, at = [], 0
    for m in _ESCAPE.finditer(text):
        out.append(text[at : m.start()].encode())
        code = m[1]
        if code[:1] == "x" and len(code) == 3:
            out.append(bytes([int(code[1:], 16)]))
        elif code in _BACK:
            out.append(_BACK[code])
        else:
            raise LineError(f"escape \\{code}")
        at = m.end()
    out.append(text[at:].encode())
    data = b"".join(out)
    if most is not None and len(data) > most:
        raise LineError(f"longer than {most} bytes")
    return data


def path_bytes(text: str, canonical: bool = True) -> bytes:
    data = unescape(text)
    if b"\0" in data or not data or len(data) > PATH_MAX:
        raise LineError("path is empty, too long or has a NUL")
    if canonical:
        first, *rest = data.split(b"/")
        if first or not rest:
            raise LineError("path is not absolute")
        if data != b"/" and any(x in (b"", b".", b"..") for x in rest):
            raise LineError("path is not canonical")
    return data


def number(text: str, what: str, base: int = 10, below: int = 1 << 64) -> int:
    if not re.fullmatch(r"\+?[0-9]+" if base == 10 else r"\+?[0-7]+", text) or int(text, base) >= below:
        raise LineError(f"{what} {text!r}")
    return int(text, base)


def attribute(text: str) -> tuple[bytes, bytes]:
    key, found, value = text.partition("=")
    if not found:
        raise LineError("attribute without =")
    name, data = unescape(key), unescape(value)
    if b"\0" in name or len(name) > XATTR_NAME_MAX or len(data) > XATTR_VALUE_MAX:
        raise LineError("attribute name or value")
    return name, data


def parse(line: str) -> dict:
    """The fields of a line; path, kind-specific rules and limits checked."""
    fields = line.split(" ")
    if len(fields) < 11 and not (len(fields) >= 9 and "@" in fields[2]):
        raise LineError("too few fields")
    path, size, mode_text = path_bytes(fields[0]), number(fields[1], "size"), fields[2]
    link = "@" in mode_text
    mode = number(mode_text.partition("@")[2] if link else mode_text, "mode", 8, 1 << 32)
    kind = KINDS.get(mode >> 12)
    optional = lambda x: None if x == "-" else x
    out = dict.fromkeys(("nlink", "uid", "gid", "rdev", "mtime_sec", "mtime_nsec", "payload", "content", "digest"), None)
    out |= {"path": path, "size": size, "mode": mode, "xattrs": {}, "hardlink": link}
    payload = optional(fields[8])
    if link:
        if kind == "dir":
            raise LineError("a hard link to a directory")
        if payload is None:
            raise LineError("a hard link without payload")
        return out | {"size": 0, "mode": 0, "payload": path_bytes(payload)}
    for name, text, below in zip(("nlink", "uid", "gid", "rdev"), fields[3:7], (1 << 32, 1 << 32, 1 << 32, 1 << 64), strict=True):
        out[name] = number(text, name, below=below)
    sec, dot, nsec = fields[7].partition(".")
    if not dot:
        raise LineError("mtime without a dot")
    out["mtime_sec"], out["mtime_nsec"] = number(sec, "mtime"), number(nsec, "mtime")
    content, out["digest"] = optional(fields[9]), optional(fields[10])
    pairs = [attribute(x) for x in fields[11:]]
    if sum(len(k) for k, _ in pairs) > XATTR_VALUE_MAX:
        raise LineError("too many attributes")
    out["xattrs"] = dict(sorted(pairs))
    if kind is None or kind == "sock":
        raise LineError(f"file type of mode {mode:o}")
    if kind not in ("chr", "blk") and out["rdev"]:
        raise LineError("a device number on no device")
    if kind != "reg" and (content is not None or out["digest"] is not None):
        raise LineError("content or digest on no regular file")
    if kind == "reg" and payload is not None:
        out["payload"] = path_bytes(payload, canonical=False)
    elif kind == "reg":
        if out["digest"] is not None:
            raise LineError("a digest on inline content")
        out["content"] = unescape(content or "", INLINE_READ_MAX)
        out["size"] = len(out["content"])
    elif kind == "lnk":
        if payload is None:
            raise LineError("a symbolic link without target")
        out["payload"] = path_bytes(payload, canonical=False)
        if len(out["payload"]) > SYMLINK_MAX:
            raise LineError("a symbolic link's target is too long")
    return out


def line(
    path: bytes,
    mode: int,
    size: int,
    nlink: int,
    uid: int,
    gid: int,
    rdev: int,
    mtime: int,
    payload: bytes = b"",
    content: bytes = b"",
    digest: str | None = None,
    xattrs: dict[bytes, bytes] | None = None,
) -> str:
    attributes = [f"{escape(k, True, False)}={escape(v, True, False)}" for k, v in sorted((xattrs or {}).items())]
    return " ".join(
        [
            escape(path),
            str(size),
            f"{mode:o}",
            str(nlink),
            str(uid),
            str(gid),
            str(rdev),
            f"{mtime}.0",
            escape(payload),
            escape(content),
            digest or "-",
            *attributes,
        ]
    )


def link_line(path: bytes, target: bytes) -> str:
    return f"{escape(path)} 0 @120000 - - - - 0.0 {escape(target)} - -"


DUMP_NAMES = [x.strip().split(" ")[0] for x in re.sub(r"map<[^>]*>", "map", DUMP).split(",")][1:]
DUMP_STRUCT = "struct<" + ", ".join(f"{a}: {b}" for a, b in (x.strip().split(" ", 1) for x in re.split(r",(?![^<]*>)", DUMP)) if a != "line_no") + ">"


def _row(value: str) -> tuple:
    try:
        got = parse(value) | {"error": None}
    except LineError as e:
        got = dict.fromkeys(DUMP_NAMES) | {"error": str(e)}
    return tuple(got[x] for x in DUMP_NAMES)


def parsed(lines: DataFrame, text: str = "value") -> DataFrame:
    """lines (line_no, and any columns more) with DUMP's other columns in place of the text; blank lines go."""
    row = F.udf(_row, DUMP_STRUCT, useArrow=False)
    others = [x for x in lines.columns if x != text]
    rows = lines.filter(F.trim(text) != "").select(*others, row(text).alias("_row"))
    return rows.select(*others, *(F.col(f"_row.{x}").alias(x) for x in DUMP_NAMES))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All dump files under a path: file, line_no and DUMP's other columns. Executors read the files, one task each."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("n", "value"))
    return parsed(lines.select("file", F.col("n").cast("long").alias("line_no"), "value"))


def tree_errors(rows: DataFrame) -> DataFrame:
    """(line_no, error) of lines that do not fit together: the first is no root, a parent is missing or no directory, a hard link's
    target is no leaf of an earlier line."""
    text = rows.withColumn("p", F.col("path").cast("string")).filter("error is null")
    is_dir = ~F.col("hardlink") & (F.shiftright("mode", 12) == 4)
    known = text.select(F.col("p").alias("known"), F.col("line_no").alias("known_line"), is_dir.alias("known_dir"))
    first = text.agg(F.min_by("p", "line_no").alias("p"), F.min("line_no").alias("line_no")).filter("p <> '/'").select(
        "line_no", F.lit("the first line is not the root").alias("error")
    )
    need = text.filter("p <> '/'").withColumn("above", paths.parent(F.col("p")))
    ok = need.join(known.filter("known_dir"), (F.col("above") == F.col("known")) & (F.col("known_line") < F.col("line_no")), "left_anti").select(
        "line_no", F.lit("no parent directory").alias("error")
    )
    links = text.filter("hardlink").withColumn("target", F.col("payload").cast("string"))
    lost = links.join(known.filter("not known_dir"), (F.col("target") == F.col("known")) & (F.col("known_line") < F.col("line_no")), "left_anti").select(
        "line_no", F.lit("no target").alias("error")
    )
    return rows.filter("error is not null").select("line_no", "error").unionAll(first).unionAll(ok).unionAll(lost)


def lines_of(rows: DataFrame) -> Column:
    """The line of each row of DUMP's columns, as a string column."""
    make = F.udf(
        lambda r: link_line(bytes(r.path), bytes(r.payload)) if r.hardlink else line(
            bytes(r.path),
            r.mode,
            r.size,
            r.nlink,
            r.uid,
            r.gid,
            r.rdev,
            r.mtime_sec,
            bytes(r.payload or b""),
            bytes(r.content or b""),
            r.digest,
            {bytes(k): bytes(v) for k, v in (r.xattrs or {}).items()},
        ), "string"
    )
    return make(F.struct(*rows.columns))


def write(rows: DataFrame, path: str) -> None:
    """One text in tree order, in as many part files as range partitions give, to be read in the order of their names."""
    ordered = rows.withColumn("_parts", paths.parts(F.col("path").cast("string"))).withColumn("value", lines_of(rows))
    ordered.repartitionByRange("_parts").sortWithinPartitions("_parts").select("value").write.text(path)
