"""A data source over directories: one row for each path with the metadata that Spark's binaryFile doesn't give.

    spark.dataSource.register(TreeSource)
    spark.read.format("granary_tree").load("/some/dir")

Top-level entries are dealt over partitions, so a large tree is walked in parallel. The path must be one that every executor sees.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.digest import verity_bytes
from ..schemas import INLINE_MAX

SCHEMA = "path binary, kind string, mode int, uid bigint, gid bigint, mtime bigint, size bigint, rdev bigint, dev bigint, ino bigint, target binary, inline binary, object_id string, xattrs map<binary, binary>"
_KINDS = {stat.S_IFDIR: "dir", stat.S_IFREG: "reg", stat.S_IFLNK: "lnk", stat.S_IFCHR: "chr", stat.S_IFBLK: "blk", stat.S_IFIFO: "fifo", stat.S_IFSOCK: "sock"}


def row(full: bytes, path: bytes) -> tuple:
    st = os.lstat(full)
    kind = _KINDS[stat.S_IFMT(st.st_mode)]
    inline = object_id = target = None
    if kind == "reg":
        with open(full, "rb") as f:
            data = f.read()
        inline, object_id = (data, None) if len(data) <= INLINE_MAX else (None, verity_bytes(data).hex())
    elif kind == "lnk":
        target = os.readlink(full)
    try:
        xattrs = {os.fsencode(n): os.getxattr(full, n, follow_symlinks=False) for n in os.listxattr(full, follow_symlinks=False)}
    except OSError:
        xattrs = {}
    return (
        path,
        kind,
        stat.S_IMODE(st.st_mode),
        st.st_uid,
        st.st_gid,
        int(st.st_mtime // 1),
        st.st_size if kind in ("reg", "lnk") else 0,
        st.st_rdev if kind in ("chr", "blk") else 0,
        st.st_dev,
        st.st_ino,
        target,
        inline,
        object_id,
        xattrs,
    )


def walk(root: bytes, below: bytes) -> Iterator[tuple]:
    """The rows of a path and all below it, each directory before its children, names in byte order."""
    full = root + below if below != b"/" else root
    yield row(full, below)
    if stat.S_ISDIR(os.lstat(full).st_mode):
        for name in sorted(os.listdir(full)):
            yield from walk(root, below.rstrip(b"/") + b"/" + name)


class Part(InputPartition):
    def __init__(self, names: list[bytes]):
        self.names = names


class TreeReader(DataSourceReader):
    def __init__(self, root: str, parts: int):
        self.root, self.parts = os.fsencode(root.removeprefix("file://").rstrip("/") or "/"), parts

    def partitions(self) -> list[Part]:
        names = [b"/" + n for n in sorted(os.listdir(self.root))]
        return [Part([])] + [Part(names[k :: self.parts]) for k in range(min(self.parts, len(names)))]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.names:
            yield row(self.root, b"/")
        for name in part.names:
            yield from walk(self.root, name)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "granary_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(self.options["path"], int(self.options.get("partitions", 8)))


def write_rows(rows: DataFrame, path: str) -> int:
    """rows (path, kind, mode, target, content) as a tree below a folder that every executor shares; the number of files. Devices and
    sockets, which need privileges, are left out. A task that runs again writes the same files."""
    root = os.fsencode(path.removeprefix("file://").rstrip("/"))

    def write(part: Iterator) -> None:  # noqa: ANN001
        for r in part:
            at = root + bytes(r.path).rstrip(b"/")
            if r.kind == "dir":
                os.makedirs(at, exist_ok=True)
            elif r.kind == "reg":
                draft = at + b".draft-%d" % os.getpid()
                with open(draft, "wb") as f:
                    f.write(bytes(r.content or b""))
                os.chmod(draft, r.mode & 0o777)
                os.replace(draft, at)
            elif r.kind == "lnk" and not os.path.lexists(at):
                os.symlink(bytes(r.target), at)

    dirs = rows.filter("kind = 'dir'")
    dirs.select("path", "kind").foreachPartition(write)
    files = rows.filter(F.col("kind").isin("reg", "lnk")).select("path", "kind", "mode", "target", "content")
    files.foreachPartition(write)
    return files.count()
