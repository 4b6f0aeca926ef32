"""File system images: a tree's rows to bytes and back.

Encoding plans first and writes once. A plan holds the inodes in depth-first order, names in byte order, each with the size of its
metadata; places follow from the sizes alone, as every reference has a fixed width. Metadata of files kept as objects are two overlay
attributes, the object's digest and its path. Images are deterministic to the byte.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import ALGORITHMS

#: Fixed values of the format.
BLOCK, NID, TAIL = 4096, 32, 2048
HEADER_MAGIC, HEADER_VERSION, LAYOUT_VERSION, MAGIC = 0xD078629A, 1, 2, 0xE0F5E1E2
MTIME, XATTR_FILTER = 0x2, 0x4
SUPER = struct.Struct("<IIIBBHQQIIII16s16sIHHHBBIQB23s")
INODE, COMPACT = struct.Struct("<HHHHQIIIIQII16s"), struct.Struct("<HHHHIIIIHHI")
DIRENT, XATTR, XATTR_HEAD = struct.Struct("<QHBB"), struct.Struct("<BBH"), struct.Struct("<IB7s")
PLAIN, INLINE, CHUNKED, EXTENDED = 0, 4, 8, 1
PREFIXES = (b"", b"user.", b"system.posix_acl_access", b"system.posix_acl_default", b"trusted.", b"lustre.", b"security.")
FILTER_SEED = 0x25BBE08F
TYPES = {
    "reg": (1, 0o100000), "dir": (2, 0o040000), "chr": (3, 0o020000), "blk": (4, 0o060000), "fifo": (5, 0o010000), "sock": (6, 0o140000), "lnk": (7, 0o120000)
}
METACOPY, REDIRECT, OVERLAY = b"trusted.overlay.metacopy", b"trusted.overlay.redirect", b"trusted.overlay."
IMAGE_MAX, DEPTH_MAX = 1 << 30, 2048


class ImageError(ValueError):
    """An image that breaks a rule of the format."""


@dataclass
class Node:
    """A path's inode. Directories have children; other kinds hold what their kind says."""

    kind: str
    mode: int = 0
    uid: int = 0
    gid: int = 0
    mtime: int = 0
    xattrs: dict[bytes, bytes] = field(default_factory=dict)
    inline: bytes | None = None
    object_id: str | None = None
    size: int = 0
    rdev: int = 0
    target: bytes = b""
    children: dict[bytes, Node] = field(default_factory=dict)


def up(n: int, to: int) -> int:
    return -(-n // to) * to


def split_name(name: bytes) -> tuple[int, bytes]:
    """Number of the longest known prefix, and the rest. The last listed that fits is the longest."""
    number = max(k for k, p in enumerate(PREFIXES) if name.startswith(p))
    return number, name[len(PREFIXES[number]) :]


def filter_bit(number: int, suffix: bytes) -> int:
    return 1 << xxhash.xxh32_intdigest(suffix, FILTER_SEED + number) % 32


@dataclass
class _Inode:
    node: Node
    nlink: int = 0
    xattrs: list[tuple[int, bytes, bytes]] = field(default_factory=list)
    shared: list[int] = field(default_factory=list)
    local: list[tuple[int, bytes, bytes]] = field(default_factory=list)
    blocks: list[list[tuple[bytes, int]]] = field(default_factory=list)
    tail: list[tuple[bytes, int]] = field(default_factory=list)
    layout: int = PLAIN
    size: int = 0
    at: int = 0
    block_at: int = 0

    def meta_size(self) -> int:
        return XATTR_HEAD.size + 4 * len(self.shared) + sum(up(XATTR.size + len(s) + len(v), 4) for _, s, v in self.local) if self.xattrs else 0


def _attributes(node: Node, algorithm: str) -> list[tuple[int, bytes, bytes]]:
    out = []
    if node.object_id is not None:
        digest = bytes.fromhex(node.object_id)
        out.append((METACOPY, struct.pack("<BBBB", 0, 4 + len(digest), 0, ALGORITHMS[algorithm][0]) + digest))
        out.append((REDIRECT, f"/{node.object_id[:2]}/{node.object_id[2:]}".encode()))
    for name, value in sorted(node.xattrs.items()):
        out.append((OVERLAY + b"overlay." + name.removeprefix(OVERLAY) if name.startswith(OVERLAY) else name, value))
    return [(*split_name(n), v) for n, v in out]


def _pack_entries(entries: list[tuple[bytes, int]]) -> tuple[list, list, int]:
    """Directory entries in blocks, those of a tail, and the directory's size."""
    blocks, now, used = [], [], 0
    for name, number in entries:
        need = DIRENT.size + len(name)
        if used + need > BLOCK:
            blocks.append(now)
            now, used = [], 0
        now.append((name, number))
        used += need
    if used > TAIL:
        blocks.append(now)
        now, used = [], 0
    return blocks, now, BLOCK * len(blocks) + used


def encode(root: Node, algorithm: str = "sha256") -> bytes:
    """The image of a tree. Paths that share a Node are hard links."""
    if root.kind != "dir":
        raise ImageError("the root is no directory")
    inodes: list[_Inode] = []
    number: dict[int, int] = {}
    links: Counter[int] = Counter()
    # Depth-first: a directory's number comes before its children's.
    plan: list[tuple[int, int, list[tuple[bytes, int]]]] = []

    def visit(node: Node, parent: int | None) -> int:
        me = len(inodes)
        number[id(node)] = me
        inodes.append(_Inode(node, xattrs=_attributes(node, algorithm)))
        entries: list[tuple[bytes, int]] = []
        plan.append((me, me if parent is None else parent, entries))
        stack = [(me, iter(sorted(node.children.items())), entries)]
        while stack:
            here, rest, found = stack[-1]
            name, child = next(rest, (None, None))
            if child is None:
                stack.pop()
                continue
            if child.kind == "dir":
                k = len(inodes)
                inodes.append(_Inode(child, xattrs=_attributes(child, algorithm)))
                inner: list[tuple[bytes, int]] = []
                plan.append((k, here, inner))
                stack.append((k, iter(sorted(child.children.items())), inner))
            else:
                links[id(child)] += 1
                k = number.setdefault(id(child), len(inodes))
                if k == len(inodes):
                    inodes.append(_Inode(child, xattrs=_attributes(child, algorithm)))
            found.append((name, k))
        return me

    visit(root, None)
    for me, parent, entries in plan:
        i = inodes[me]
        every = sorted([*entries, (b".", me), (b"..", parent)], key=lambda e: e[0])
        i.nlink = sum(inodes[k].node.kind == "dir" for _, k in every)
        i.blocks, i.tail, i.size = _pack_entries(every)
        i.layout = INLINE if i.tail else PLAIN
    for i in inodes:
        n = i.node
        if n.kind != "dir":
            i.nlink = links[id(n)]
        if n.kind == "reg":
            i.layout, i.size = (CHUNKED, n.size) if n.object_id is not None else (INLINE if n.inline else PLAIN, len(n.inline or b""))
        elif n.kind == "lnk":
            if len(n.target) > 1024:
                raise ImageError("a symbolic link's target is too long")
            i.layout, i.size = INLINE, len(n.target)
    # Attributes that more than one inode has are kept once, in order.
    uses = Counter(x for i in inodes for x in i.xattrs)
    shared = {x: k for k, x in enumerate(sorted(x for x, n in uses.items() if n > 1))}
    for i in inodes:
        i.shared, i.local = [shared[x] for x in i.xattrs if x in shared], [x for x in i.xattrs if x not in shared]
    # Places.
    at = 1024 + SUPER.size
    for i in inodes:
        at = up(at, NID)
        head = INODE.size + i.meta_size()
        if i.layout == INLINE:
            # Inline data must not cross into another block than the metadata's last byte.
            last = at + head - 1
            if last // BLOCK != (last + 1 + i.size % BLOCK) // BLOCK:
                at = up(at + BLOCK - last % BLOCK, NID)
        i.at = at
        at = up(at + head + (4 if i.layout == CHUNKED else i.size % BLOCK if i.layout == INLINE else 0), NID)
    places = []
    for _, suffix, value in shared:
        places.append(at)
        at += up(XATTR.size + len(suffix) + len(value), 4)
    at = up(at, BLOCK)
    for i in inodes:
        i.block_at = at
        at += BLOCK * len(i.blocks)
    # Bytes.
    out = bytearray(at)
    struct.pack_into("<IIII", out, 0, HEADER_MAGIC, HEADER_VERSION, 0, LAYOUT_VERSION)
    SUPER.pack_into(
        out, 1024, MAGIC, 0, MTIME | XATTR_FILTER, 12, 0, inodes[0].at // NID, len(inodes), 0, 0, at // BLOCK, 0, 0, b"", b"", 0, 0, 0, 0, 0, 0, 0, 0, 0, b""
    )

    def attribute(x: tuple[int, bytes, bytes]) -> bytes:
        prefix, suffix, value = x
        body = XATTR.pack(len(suffix), prefix, len(value)) + suffix + value
        return body.ljust(up(len(body), 4), b"\0")

    def entries_of(part: list[tuple[bytes, int]]) -> bytes:
        names, heads = DIRENT.size * len(part), []
        for name, k in part:
            heads.append(DIRENT.pack(inodes[k].at // NID, names, TYPES[inodes[k].node.kind][0], 0))
            names += len(name)
        return b"".join(heads) + b"".join(n for n, _ in part)

    for i in inodes:
        n, meta = i.node, i.meta_size()
        u = i.block_at // BLOCK if n.kind == "dir" and (
            i.blocks or not i.tail
        ) else 31 if i.layout == CHUNKED else n.rdev & 0xFFFFFFFF if n.kind in ("chr", "blk") else 0
        count = 1 + (meta - XATTR_HEAD.size) // 4 if meta else 0
        body = INODE.pack(
            EXTENDED | i.layout, count, TYPES[n.kind][1] | n.mode & 0xFFFF, 0, i.size, u, i.at // NID, n.uid, n.gid, n.mtime & (1 << 64) - 1, 0, i.nlink, b""
        )
        if meta:
            bits = 0
            for prefix, suffix, _ in i.xattrs:
                bits |= filter_bit(prefix, suffix)
            body += XATTR_HEAD.pack(~bits & 0xFFFFFFFF, len(i.shared), b"") + b"".join(struct.pack("<I", places[k] // 4) for k in i.shared) + b"".join(
                map(attribute, i.local)
            )
        body += entries_of(i.tail) if n.kind == "dir" else b"\xff" * 4 if i.layout == CHUNKED else n.target if n.kind == "lnk" else n.inline or b"" if n.kind == "reg" else b""
        out[i.at : i.at + len(body)] = body
        for k, part in enumerate(i.blocks):
            packed = entries_of(part)
            out[i.block_at + BLOCK * k : i.block_at + BLOCK * k + len(packed)] = packed
    for x, place in zip(shared, places, strict=True):
        body = attribute(x)
        out[place : place + len(body)] = body
    return bytes(out)


class Image:
    """Random access to an image's inodes by number."""

    def __init__(self, data: bytes, most: int = IMAGE_MAX):
        if len(data) > most:
            raise ImageError("too large an image")
        self.data = data
        try:
            head = struct.unpack_from("<IIII", data, 0)
            sb = SUPER.unpack_from(data, 1024)
        except struct.error as e:
            raise ImageError("too short an image") from e
        if sb[0] != MAGIC or sb[3] != 12:
            raise ImageError("magic or block size")
        self.ours = head[0] == HEADER_MAGIC and head[1] == HEADER_VERSION
        # What was cut off may have been padding alone, and all that is read may still be there.
        if len(data) < sb[9] * BLOCK:
            raise ImageError("shorter than its blocks")
        self.features, self.root, self.inodes, self.blocks, self.meta_block, self.xattr_block, self.incompatible = sb[2], sb[5], sb[6], sb[9], sb[10], sb[11], sb[14]

    def strict(self) -> Image:
        """Refuses what this module's writer never makes."""
        if not self.ours or self.meta_block or self.xattr_block or self.incompatible or self.features & ~(1 | MTIME | XATTR_FILTER):
            raise ImageError("header or features")
        return self

    def part(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > len(self.data):
            raise ImageError("a place outside the image")
        return self.data[at : at + size]

    def inode(self, nid: int) -> dict:
        at = self.meta_block * BLOCK + nid * NID
        kind = struct.unpack("<H", self.part(at, 2))[0]
        if kind & 1:
            _, count, mode, _, size, u, _, uid, gid, mtime, _, nlink, _ = INODE.unpack(self.part(at, INODE.size))
            start = at + INODE.size
        else:
            _, count, mode, nlink, size, _, u, _, uid, gid, _ = COMPACT.unpack(self.part(at, COMPACT.size))
            mtime, start = 0, at + COMPACT.size
        layout = kind & 0b1110
        if layout not in (PLAIN, INLINE, CHUNKED):
            raise ImageError("a data layout")
        meta = XATTR_HEAD.size + 4 * (count - 1) if count else 0
        name = next((k for k, v in TYPES.items() if v[1] == mode & 0o170000), None)
        if name is None:
            raise ImageError("a file type")
        return {
            "nid": nid,
            "kind": name,
            "mode": mode & 0o7777,
            "size": size,
            "u": u,
            "uid": uid,
            "gid": gid,
            "mtime": mtime - (1 << 64) if mtime >> 63 else mtime,
            "nlink": nlink,
            "layout": layout,
            "meta": (start, meta),
            "tail_at": start + meta,
        }

    def _attribute(self, at: int) -> tuple[bytes, bytes, int]:
        n, prefix, size = XATTR.unpack(self.part(at, XATTR.size))
        if prefix >= len(PREFIXES):
            raise ImageError("an attribute's prefix")
        body = self.part(at + XATTR.size, n + size)
        return PREFIXES[prefix] + body[:n], body[n:], up(XATTR.size + n + size, 4)

    def xattrs(self, inode: dict) -> list[tuple[bytes, bytes]]:
        start, size = inode["meta"]
        if not size:
            return []
        _, shared, _ = XATTR_HEAD.unpack(self.part(start, XATTR_HEAD.size))
        at, end = start + XATTR_HEAD.size, start + size
        out = []
        for _ in range(shared):
            name, value, _ = self._attribute(self.xattr_block * BLOCK + 4 * struct.unpack("<I", self.part(at, 4))[0])
            out.append((name, value))
            at += 4
        while at < end:
            name, value, n = self._attribute(at)
            out.append((name, value))
            at += n
        if at != end:
            raise ImageError("attributes beyond their space")
        return out

    def content(self, inode: dict) -> list[bytes]:
        """The blocks of an inode's data, the tail last."""
        if inode["layout"] == CHUNKED:
            return []
        full, tail = divmod(inode["size"], BLOCK)
        if inode["layout"] == PLAIN:
            return [self.part((inode["u"] + k) * BLOCK, min(BLOCK, inode["size"] - k * BLOCK)) for k in range(full + (tail > 0))]
        blocks = [self.part((inode["u"] + k) * BLOCK, BLOCK) for k in range(full)]
        return blocks + ([self.part(inode["tail_at"], tail)] if tail else [])

    def entries(self, inode: dict) -> Iterator[tuple[bytes, int, int]]:
        """Name, number and type of a directory's entries."""
        for block in self.content(inode):
            first = DIRENT.unpack_from(block)[1] if len(block) >= DIRENT.size else 0
            if first % DIRENT.size or not DIRENT.size <= first <= len(block):
                raise ImageError("a directory block")
            heads = [DIRENT.unpack_from(block, k) for k in range(0, first, DIRENT.size)]
            ends = [h[1] for h in heads[1:]] + [len(block)]
            for (nid, at, kind, _), end in zip(heads, ends, strict=True):
                if not first <= at <= end <= len(block):
                    raise ImageError("a name's place")
                name = block[at:end]
                yield name.rstrip(b"\0") if end == len(block) else name, nid, kind

    def child(self, nid: int, name: bytes) -> int | None:
        return next((n for x, n, _ in self.entries(self.inode(nid)) if x == name), None)


def metacopy(value: bytes, algorithm: str = "sha256") -> str | None:
    number, size, _ = ALGORITHMS[algorithm]
    return value[4:].hex() if len(value) == 4 + size and value[:4] == bytes([0, 4 + size, 0, number]) else None


def decode(data: bytes, algorithm: str = "sha256", strict: bool = True) -> Node:
    """The tree of an image. Link counts, the dot entries, names and depth are checked."""
    image = Image(data)
    if strict:
        image.strict()
    seen: dict[int, Node] = {}
    links: Counter[int] = Counter()
    counts: dict[int, int] = {}

    def node_of(nid: int) -> Node:
        i = image.inode(nid)
        counts[nid] = i["nlink"]
        n = Node(i["kind"], i["mode"], i["uid"], i["gid"], i["mtime"])
        for name, value in image.xattrs(i):
            if name == METACOPY:
                n.object_id = n.object_id or metacopy(value, algorithm)
                if n.object_id is None and strict:
                    raise ImageError("a metacopy attribute")
            elif name.startswith(OVERLAY + b"overlay."):
                n.xattrs[OVERLAY + name.removeprefix(OVERLAY + b"overlay.")] = value
            elif not name.startswith(OVERLAY):
                n.xattrs[name] = value
        if n.kind == "reg":
            n.size = i["size"]
            if n.object_id is None:
                n.inline = b"".join(image.content(i))
                if i["layout"] == CHUNKED:
                    raise ImageError("a file without content")
        elif n.kind == "lnk":
            n.target = b"".join(image.content(i))
        elif n.kind in ("chr", "blk"):
            n.rdev = i["u"]
        return n

    root = node_of(image.root)
    if root.kind != "dir":
        raise ImageError("the root is no directory")
    open_dirs = [(image.root, image.root, root, 1)]
    visited = {image.root}
    while open_dirs:
        nid, parent, node, depth = open_dirs.pop()
        if depth > DEPTH_MAX:
            raise ImageError("too deep")
        dots, subdirs, last = {}, 0, None
        for name, k, kind in image.entries(image.inode(nid)):
            if last is not None and name <= last:
                raise ImageError("names out of order or twice")
            last = name
            if name in (b".", b".."):
                dots[name] = k
                continue
            if not name or b"/" in name or b"\0" in name or len(name) > 255:
                raise ImageError("a name")
            if k in seen:
                child = seen[k]
            else:
                child = node_of(k)
                if child.kind == "dir":
                    if k in visited:
                        raise ImageError("a directory with two parents")
                    visited.add(k)
                    open_dirs.append((k, nid, child, depth + 1))
                else:
                    seen[k] = child
            if TYPES[child.kind][0] != kind:
                raise ImageError("an entry of another type")
            if child.kind == "dir":
                subdirs += 1
            else:
                links[k] += 1
            node.children[name] = child
        if dots != {b".": nid, b"..": parent} or counts[nid] != 2 + subdirs:
            raise ImageError("dot entries or links of a directory")
    if any(counts[k] != n for k, n in links.items()):
        raise ImageError("links of a file")
    return root


def rows_of(root: Node) -> Iterator[tuple[bytes, Node, int | None]]:
    """Path, inode and leaf number in tree order; hard links share a number."""
    numbers: dict[int, int] = {}
    stack = [(b"/", root)]
    while stack:
        path, node = stack.pop()
        yield path, node, None if node.kind == "dir" else numbers.setdefault(id(node), len(numbers))
        stack += [(path.rstrip(b"/") + b"/" + name, child) for name, child in sorted(node.children.items(), reverse=True)]


def tree_of(rows: Iterator[dict]) -> Node:
    """The tree of rows with path and Node's fields; rows of one leaf_id are one inode."""
    nodes: dict[bytes, Node] = {}
    leaves: dict[int, Node] = {}
    for r in sorted(rows, key=lambda r: [x for x in r["path"].split(b"/") if x]):
        values = {k: r[k] for k in ("kind", "mode", "uid", "gid", "mtime", "xattrs", "inline", "object_id", "size", "rdev", "target") if r.get(k) is not None}
        node = Node(**values)
        if r.get("leaf_id") is not None:
            node = leaves.setdefault(r["leaf_id"], node)
        nodes[r["path"]] = node
        if r["path"] != b"/":
            above, _, name = r["path"].rpartition(b"/")
            parent = nodes.get(above or b"/")
            if parent is None or parent.kind != "dir":
                raise ImageError(f"no parent directory of {r['path']!r}")
            parent.children[name] = node
    if b"/" not in nodes:
        raise ImageError("no root")
    return nodes[b"/"]


ENTRY = "image_id string, path binary, kind string, leaf_id long, mode int, uid long, gid long, mtime long, size long, rdev long, target binary, inline binary, object_id string, xattrs map<binary, binary>, error string"


def entry_rows(images: DataFrame, key: str = "image_id", content: str = "content", algorithm: str = "sha256") -> DataFrame:
    """The entries of images in (key, content). An image that can't be read is one row with an error."""
    names = [x.strip().split(" ")[0] for x in ENTRY.replace("map<binary, binary>", "map").split(",")]
    kinds = dict.fromkeys(("image_id", "kind", "object_id", "error"), pa.string()) | dict.fromkeys(("path", "target", "inline"), pa.binary()) | {
        "mode": pa.int32(), "xattrs": pa.map_(pa.binary(), pa.binary())
    }

    plain = ("kind", "mode", "uid", "gid", "mtime", "size", "rdev", "inline", "object_id")

    def rows_in(name: str, data: bytes | None) -> list[dict]:
        try:
            found = list(rows_of(decode(data or b"", algorithm)))
        except ImageError as e:
            return [{"image_id": name, "error": str(e)}]
        return [
            {"image_id": name, "path": p, "leaf_id": k, "xattrs": list(n.xattrs.items()), "target": n.target or None} | {
                x: getattr(n, x) for x in plain
            } for p, n, k in found
        ]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = rows_in(name, data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r.get(x) for r in rows], kinds.get(x, pa.int64())) for x in names], names)

    return images.select(F.col(key).cast("string"), content).mapInArrow(work, ENTRY)


def problems(images: DataFrame, key: str = "image_id", content: str = "content", algorithm: str = "sha256") -> DataFrame:
    """(key, error) of images that can't be read."""
    return entry_rows(images, key, content, algorithm).filter("error is not null").select(F.col("image_id").alias(key), "error")


def image_objects(images: DataFrame, key: str = "image_id", content: str = "content", algorithm: str = "sha256") -> DataFrame:
    """(key, object_id) of the objects that images name, each once."""
    return entry_rows(images, key, content, algorithm).filter("object_id is not null").select(F.col("image_id").alias(key), "object_id").distinct()


def image_rows(entries: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """(image_id, content) for the trees of entries. An image is one value, so its tree fits in one row."""
    fields = [x for x in entries.columns if x != "image_id"]

    def one(rows: list) -> bytes:
        plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
        return encode(
            tree_of([{k: {bytes(a): bytes(b) for a, b in v.items()} if k == "xattrs" and v else plain(v) for k, v in r.asDict().items()} for r in rows]),
            algorithm,
        )

    grouped = entries.groupBy("image_id").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    return grouped.select("image_id", F.udf(one, "binary", useArrow=False)("rows").alias("content"))
