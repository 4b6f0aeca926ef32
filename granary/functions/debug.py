"""What is where in an image: segments, gaps, space by kind, hex dumps."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import erofs


def hexdump(data: bytes, start: int = 0) -> str:
    """Sixteen bytes a line, by offset, with what is printable."""
    out = []
    for at in range(0, len(data), 16):
        part = data[at : at + 16]
        digits = " ".join(part[k : k + 8].hex(" ") for k in (0, 8) if part[k:])
        out.append(f"{start + at:08x}  {digits:<47}  |{''.join(chr(b) if 32 <= b < 127 else '.' for b in part)}|")
    return "\n".join(out)


def segments(data: bytes) -> list[tuple[int, int, str, list[bytes]]]:
    """(offset, size, kind, paths) of all that an image's metadata reaches. One place with two kinds is an error."""
    image = erofs.Image(data).strict()
    found: dict[int, tuple[int, str]] = {0: (32, "header"), 1024: (erofs.SUPER.size, "superblock")}
    paths: dict[int, list[bytes]] = defaultdict(list)

    def note(at: int, size: int, kind: str, path: bytes) -> None:
        if size and found.setdefault(at, (size, kind)) != (size, kind):
            raise erofs.ImageError(f"two things at {at}")
        if size:
            paths[at].append(path)

    stack = [(b"/", image.root)]
    seen = set()
    while stack:
        path, nid = stack.pop()
        i = image.inode(nid)
        at = image.meta_block * erofs.BLOCK + nid * erofs.NID
        meta_at, meta = i["meta"]
        note(at, meta_at - at, "inode", path)
        note(meta_at, meta, "attributes", path)
        if meta:
            _, shared, _ = erofs.XATTR_HEAD.unpack(image.part(meta_at, erofs.XATTR_HEAD.size))
            for k in range(shared):
                place = image.xattr_block * erofs.BLOCK + 4 * int.from_bytes(image.part(meta_at + erofs.XATTR_HEAD.size + 4 * k, 4), "little")
                note(place, image._attribute(place)[2], "shared attribute", path)
        if i["layout"] == erofs.CHUNKED:
            note(i["tail_at"], 4, "chunk", path)
        else:
            full, tail = divmod(i["size"], erofs.BLOCK)
            blocks = full + (tail > 0 and i["layout"] == erofs.PLAIN)
            for k in range(blocks):
                note((i["u"] + k) * erofs.BLOCK, erofs.BLOCK, "block", path)
            if i["layout"] == erofs.INLINE:
                note(i["tail_at"], tail, "inline", path)
        if i["kind"] == "dir" and nid not in seen:
            seen.add(nid)
            stack += [(path.rstrip(b"/") + b"/" + name, k) for name, k, _ in image.entries(i) if name not in (b".", b"..")]
    return [(at, *found[at], paths[at]) for at in sorted(found)]


def gaps(data: bytes, found: list[tuple[int, int, str, list[bytes]]]) -> Iterator[tuple[int, int, str]]:
    """(offset, size, kind) of what lies between segments: padding where it is zero, unknown where it isn't, overlap where
    segments do."""
    end = 0
    for at, size, _, _ in [*found, (len(data), 0, "", [])]:
        if at > end:
            yield end, at - end, "unknown" if data[end:at].strip(b"\0") else "padding"
        elif at < end:
            yield at, end - at, "overlap"
        end = max(end, at + size)


SEGMENT = "image_id string, offset long, size long, kind string, paths array<binary>"


def segment_rows(images: DataFrame, key: str = "image_id", content: str = "content") -> DataFrame:
    """Segments and gaps of images in (key, content)."""

    def rows(data: bytes) -> list[tuple]:
        found = segments(bytes(data))
        return [(at, n, kind, p) for at, n, kind, p in found] + [(at, n, kind, []) for at, n, kind in gaps(bytes(data), found)]

    one = F.udf(rows, "array<struct<offset: bigint, size: bigint, kind: string, paths: array<binary>>>", useArrow=False)
    return images.select(F.col(key).cast("string").alias("image_id"), F.explode(one(content)).alias("s")).select("image_id", "s.*")


def space(segments_found: DataFrame) -> DataFrame:
    """(image_id, kind, n, bytes, percent): the space of each kind in each image."""
    sums = segments_found.filter("kind <> 'overlap'").groupBy("image_id", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return sums.withColumn("percent", 100.0 * F.col("bytes") / F.sum("bytes").over(Window.partitionBy("image_id")))


def padding_between(segments_found: DataFrame) -> DataFrame:
    """(before, after, n, bytes): padding by the kinds on its two sides."""
    order = Window.partitionBy("image_id").orderBy("offset")
    rows = segments_found.withColumns({"before": F.lag("kind").over(order), "after": F.lead("kind").over(order)})
    return rows.filter("kind = 'padding'").groupBy("before", "after").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
