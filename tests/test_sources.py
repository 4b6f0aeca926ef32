import gzip
import io
import json
import os
import random
import tarfile

import pytest

from granary.operators import store
from granary.sources import archive, dumpfile, fdstream, splitstream, storage
from granary.sources.filesystem import TreeSource

DUMP = """/ 0 40755 2 0 0 0 1000.0 - - -
/empty_file 0 100644 1 0 0 0 1000.0 - - -
/small_file 5 100644 1 0 0 0 1000.0 - hello -
/symlink 7 120777 1 0 0 0 1000.0 /target - -

/link 0 @120000 - - - - 0.0 /small_file - -
/big 42 100644 1 0 0 0 1000.0 ab/cd - abcd user.k\\x3d=v\\x3d"""


def test_dump_lines_come_back(spark, tmp_path):
    (tmp_path / "x.dump").write_text(DUMP)
    rows = dumpfile.read(spark, f"{tmp_path}/*.dump")
    assert rows.filter("error is not null").count() == 0 and dumpfile.tree_errors(rows).count() == 0
    got = {r.line_no: r for r in rows.collect()}
    assert len(got) == 6 and got[2].content == b"hello" and got[5].hardlink and got[6].xattrs == {b"user.k=": b"v="}
    texts = [r[0] for r in rows.orderBy("line_no").select(dumpfile.lines_of(rows)).collect()]
    assert texts == [x for x in DUMP.split("\n") if x]
    dumpfile.write(rows, f"{tmp_path}/out")
    written = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert sorted(written.split("\n")) == sorted(["", *texts])


def test_bytes_are_escaped_and_come_back():
    rnd = random.Random(3)
    for data in [b"", b"-", b"--", b"foo=bar=baz", b"\x01\x02", b"foo!bar", b"a\\b\n\r\t", *(rnd.randbytes(rnd.randrange(20)) for _ in range(200))]:
        for equals in (False, True):
            text = dumpfile.escape(data, equals)
            assert " " not in text and "\n" not in text and text.isascii()
            assert (b"" if text == "-" else dumpfile.unescape(text)) == data
    assert dumpfile.escape(b"foo!bar") == "foo!bar" and dumpfile.escape(b"-") == "\\x2d" and dumpfile.escape(b"--") == "--"


@pytest.mark.parametrize("line", [
    "a 0 40755 2 0 0 0 0.0 - - -", "/a/ 0 40755 2 0 0 0 0.0 - - -", "//a 0 40755 2 0 0 0 0.0 - - -", "/a/../b 0 40755 2 0 0 0 0.0 - - -", "/a\\x00 0 40755 2 0 0 0 0.0 - - -",
    "/a 0 @40755 - - - - 0.0 /b - -", "/a 0 @120000 - - - - 0.0 - - -", "/a 0 40755 2 0 0 0 0.0 - x -", "/a 0 120777 1 0 0 0 0.0 t - abcd", "/a 0 100644 1 0 0 5 0.0 - - -", "/a 1 100644 1 0 0 0 0.0 - x abcd",
    "/a 0 140755 1 0 0 0 0.0 - - -", "/a 0 120777 1 0 0 0 0.0 " + "x" * 1025 + " - -", "/a 0 40755 2 0 0 0 0 - - -", "/a 0 40755 2 0 0 0 0.0 - - - noequals", "/a 0 40755 2 0 0 0 0.0 - -", "/a\\q 0 40755 2 0 0 0 0.0 - - -", "/a 0 120777 1 0 0 0 0.0 - - -",
    "/a 0 100644 1 0 0 0 0.0 - " + "x" * 513 + " -", "/a 0 4z755 2 0 0 0 0.0 - - -",
])
def test_bad_lines_are_errors(line):
    with pytest.raises(dumpfile.LineError):
        dumpfile.parse(line)


def test_lines_that_do_not_fit_together(spark):
    lines = [
        "/a 0 100644 1 0 0 0 0.0 - - -", "/a/b 0 100644 1 0 0 0 0.0 - - -", "/l 0 @120000 - - - - 0.0 /later - -", "/later 0 100644 1 0 0 0 0.0 - - -", "bad"
    ]
    rows = dumpfile.parsed(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))
    errors = sorted((r.line_no, r.error) for r in dumpfile.tree_errors(rows).collect())
    assert (0, "the first line is not the root") in errors and (1, "no parent directory") in errors and (2, "no target") in errors and errors[-1][0] == 4


def test_streams_come_back():
    rnd = random.Random(4)
    for algorithm, size in (("sha256", 32), ("sha512", 64)):
        ids = [rnd.randbytes(size).hex() for _ in range(5)]
        for _ in range(100):
            chunks = [rnd.choice([rnd.randbytes(rnd.randrange(9)), rnd.choice(ids)]) for _ in range(rnd.randrange(12))]
            named = {f"name {k}é": rnd.choice(ids) for k in range(rnd.randrange(4))}
            data = splitstream.encode(splitstream.Stream(splitstream.CONTENT_TYPES["ocilayer"], chunks, named, 77, algorithm))
            back = splitstream.decode(data, splitstream.CONTENT_TYPES["ocilayer"])
            assert back.chunks == list(splitstream.merged(chunks)) and back.named_refs == named and back.total_size == 77
            assert back.object_refs == list(dict.fromkeys(c for c in chunks if isinstance(c, str)))
            assert splitstream.decode(data, body=False).object_refs == back.object_refs
            # The older header holds the same fields in another order.
            magic, version, flags, number, block, begin, end = splitstream.HEADER.unpack_from(data)
            old = splitstream.OLD_HEADER.pack(begin, end, flags, magic, version, number, block) + data[splitstream.HEADER.size :]
            assert splitstream.decode(old).chunks == back.chunks


def test_damaged_streams_are_refused():
    data = splitstream.encode(splitstream.Stream(5, [b"abc", "0" * 64], {"n": "1" * 64}, 3))
    for bad in (
        b"",
        data[:31],
        b"X" + data[1:],
        data[:11] + b"\1" + data[12:],
        data[:14] + b"\2" + data[15:],
        data[:15] + b"\x10" + data[16:],
        data[:40],
        data[:16] + b"\xff" * 16 + data[32:],
    ):
        with pytest.raises(splitstream.StreamError):
            splitstream.decode(bad)
    with pytest.raises(splitstream.StreamError):
        splitstream.decode(data, 6)


def tar_of(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name, kind, body in files:
            m = tarfile.TarInfo(name)
            m.type, m.mode, m.mtime = kind, 0o644, 1000
            if kind == tarfile.REGTYPE:
                m.size = len(body)
                m.pax_headers = {"SCHILY.xattr.user.k": "v"} if len(body) == 65 else {}
            elif body:
                m.linkname = body
            tar.addfile(m, io.BytesIO(body) if kind == tarfile.REGTYPE else None)
    return out.getvalue()


FILES = [
    ("d/", tarfile.DIRTYPE, b""),
    *((f"d/f{n}" + "x" * (n % 150), tarfile.REGTYPE, bytes(n % 251 for _ in range(n))) for n in (0, 1, 63, 64, 65, 511, 512, 513, 1025, 100_000)),
    ("d/s", tarfile.SYMTYPE, "../t"),
    ("d/h", tarfile.LNKTYPE, "d/f65"),
    ("p", tarfile.FIFOTYPE, ""),
    ("same", tarfile.REGTYPE, b"\1" * 513),
]


def test_archives_split_and_come_back(spark):
    data = tar_of(FILES)
    parts = list(archive.split(data))
    assert b"".join(p for _, p in parts) == data and {len(p) for k, p in parts if k == "external"} == {65, 511, 512, 513, 1025, 100_000}
    assert all(parts[k][0] != "inline" or parts[k + 1][0] == "external" for k in range(len(parts) - 1))
    files = spark.createDataFrame([("one", data), ("two", data[: 512 * 2] + b"\0" * 1024)], "path string, content binary")
    rows = archive.split_rows(files)
    objects = rows.filter("kind = 'external'").select("object_id", "data").dropDuplicates(["object_id"])
    whole = store.reassembled(rows.drop("data"), objects)
    assert {r.stream_id: bytes(r.data) for r in whole.collect()}["one"] == data
    streams = splitstream.encoded(rows).filter("stream_id = 'one'")
    again = splitstream.chunk_rows(streams.withColumnRenamed("stream_id", "name"))
    assert bytes(store.reassembled(again, objects).first().data) == data
    heads = splitstream.headers(streams).first()
    assert heads.total_size == len(data) and len(heads.object_refs) == 7 and heads.error is None


def test_archive_entries(spark):
    rows = archive.entry_rows(spark.createDataFrame([("one", tar_of(FILES))], "path string, content binary")).orderBy("entry_idx").collect()
    by = {bytes(r.path).split(b"x")[0]: r for r in rows}
    assert rows[0].kind == "dir" and bytes(rows[0].path) == b"/d"
    assert by[b"/d/f64"].inline is not None and by[b"/d/f65"].inline is None and by[b"/d/f65"].xattrs == {b"user.k": b"v"}
    assert (by[b"/d/s"].kind, bytes(by[b"/d/s"].target), by[b"/d/h"].kind, bytes(by[b"/d/h"].target)) == ("lnk", b"../t", "hardlink", b"/d/f65")
    assert list(archive.entries(b"")) == [] and list(archive.entries(b"\0" * 1024)) == []
    with pytest.raises(archive.ArchiveError):
        list(archive.entries(tar_of(FILES)[:100_000]))


def test_archives_taken_apart(spark, tmp_path):
    assert archive.crc64(b"123456789") == 0xB90956C775A41001
    data = tar_of(FILES)
    lines = list(archive.tar_split_lines(data))
    bodies = {name: body for name, kind, body in FILES if kind == tarfile.REGTYPE}
    assert archive.from_tar_split(lines, bodies.__getitem__) == data
    with pytest.raises(archive.ArchiveError):
        archive.from_tar_split(lines, lambda name: bodies[name] + b"x")
    with gzip.open(tmp_path / "x.tar-split.gz", "wt") as f:
        f.write("\n".join(lines))
    rows = storage.tar_split(spark, f"{tmp_path}/x.tar-split.gz")
    assert rows.filter("type = 1").count() == len(FILES) and rows.filter("type = 2 and octet_length(payload) >= 512").count() >= len(FILES)


def test_chunk_streams():
    chunks = [b"abc", 0, b"x" * 1000, 7]
    assert list(fdstream.read(io.BytesIO(fdstream.write([b"", *chunks])))) == chunks
    for bad in (b"\0" * 7, fdstream.write([b"abc"])[:-1], (-fdstream.INLINE_LIMIT - 1).to_bytes(8, "little", signed=True)):
        with pytest.raises(fdstream.ChunkError):
            list(fdstream.read(io.BytesIO(bad)))


def test_storage(spark, tmp_path):
    for rank, ids in enumerate((["l1", "l2"], ["l2", "l3"])):
        base = tmp_path / f"s{rank}"
        (base / "overlay-layers").mkdir(parents=True)
        (base / "overlay-images").mkdir()
        (base / "overlay-layers/layers.json").write_text(
            json.dumps([{"id": x, "parent": f"l{int(x[1]) - 1}" if x != "l1" else None, "diff-digest": f"sha256:{x}", "diff-size": 10 + rank} for x in ids])
        )
        (base / "overlay-images/images.json").write_text(json.dumps([{"id": "i1", "names": ["docker.io/library/busybox:latest"]}, {"id": "i2"}]))
    layers = storage.every_store(spark, [f"{tmp_path}/s0", f"{tmp_path}/s1"])
    wanted = spark.createDataFrame([(0, "sha256:l2"), (1, "sha256:no"), (2, "sha256:l3")], "position int, diff_digest string")
    assert [(r.id, r.store_rank) for r in storage.resolved(wanted, layers).orderBy("position").collect()] == [("l2", 0), (None, None), ("l3", 1)]
    images = storage.images(spark, f"{tmp_path}/s0")
    assert [
        storage.named(images, n).first().id for n in ("docker.io/library/busybox:latest", "busybox:latest", "busybox")
    ] == ["i1"] * 3 and storage.named(images, "box").isEmpty()
    chained = storage.chain(layers, "l3")
    assert {r.id: r.depth for r in chained.collect()} == {"l3": 0, "l2": 1, "l1": 2}
    files = spark.createDataFrame([("l1", "/a", 1), ("l2", "/a", 2), ("l1", "/b", 3)], "layer_id string, path string, size int")
    assert {r.path: (r.layer_id, r.depth) for r in storage.first_in_chain(files, chained).collect()} == {"/a": ("l2", 1), "/b": ("l1", 2)}
    assert storage.additional_stores("a=b,additionalimagestore=/x,additionalimagestore=") == ["/x"]
    assert storage.config('[storage]\ndriver="overlay"\n[storage.options]\nadditionalimagestores=["/y"]')["stores"] == ["/y"]


def test_directories_are_scanned(spark, tmp_path):
    (tmp_path / "t/a").mkdir(parents=True)
    (tmp_path / "t/a/small").write_bytes(b"x" * 64)
    (tmp_path / "t/a-big").write_bytes(b"y" * 65)
    os.link(tmp_path / "t/a-big", tmp_path / "t/link")
    (tmp_path / "t/sym").symlink_to("a")
    spark.dataSource.register(TreeSource)
    rows = {bytes(r.path): r for r in spark.read.format("granary_tree").load(f"{tmp_path}/t").collect()}
    assert set(rows) == {b"/", b"/a", b"/a/small", b"/a-big", b"/link", b"/sym"}
    assert bytes(
        rows[b"/a/small"].inline
    ) == b"x" * 64 and rows[b"/a-big"].inline is None and rows[b"/a-big"].ino == rows[b"/link"].ino and bytes(rows[b"/sym"].target) == b"a"


def test_plain_archives_are_written_and_read_without_tarfile(monkeypatch):
    files = [("orders/1", b""), ("orders/2", b"x" * 512), ("a" * 100, b"y" * 65), ("b" * 101, b"z"), ("ü", b"u")]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name, body in files:
            member = tarfile.TarInfo(name)
            member.size = len(body)
            tar.addfile(member, io.BytesIO(body))
    assert archive.written(files) == out.getvalue()
    assert [e["path"].decode() for e in archive.entries(out.getvalue())] == [f"/{name}" for name, _ in files]
    plain = archive.written(files[:3])
    bad = bytearray(plain)
    bad[100] ^= 1
    with pytest.raises(archive.ArchiveError):
        list(archive.entries(bytes(bad)))
    monkeypatch.setattr(tarfile, "open", None)
    assert [(e["path"].decode(), e["size"]) for e in archive.entries(plain)] == [(f"/{name}", len(body)) for name, body in files[:3]]
    assert b"".join(part for _, part in archive.split(plain)) == plain
    rows = [(k, b"x" * 1000) for k in range(20_000)]
    sizes = [b.num_rows for b in archive.batched(iter(rows), {"k": archive.pa.int64(), "v": archive.pa.binary()})]
    assert sum(sizes) == 20_000 and max(sizes) <= 8192 and len(sizes) < 10
