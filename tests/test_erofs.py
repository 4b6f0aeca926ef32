import random

import pytest

from granary.functions.digest import verity_bytes
from granary.sources import erofs
from granary.sources.erofs import ImageError, Node


def simple():
    root = Node("dir", 0o755)
    root.children = {
        b"fifo": Node("fifo"),
        b"regular-inline": Node("reg", inline=b"hihi"),
        b"regular-external": Node("reg", object_id="5a" * 32, size=1234),
        b"chrdev": Node("chr", rdev=123),
        b"blkdev": Node("blk", rdev=123),
        b"socket": Node("sock"),
        b"symlink": Node("lnk", target=b"/target"),
    }
    return root


def test_pinned_digests():
    assert verity_bytes(erofs.encode(Node("dir", 0o755))).hex() == "086b702a519b57d6ef5aea6f8b3f2be24355cd1fb835cd80fb4e3d388b24d5a5"
    assert verity_bytes(erofs.encode(simple())).hex() == "a8fcd41f8b313bede69f462f2af0a38d64b99a6333f5df884ea9ab4037fac722"


def any_tree(rnd):
    leaves = []

    def stat():
        names = [b"user.a", b"security.capability", b"trusted.overlay.opaque", b"odd", b"user." + rnd.randbytes(3).replace(b"\0", b"x")]
        return {
            "mode": rnd.randrange(0o10000),
            "uid": rnd.randrange(1 << 32),
            "gid": rnd.randrange(1 << 32),
            "mtime": rnd.randrange(-5, 1 << 34),
            "xattrs": {rnd.choice(names): rnd.choice([b"", b"v", rnd.randbytes(rnd.randrange(900))]) for _ in range(rnd.randrange(4))},
        }

    def leaf():
        kind = rnd.choice(["reg", "reg", "big", "lnk", "chr", "blk", "fifo", "sock"])
        extra = {
            "reg": {"inline": rnd.randbytes(rnd.randrange(65))},
            "big": {"object_id": rnd.randbytes(32).hex(), "size": rnd.randrange(1 << 40)},
            "lnk": {"target": rnd.randbytes(rnd.randrange(1, 1025))},
            "chr": {"rdev": rnd.randrange(1 << 32)},
            "blk": {"rdev": 0},
        }.get(kind, {})
        leaves.append(Node("reg" if kind == "big" else kind, **stat(), **extra))
        return leaves[-1]

    def folder(depth):
        node = Node("dir", **stat())
        for _ in range(rnd.choice([0, 3, 15, 200 if depth < 2 else 5])):
            name = rnd.randbytes(rnd.choice([1, 2, 30, 255])).replace(b"/", b"_").replace(b"\0", b"0")
            if name in (b".", b".."):
                continue
            node.children[name] = folder(depth + 1) if depth < 3 and rnd.random() < 0.2 else rnd.choice(leaves) if leaves and rnd.random() < 0.1 else leaf()
        return node

    return folder(0)


def shape(root):
    return [
        (
            p,
            k,
            n.kind,
            n.mode,
            n.uid,
            n.gid,
            n.mtime,
            n.xattrs,
            n.inline if n.kind == "reg" else None,
            n.object_id,
            n.size if n.object_id else 0,
            n.rdev,
            n.target,
        ) for p, n, k in erofs.rows_of(root)
    ]


def test_trees_come_back():
    rnd = random.Random(6)
    for _ in range(40):
        tree = any_tree(rnd)
        image = erofs.encode(tree)
        assert len(image) % 4096 == 0 and shape(erofs.decode(image)) == shape(tree)
        assert erofs.encode(erofs.decode(image)) == image


def test_broken_images_are_errors():
    rnd = random.Random(2)
    image = erofs.encode(simple())
    for bad in (b"", image[:1100], b"\0" + image[1:]):
        with pytest.raises(ImageError):
            erofs.decode(bad)
    for _ in range(1500):
        bad = bytearray(image)
        for _ in range(rnd.randrange(1, 4)):
            bad[rnd.randrange(1024, len(bad))] = rnd.randrange(256)
        try:
            erofs.decode(bytes(bad))
        except ImageError:
            pass


def test_look_ups():
    image = erofs.Image(erofs.encode(simple())).strict()
    assert image.child(image.root, b"nothing") is None
    inode = image.inode(image.child(image.root, b"regular-external"))
    assert erofs.metacopy(dict(image.xattrs(inode))[erofs.METACOPY]) == "5a" * 32


def test_rows_to_images_and_back(spark):
    rnd = random.Random(1)
    trees = {f"t{k}": any_tree(rnd) for k in range(4)} | {"simple": simple()}
    files = spark.createDataFrame([(k, erofs.encode(t)) for k, t in trees.items()], "image_id string, content binary")
    entries = erofs.entry_rows(files)
    assert {r.image_id: bytes(r.content) for r in erofs.image_rows(entries).collect()} == {k: erofs.encode(t) for k, t in trees.items()}
    assert [r.object_id for r in erofs.image_objects(files).filter("image_id = 'simple'").collect()] == ["5a" * 32]


def test_images_cut_within_their_padding_are_errors(spark):
    image = erofs.encode(Node("dir", 0o755, children={b"small": Node("reg", inline=b"x")}))
    assert not image[1500:].strip(b"\0")
    for bad in (image[:1500], image[:-1]):
        with pytest.raises(ImageError):
            erofs.decode(bad)
    files = spark.createDataFrame([("whole", image), ("cut", image[:1500])], "image_id string, content binary")
    assert [r.image_id for r in erofs.problems(files).collect()] == ["cut"]
