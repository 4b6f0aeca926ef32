import gzip
import hashlib
import json

import pytest
import zstandard
from test_erofs import any_tree, simple
from test_repository import BASE, TOP
from test_sources import tar_of
import random

from granary.functions import debug
from granary.operators import catalog, label
from granary.repository import Repository
from granary.sources import erofs, oci


def layout(at, tag="app:1", spoil=False):
    (at / "blobs/sha256").mkdir(parents=True)

    def put(body):
        name = hashlib.sha256(body).hexdigest()
        (at / "blobs/sha256" / name).write_bytes(body)
        return {"digest": f"sha256:{name}", "size": len(body)}

    tars = [tar_of(BASE), tar_of(TOP)]
    layers = [
        put(gzip.compress(tars[0])) | {"mediaType": "application/vnd.oci.image.layer.v1.tar+gzip"},
        put(zstandard.compress(tars[1])) | {"mediaType": "application/vnd.oci.image.layer.v1.tar+zstd"},
    ]
    ids = ["sha256:" + hashlib.sha256(t).hexdigest() for t in tars]
    config = put(json.dumps({"architecture": "amd64", "rootfs": {"diff_ids": ids[::-1] if spoil else ids}}).encode())
    manifest = put(json.dumps({"config": config | {"mediaType": catalog.CONFIG_MEDIA_TYPE}, "layers": layers}).encode())
    (at / "index.json").write_text(json.dumps({"manifests": [manifest | {"annotations": {oci.REF_NAME: tag}}]}))
    return ids, manifest["digest"]


def test_layouts_are_pulled_and_upgraded(spark, tmp_path):
    ids, digest = layout(tmp_path / "l")
    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    assert repo.pull_layout(f"{tmp_path}/l", "app:1") == digest
    assert oci.broken(oci.blobs(spark, f"{tmp_path}/l")).count() == 0
    assert [r.name for r in repo.oci_images().collect()] == ["app:1"]
    assert repo.upgrade() == {"upgraded": 1} and repo.upgrade() == {"current": 1}
    plain, booted = repo.mount_image("app:1"), repo.mount_image("app:1", for_boot=True)
    assert plain == booted or repo.images().count() == 2
    repo.remove_boot_image("app:1")
    assert catalog.image_of(repo.table("manifests"), repo.table("configs"), boot=True).count() == 0
    with pytest.raises(oci.LayoutError):
        layout(tmp_path / "bad", spoil=True)
        oci.image(spark, f"{tmp_path}/bad", "app:1")
    with pytest.raises(oci.LayoutError):
        oci.image(spark, f"{tmp_path}/l", "other")


def test_segments_cover_an_image(spark):
    rnd = random.Random(3)
    for tree in (simple(), *(any_tree(rnd) for _ in range(10))):
        image = erofs.encode(tree)
        found = debug.segments(image)
        between = list(debug.gaps(image, found))
        assert not [g for g in between if g[2] != "padding"]
        assert sum(s[1] for s in found) + sum(g[1] for g in between) == len(image)
    files = spark.createDataFrame([("a", erofs.encode(simple()))], "image_id string, content binary")
    rows = debug.segment_rows(files)
    assert abs(sum(r.percent for r in debug.space(rows).collect()) - 100) < 1e-9
    assert {r.before for r in debug.padding_between(rows).collect()} >= {"header"}
    spoiled = bytearray(erofs.encode(simple()))
    spoiled[100] = 1
    assert "unknown" in {g[2] for g in debug.gaps(bytes(spoiled), debug.segments(bytes(spoiled)))}


def test_hexdump():
    first, second = debug.hexdump(b"hello world, this\x00", 15).split("\n")
    assert first == "0000000f  68 65 6c 6c 6f 20 77 6f 72 6c 64 2c 20 74 68 69  |hello world, thi|" and second == "0000001f  " + "73 00".ljust(47) + "  |s.|"


def test_policies_are_loaded_from_a_tree(spark):
    files = {
        "/etc/selinux/config": "# x\nselinuxtype = mine\nSELINUXTYPE=other\n",
        "/etc/selinux/mine/contexts/files/file_contexts": "/.* any\n",
        "/etc/selinux/mine/contexts/files/file_contexts.local": "/a mine\n",
        "/etc/selinux/mine/contexts/files/file_contexts.subs": "/x /y\n",
    }
    tree = spark.createDataFrame(list(files.items()), "path string, content string")
    rules, aliases = label.load_policy(tree)
    assert [c for _, c in rules] == ["any", "mine"] and aliases == {"/x": "/y"}
    assert label.load_policy(tree.filter("path <> '/etc/selinux/config'")) is None
