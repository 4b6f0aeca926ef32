import hashlib
import json

import pytest
from test_sources import FILES, tar_of
import tarfile

from granary.operators import boot, catalog
from granary.repository import Repository, RepositoryError, dump_lines
from granary.sources.erofs import Node


def image(spark, repo, tag, layers):
    tars = [tar_of(x) for x in layers]
    ids = ["sha256:" + hashlib.sha256(t).hexdigest() for t in tars]
    config = json.dumps({"architecture": "arm64", "os": "linux", "rootfs": {"type": "layers", "diff_ids": ids}})
    manifest = json.dumps(
        {
            "config": {"mediaType": catalog.CONFIG_MEDIA_TYPE, "digest": "sha256:" + hashlib.sha256(config.encode()).hexdigest()},
            "layers": [{"digest": i} for i in ids],
        }
    )
    frame = spark.createDataFrame(list(zip(ids, map(bytearray, tars), strict=True)), "diff_id string, content binary")
    return repo.pull(manifest, config, frame, tag), ids, tars


DIR, REG, LNK, HARD = tarfile.DIRTYPE, tarfile.REGTYPE, tarfile.SYMTYPE, tarfile.LNKTYPE
BASE = [
    ("usr", DIR, b""),
    ("usr/bin", DIR, b""),
    ("usr/bin/a", REG, b"x" * 500),
    ("usr/bin/b", REG, b"small"),
    ("usr/bin/c", HARD, "usr/bin/a"),
    ("run", DIR, b""),
    ("run/x", REG, b"gone"),
    ("etc", DIR, b""),
    ("etc/old", REG, b"o"),
]
TOP = [
    ("etc", DIR, b""),
    ("etc/.wh.old", REG, b""),
    ("etc/new", REG, b"n" * 65),
    ("usr/lib", DIR, b""),
    ("usr/lib/modules", DIR, b""),
    ("usr/lib/modules/6.1", DIR, b""),
    ("usr/lib/modules/6.1/vmlinuz", REG, b"k" * 100),
    ("usr/lib/os-release", LNK, "x"),
]


@pytest.mark.parametrize("algorithm", ["sha256", "sha512"])
def test_from_layers_to_image_and_back(spark, tmp_path, algorithm):
    repo = Repository.init(spark, f"file://{tmp_path}/repo", algorithm)
    assert Repository.init(spark, f"file://{tmp_path}/repo", algorithm).number == repo.number
    with pytest.raises(RepositoryError):
        Repository.init(spark, f"file://{tmp_path}/repo", "sha512" if algorithm == "sha256" else "sha256")
    digest, ids, tars = image(spark, repo, "app/one:1", [BASE, TOP])
    assert bytes(repo.cat(f"oci-layer-{ids[0]}").first().data) == tars[0]
    assert repo.ls_layer(ids[1]).count() == len(TOP)
    info = repo.layer_info(ids[0]).first()
    assert (info.entry_count, info.external_objects, info.external_size) == (len(BASE), 1, 500)
    again = Repository(spark, f"file://{tmp_path}/repo")
    before = again.table("objects").count()
    assert again.import_layers(spark.createDataFrame([(ids[0], bytearray(tars[0]))], "diff_id string, content binary")).first().total_objects == 0
    assert again.table("objects").count() == before
    row = again.oci_images().first()
    assert (row.name, row.manifest_digest, row.architecture, row.layer_count) == ("app/one:1", digest, "arm64", 2)
    image_id = again.mount_image("app/one:1")
    assert again.mount_image("app/one:1") == image_id == again.mount_image("@" + digest)
    lines = again.create_dumpfile(image_id)
    listed = [x.split(" ")[0] for x in lines]
    assert listed == [
        "/",
        "/etc",
        "/etc/new",
        "/run",
        "/usr",
        "/usr/bin",
        "/usr/bin/a",
        "/usr/bin/b",
        "/usr/bin/c",
        "/usr/lib",
        "/usr/lib/modules",
        "/usr/lib/modules/6.1",
        "/usr/lib/modules/6.1/vmlinuz",
        "/usr/lib/os-release",
    ]
    assert lines[8] == "/usr/bin/c 0 @120000 - - - - 0.0 /usr/bin/a - -"
    assert again.image_objects(image_id).count() == 3
    assert again.dump_files(image_id, ["/usr/bin/a"], True).first().backing_path[2] == "/"
    with pytest.raises(RepositoryError):
        again.dump_files(image_id, ["/nothing"])
    assert [(r.entry_kind, r.name) for r in again.boot_resources(image_id).collect()] == [(3, "6.1")]
    assert again.write_to_path(image_id, f"file://{tmp_path}/tree") == 6
    assert (tmp_path / "tree/etc/new").read_bytes() == b"n" * 65 and (tmp_path / "tree/usr/lib/os-release").is_symlink()
    assert json.loads(again.metadata_json())["algorithm"] == f"fsverity-{algorithm}-12"
    assert again.fsck().count() == 0
    assert json.loads(again.inspect("app/one:1").first().json)["config"]["os"] == "linux"
    assert again.gc(dry_run=True).first().objects_removed == 0
    other = Repository.init(spark, f"file://{tmp_path}/other", algorithm)
    assert other.fetch(again, f"oci-layer-{ids[0]}") == 2 and other.fetch(again, f"oci-layer-{ids[0]}") == 0
    assert bytes(other.cat(f"oci-layer-{ids[0]}").first().data) == tars[0]
    again.untag("app/one:1")
    assert again.gc(dry_run=True).first().objects_removed > 0
    stale = Repository(spark, f"file://{tmp_path}/repo")
    again.tag("app/two", digest)
    with pytest.raises(RepositoryError):
        stale.tag("late", digest)


def test_boot_entries_and_labels(spark, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    policy = [
        ("etc/selinux", DIR, b""),
        ("etc/selinux/config", REG, b"SELINUXTYPE=p\n"),
        *((f"etc/selinux/p{x}", DIR, b"") for x in ("", "/contexts", "/contexts/files")),
        ("etc/selinux/p/contexts/files/file_contexts", REG, b"/.* any_t\n/usr/bin/.* -- bin_t\n"),
    ]
    extra = [
        ("usr/lib/modules/6.1/initramfs.img", REG, b"i"),
        ("boot", DIR, b""),
        ("boot/loader", DIR, b""),
        ("boot/loader/entries", DIR, b""),
        ("boot/loader/entries/x.conf", REG, b"title A b\nlinux /v\n# no\ninitrd /i1\ninitrd /i2\n"),
        ("boot/v", REG, b"v"),
        ("sysroot", DIR, b""),
    ]
    image(spark, repo, "app", [BASE, TOP + policy + extra])
    plain = repo.mount_image("app")
    assert [tuple(r) for r in repo.boot_resources(plain).collect()] == [(1, "x"), (3, "6.1")]
    rows = {r.path: r for r in repo.entries(repo.mount_image("app", for_boot=True)).selectExpr("cast(path as string) path", "kind", "xattrs").collect()}
    assert "/boot/loader" not in rows and rows["/boot"].kind == "dir"
    assert {rows[p].xattrs[b"security.selinux"] for p in ("/usr/bin/a", "/usr/bin/b")} == {b"bin_t"} and rows["/etc"].xattrs[b"security.selinux"] == b"any_t"
    tree = repo.entries(plain).selectExpr("cast(path as string) path", "kind", "inline as content")
    entries = boot.text_entries(tree)
    assert [(r.key, r.value) for r in entries.orderBy("position").collect()] == [("title", "A b"), ("linux", "/v"), ("initrd", "/i1"), ("initrd", "/i2")]
    assert {r.path: r.kind for r in boot.entry_files(entries, tree).collect()} == {"/boot/v": "reg", "/boot/i1": None, "/boot/i2": None}
    made = boot.kernel_entries(boot.kernels(tree), options="quiet").first()
    assert made.entry_id == "6.1" and made.text.split("\n")[1:] == ["version 6.1", "linux /6.1/vmlinuz", "initrd /6.1/initramfs.img", "options quiet", ""]


def test_images_and_garbage(spark, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    root = Node("dir", 0o755, children={b"f": Node("reg", object_id="ab" * 32, size=9), b"g": Node("reg", inline=b"hi")})
    image_id = repo.create_image(root, "keep")
    assert repo.compute_id(root) == image_id
    lost = repo.create_image(Node("dir", 0o700))
    assert [r.type for r in repo.fsck().collect()] == ["missing object"]
    counts = repo.gc()
    assert tuple(counts.first())[0] == 1 and repo.table("images").count() == 1 and lost != image_id
    assert dump_lines(root) == ["/ 0 40755 2 0 0 0 0.0 - - -", f"/f 9 100000 1 0 0 0 0.0 ab/{'ab' * 31} - {'ab' * 32}", "/g 2 100000 1 0 0 0 0.0 - hi -"]
    assert FILES


def test_imports_write_what_is_new(spark, tmp_path):
    """An import adds a part; parts that are there stay, and collection writes anew only those that hold something dead."""
    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    one, _, _ = image(spark, repo, "one", [BASE])
    parts = list(repo.versions["objects"])
    image(spark, repo, "two", [TOP])
    assert repo.versions["objects"][: len(parts)] == parts and len(repo.versions["objects"]) > len(parts)
    again = repo.table("objects").groupBy("object_id").count()
    assert again.filter("count > 1").count() == 0
    new = repo._new_objects(spark.createDataFrame([(bytearray(b"x" * 500),), (bytearray(b"new" * 50),)], "data binary"))
    assert new.count() == 1
    # Of the store only ids are read.
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<object_id:string>" in plan and "data:binary" not in plan.split("ReadSchema", 1)[1].split("\n")[0]
    before = {x: repo.table("objects", [x]).select("object_id").collect() for x in repo.versions["objects"]}
    repo.untag("two")
    assert repo.gc().first().objects_removed > 0
    assert [x for x in repo.versions["objects"] if x in before][: len(parts)] == parts
    assert repo.fsck().count() == 0 and repo.oci_images().count() == 1 and one
    # Nothing dead: nothing is written anew.
    kept = list(repo.versions["objects"])
    repo.gc()
    assert repo.versions["objects"] == kept


def test_damage_is_reported(spark, tmp_path):
    """A stream and an image that can't be decoded are errors of their own, and hide no others."""
    repo = Repository.init(spark, f"file://{tmp_path}/repo", "sha512")
    image(spark, repo, "app", [BASE])
    repo.mount_image("app")
    assert repo.fsck().count() == 0
    bad_stream, bad_image = b"no stream at all", b"no image at all" * 100
    from granary.functions.digest import verity_bytes

    ids = [verity_bytes(x, "sha512").hex() for x in (bad_stream, bad_image)]
    streams = spark.createDataFrame([("odd", ids[0], 0, 5, [], {})], repo.table("streams").schema)
    images = repo.table("images").unionByName(spark.createDataFrame([(ids[1], ids[1])], "name string, object_id string"))
    repo._commit(
        {"images": images},
        {"objects": repo._new_objects(spark.createDataFrame([(bytearray(bad_stream),), (bytearray(bad_image),)], "data binary")), "streams": streams},
    )
    assert sorted((r.type, r.path) for r in repo.fsck().collect()) == [("unreadable image", f"images/{ids[1]}"), ("unreadable stream", "streams/odd")]
    assert repo.fsck("app").count() == 0
    with pytest.raises(Exception, match="magic|image|short"):
        repo.entries(ids[1]).collect()


def test_blobs_names_and_upgrades(spark, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    digest, object_id = repo.write_blob(b"blob" * 100)
    assert repo.write_blob(b"blob" * 100) == (digest, object_id)
    assert repo.open_blob(digest) == repo.open_blob(digest, object_id) == b"blob" * 100
    with pytest.raises(RepositoryError):
        repo.open_blob("sha256:none")
    config = "{}"
    layers = [{"digest": digest, "mediaType": "text/plain"}, {"digest": digest, "mediaType": "application/vnd.oci.image.layer.v1.tar"}]
    manifest = json.dumps(
        {"config": {"mediaType": "application/x-artifact", "digest": "sha256:" + hashlib.sha256(config.encode()).hexdigest()}, "layers": layers}
    )
    repo.pull(manifest, config, spark.createDataFrame([], "diff_id string, content binary"), "dir/art")
    assert repo.open_layer("dir/art", 0) == b"blob" * 100
    for position in (1, 2):
        with pytest.raises(RepositoryError):
            repo.open_layer("dir/art", position)
    assert [r.name for r in repo.names_under("streams", "oci").collect()] == ["dir%2Fart"]
    assert repo.has_name("oci/dir%2Fart") and not repo.has_name("oci/none")
    made = []
    chunks = spark.createDataFrame([(0, bytearray(b"in"), None), (1, None, bytearray(b"y" * 99))], "seq long, inline binary, data binary")
    assert repo.ensure_stream("s", 7, lambda: made.append(1) or chunks) == repo.ensure_stream("s", 7, lambda: made.append(1) or chunks)
    assert made == [1] and bytes(repo.cat("s").first().data) == b"in" + b"y" * 99
    repo.reset()
    assert repo.table("streams").count() == 0 and repo.table("objects").count() > 0
    import shutil

    shutil.rmtree(tmp_path / "repo/commits")
    opened, upgraded = Repository.open_upgrade(spark, f"file://{tmp_path}/repo")
    assert upgraded and opened.algorithm == "sha256" and opened.table("objects").count() > 0
    assert Repository.open_upgrade(spark, f"file://{tmp_path}/repo")[1] is False
    with pytest.raises(RepositoryError):
        Repository.open_upgrade(spark, f"file://{tmp_path}/none")


def test_layer_as_dump_text_and_configurations(spark, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    digest, ids, _ = image(spark, repo, "app", [BASE])
    config, refs = repo.open_config("app")
    assert config["architecture"] == "arm64" and list(refs) == ids and json.loads(repo.config_json("@" + digest)) == config
    assert json.loads(repo.manifest_json("app"))["layers"] == [{"digest": ids[0]}] and repo.label("app", "k") is None
    repo.name_stream(f"oci-layer-{ids[0]}", "mine")
    assert repo.has_name("mine") and {r.target for r in repo.names_under("streams").filter("name = 'mine'").collect()} == {f"oci-layer-{ids[0]}"}
    for wrong in (lambda: repo.name_stream("none", "x"), lambda: repo.open_config("none")):
        with pytest.raises(RepositoryError):
            wrong()
    lines = [r.value for r in repo.layer_dumpfile(ids[0]).collect()]
    assert lines[0].startswith("/usr 0 40") and lines[2].split(" ")[0] == "/usr/bin/a" and lines[2].split(" ")[8][2] == "/"
    assert lines[3].split(" ")[9] == "small" and lines[4] == "/usr/bin/c 0 @120000 - - - - 0.0 /usr/bin/a - -"


def test_import_from_container_storage(spark, tmp_path):
    """A store in a folder: layers taken apart into records and files, some of them in a layer below."""
    import gzip

    from granary.sources import archive, storage

    tars = [tar_of(BASE), tar_of([("etc", DIR, b""), ("etc/new", REG, b"n" * 65)])]
    ids = ["sha256:" + hashlib.sha256(t).hexdigest() for t in tars]
    config = json.dumps({"architecture": "amd64", "os": "linux", "rootfs": {"diff_ids": ids}})
    config_digest = "sha256:" + hashlib.sha256(config.encode()).hexdigest()
    manifest = json.dumps({"config": {"mediaType": catalog.CONFIG_MEDIA_TYPE, "digest": config_digest}, "layers": [{"digest": i} for i in ids]})
    store = tmp_path / "store"
    (store / "overlay-layers").mkdir(parents=True)
    (store / "overlay-images/img").mkdir(parents=True)
    (store / "overlay-layers/layers.json").write_text(json.dumps([{"id": "low", "diff-digest": ids[0]}, {"id": "top", "parent": "low", "diff-digest": ids[1]}]))
    (store / "overlay-images/images.json").write_text(json.dumps([{"id": "img", "names": ["host/app:latest"], "layer": "top"}]))
    (store / "overlay-images/img/manifest").write_text(manifest)
    (store / f"overlay-images/img/{storage.config_key(config_digest)}").write_text(config)
    for layer, data in zip(("low", "top"), tars, strict=True):
        with gzip.open(store / f"overlay-layers/{layer}.tar-split.gz", "wt") as f:
            f.write("\n".join(archive.tar_split_lines(data)) + "\n")
        for e in archive.entries(data):
            body = e["inline"] or next((b for k, b in archive.split(data) if k == "external" and len(b) == e["size"]), None)
            if e["kind"] == "reg" and body is not None:
                at = store / f"overlay/{layer}/diff" / e["path"].decode().lstrip("/")
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_bytes(body)
    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    digest = repo.import_storage(f"file://{store}", "app", "app:1")
    assert digest == "sha256:" + hashlib.sha256(manifest.encode()).hexdigest() == repo.import_storage(f"file://{store}", "img")
    assert [bytes(repo.cat(f"oci-layer-{i}").first().data) for i in ids] == tars
    assert repo.fsck().count() == 0
    with pytest.raises(RepositoryError):
        repo.import_storage(f"file://{store}", "none")
    (store / "overlay/top/diff/etc/new").write_bytes(b"m" * 65)
    broken = Repository.init(spark, f"file://{tmp_path}/broken")
    with pytest.raises(Exception, match="checksum"):
        broken.import_storage(f"file://{store}", "img")


@pytest.fixture
def served(tmp_path):
    """A folder over HTTP: files below streams are links to objects."""
    import functools
    import http.server
    import threading

    root = tmp_path / "www"
    root.mkdir()

    class Handler(http.server.SimpleHTTPRequestHandler):
        def guess_type(self, path):
            return "text/x-symlink-target" if "/streams/" in str(path) else "application/octet-stream"

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Handler, directory=str(root)))
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    yield root, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch_from_a_mirror(spark, tmp_path, served):
    root, url = served
    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    _, ids, tars = image(spark, repo, "app", [BASE, TOP])
    refs = {i: r.object_id for i in ids for r in repo.table("streams").filter(f"name = 'oci-layer-{i}'").collect()}
    body = spark.createDataFrame([(0, bytearray(b"top"), None)], "seq long, inline binary, data binary")
    top = repo.ensure_stream("top", 7, lambda: body, refs)
    for r in repo.table("objects").collect():
        at = root / "objects" / r.object_id[:2] / r.object_id[2:]
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(bytes(r.data))
    (root / "streams").mkdir()
    (root / "streams/top").write_text(f"../objects/{top[:2]}/{top[2:]}")
    other = Repository.init(spark, f"file://{tmp_path}/other")
    assert other.fetch_http(url, "top") > 3 and other.fetch_http(url, "top") == 0
    assert [bytes(other.cat(f"oci-layer-{i}").first().data) for i in ids] == tars and bytes(other.cat("top").first().data) == b"top"
    assert other.fsck().count() == 0
    external = next(r.object_id for r in repo.table("objects").filter("size = 500").collect())
    (root / "objects" / external[:2] / external[2:]).write_bytes(b"y" * 500)
    third = Repository.init(spark, f"file://{tmp_path}/third")
    with pytest.raises(RepositoryError, match="another digest"):
        third.fetch_http(url, "top")
    with pytest.raises(Exception, match="404"):
        third.fetch_http(url, "none")


def test_pull_from_a_registry(spark, tmp_path, served):
    import gzip

    root, url = served
    tars = [tar_of(BASE), tar_of(TOP)]
    ids = ["sha256:" + hashlib.sha256(t).hexdigest() for t in tars]
    packed = [gzip.compress(t, mtime=0) for t in tars]
    digests = ["sha256:" + hashlib.sha256(t).hexdigest() for t in packed]
    config = json.dumps({"architecture": "amd64", "os": "linux", "rootfs": {"diff_ids": ids}})
    config_digest = "sha256:" + hashlib.sha256(config.encode()).hexdigest()
    layers = [{"digest": d, "mediaType": "application/vnd.oci.image.layer.v1.tar+gzip"} for d in digests]
    manifest = json.dumps({"config": {"mediaType": catalog.CONFIG_MEDIA_TYPE, "digest": config_digest}, "layers": layers})
    at = root / "v2/team/app"
    (at / "manifests").mkdir(parents=True)
    (at / "blobs").mkdir()
    (at / "manifests/1").write_text(manifest)
    (at / "manifests" / ("sha256:" + "0" * 64)).write_text(manifest)
    (at / "blobs" / config_digest).write_text(config)
    for d, body in zip(digests, packed, strict=True):
        (at / "blobs" / d).write_bytes(body)
    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    assert repo.pull_registry(url, "team/app", "1", "app:1") == "sha256:" + hashlib.sha256(manifest.encode()).hexdigest()
    assert [bytes(repo.cat(f"oci-layer-{i}").first().data) for i in ids] == tars and repo.oci_images().first().layer_count == 2
    with pytest.raises(ValueError, match="not sha256:000"):
        repo.pull_registry(url, "team/app", "sha256:" + "0" * 64)
    (at / "blobs" / digests[0]).write_bytes(packed[1])
    with pytest.raises(Exception, match="a layer is not"):
        Repository.init(spark, f"file://{tmp_path}/new").pull_registry(url, "team/app", "1")


def test_boot_partition(spark, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    extra = [
        ("usr/lib/modules/6.1/initramfs.img", REG, b"i"),
        ("boot", DIR, b""),
        ("boot/loader", DIR, b""),
        ("boot/loader/entries", DIR, b""),
        ("boot/loader/entries/x.conf", REG, b"title A\nlinux /v\noptions quiet img=old ro\n"),
        ("boot/v", REG, b"kernel"),
    ]
    image(spark, repo, "app", [BASE, TOP + extra])
    image_id = repo.mount_image("app")
    assert repo.write_boot(image_id, f"file://{tmp_path}/esp", "img=", subdir="os") == 5
    at = tmp_path / "esp/os"
    assert (at / "loader/entries/x.conf").read_text() == f"title A\nlinux /v\noptions quiet ro img={image_id}\n"
    assert (at / "v").read_bytes() == b"kernel" and (at / "6.1/vmlinuz").read_bytes() == b"k" * 100 and (at / "6.1/initramfs.img").read_bytes() == b"i"
    assert (at / "loader/entries/6.1.conf").read_text().endswith(f"options img={image_id}\n")


def test_links_that_lead_nowhere_and_policies_in_folders(spark, tmp_path):
    from granary.operators import label

    repo = Repository.init(spark, f"file://{tmp_path}/repo")
    image(spark, repo, "app", [[("usr", DIR, b""), ("usr/a", HARD, "usr/none")]])
    with pytest.raises(RepositoryError, match="leads nowhere"):
        repo.mount_image("app")
    assert label.policy_in(spark, f"file://{tmp_path}") is None
    at = tmp_path / "root/etc/selinux/p/contexts/files"
    at.mkdir(parents=True)
    (tmp_path / "root/etc/selinux/config").write_text("SELINUXTYPE=p\n")
    (at / "file_contexts").write_text("/.* any_t\n")
    (at / "file_contexts.subs").write_text("/a /b\n")
    found, aliases = label.policy_in(spark, f"file://{tmp_path}/root")
    assert [x[1] for x in found] == ["any_t"] and aliases == {"/a": "/b"}
