from pyspark.sql import functions as F

from granary.operators import catalog, check, graph, store, tree
from granary.streaming import imports


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {r.node: r.depth for r in graph.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")
    assert graph.closure(edges, spark.createDataFrame([(0,)], "node long")).count() == 41


def repository(spark):
    objects = spark.createDataFrame(
        [(x, len(x) + 1, None) for x in ("o1", "o2", "o3", "s1", "s2", "s3", "i1", "i2", "x1")], "object_id string, size long, data binary"
    )
    streams = spark.createDataFrame(
        [("one", "s1", ["o1"], {"layer": "s2", "img": "i2"}), ("two", "s2", ["o2"], {}), ("three", "s3", ["o3"], {"self": "s3"})],
        "name string, object_id string, object_refs array<string>, named_refs map<string, string>",
    )
    images = spark.createDataFrame([("img1", "i1"), ("img2", "i2")], "name string, object_id string")
    named = spark.createDataFrame([("img1", "x1")], "name string, object_id string")
    refs = spark.createDataFrame([("streams", "tag", "one")], "category string, name string, target string")
    return objects, refs, streams, images, named


def test_garbage_collection(spark):
    objects, refs, streams, images, named = repository(spark)
    kept, kept_streams, kept_images, counts = graph.gc(objects, refs, streams, images, named)
    assert sorted(r.object_id for r in kept.collect()) == ["i2", "o1", "o2", "s1", "s2"]
    assert sorted(r.name for r in kept_streams.collect()) == ["one", "two"] and [r.name for r in kept_images.collect()] == ["img2"]
    assert tuple(counts.first()) == (4, 12, 1, 1)
    kept, *_ = graph.gc(objects, refs, streams, images, named, ["three", "img1"])
    assert kept.count() == objects.count()


def test_integrity(spark):
    objects, refs, streams, images, named = repository(spark)
    assert check.links("images", images, objects).count() == 0 and check.refs(refs, streams, images).count() == 0
    fewer = objects.filter("object_id not in ('o1', 's2', 'x1', 'i1')")
    got = sorted(
        (r.type, r.path, r.object_id) for r in check.union(
            check.links("streams", streams, fewer), check.links("images", images, fewer), check.stream_refs(streams, fewer), check.image_objects(named, fewer)
        ).collect()
    )
    assert got == [
        ("broken link", "images/img1", "i1"),
        ("broken link", "streams/two", "s2"),
        ("missing named ref", "streams/one", "s2"),
        ("missing object", "images/img1", "x1"),
        ("missing object", "streams/one", "o1"),
    ]
    bad = spark.createDataFrame([("streams", "t", "gone"), ("images", "u", "img1")], refs.schema)
    assert [(r.path, r.detail) for r in check.refs(bad, streams, images).collect()] == [("streams/refs/t", "gone")]
    from granary.functions.digest import verity_bytes

    held = spark.createDataFrame(
        [(verity_bytes(b"a").hex(), b"a"), (verity_bytes(b"a").hex(), b"b"), ("zz", b"c"), ("0" * 64, None)], "object_id string, data binary"
    )
    assert sorted(r.type for r in check.objects(held).collect()) == ["object digest", "object name", "object unreadable"]
    meta = spark.createDataFrame(
        [
            ('{"version":1,"algorithm":"fsverity-sha256-12"}',),
            ("{",),
            ('{"version":2,"algorithm":"fsverity-sha256-12"}',),
            ('{"version":1,"algorithm":"md5"}',),
            ('{"version":1,"algorithm":"fsverity-sha512-12","features":{"incompatible":["new"]}}',),
        ],
        "json string",
    )
    assert sorted(r.detail for r in check.metadata(meta).collect()) == ["algorithm", "features", "unreadable", "version"]
    whole = check.repository(held, streams, images, named, refs)
    assert not check.counts(held, streams, images, whole).first().is_ok


def test_catalog(spark):
    import hashlib

    sha = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    config = '{"architecture":"amd64","os":"linux","config":{"Labels":{"k":"v"}},"rootfs":{"diff_ids":["sha256:l1","sha256:l2"]}}'
    manifest, other = '{"a": 1}', '{"b": 2}'
    configs = spark.createDataFrame(
        [(sha(config), "oc", config, {"sha256:l1": "o1", "image": "i1"})], "digest string, object_id string, json string, named_refs map<string, string>"
    )
    manifests = spark.createDataFrame(
        [
            (sha(manifest), "om", manifest, sha(config), ["l1", "l2"], catalog.CONFIG_MEDIA_TYPE),
            (sha(other), "oa", other, sha(config), ["x"], "application/other"),
        ],
        "digest string, object_id string, json string, config_digest string, layer_digests array<string>, config_media_type string",
    )
    refs = spark.createDataFrame([("streams", "oci/odd", "elsewhere")], "category string, name string, target string")
    refs = catalog.tag(catalog.tag(refs, "a/b:1", sha(manifest)), "art", sha(other))
    referrers = catalog.add_referrer(
        catalog.add_referrer(spark.createDataFrame([], "subject string, artifact string"), sha(manifest), sha(other)), "gone", sha(other)
    )
    assert sorted((r.name, r.digest) for r in catalog.tags(refs).collect()) == [("a/b:1", sha(manifest)), ("art", sha(other))]
    rows = {r.name: r for r in catalog.images(refs, manifests, configs, referrers).collect()}
    assert (rows["a/b:1"].architecture, rows["a/b:1"].layer_count, rows["a/b:1"].referrer_count, rows["art"].architecture, rows["art"].is_container) == (
        "amd64", 2, 1, "", False
    )
    assert [(r.key, r.value) for r in catalog.labels(configs).collect()] == [("k", "v")]
    assert [r.image_id for r in catalog.image_of(manifests, configs).filter(F.col("manifest_digest") == sha(manifest)).collect()] == ["i1"]
    assert [(r.diff_id, r.object_id) for r in catalog.layer_objects(configs).collect()] == [("sha256:l1", "o1")]
    made = spark.createDataFrame([(sha(config), None)], "digest string, image_id string")
    assert catalog.image_of(manifests, catalog.with_image(configs, made)).count() == 0
    stay, gone = catalog.dangling_referrers(referrers, manifests)
    assert stay.count() == 1 and gone.count() == 1
    assert {r.digest: r.outcome for r in catalog.upgrade_outcomes(refs, manifests, configs).collect()} == {sha(manifest): "current", sha(other): "skipped"}
    assert catalog.inspected(manifests, configs, referrers).filter(F.col("digest") == sha(manifest)).select(
        F.get_json_object("json", "$.referrers[0].digest")
    ).first()[0] == sha(other)
    assert {
        r.name: r.stage for r in check.tagged_images(
            catalog.tags(refs), manifests, configs, spark.createDataFrame([("o1",), ("i1",)], "object_id string")
        ).collect()
    } == {"a/b:1": None, "art": None}
    assert {
        r.stage for r in check.tagged_images(catalog.tags(refs), manifests, configs, spark.createDataFrame([("o1",)], "object_id string")).collect()
    } == {"layer missing"}
    assert catalog.tags(catalog.untag(refs, "art")).count() == 1
    assert catalog.resolve(refs, manifests, "art").first().digest == catalog.resolve(refs, manifests, "@" + sha(other)).first().digest


def test_import_counts_and_chunks(spark):
    batch = spark.createDataFrame([(1, "x", 3), (2, "x", 3), (3, "y", 5)], "seq long, object_id string, size long")
    assert tuple(store.import_stats(store.import_methods(batch, "seq")).first()) == (2, 8, 1, 3)
    chunks = spark.createDataFrame(
        [("s", 0, b"a", None), ("s", 1, b"b", None), ("s", 2, None, "o"), ("s", 3, None, "o"), ("s", 4, b"c", None)],
        "stream_id string, seq long, inline binary, object_id string",
    )
    rows = store.coalesced(chunks).orderBy("first_seq").collect()
    assert [(r.first_seq, r.last_seq, r.object_id, r.inline) for r in rows] == [(0, 1, None, b"ab"), (2, 2, "o", None), (3, 3, "o", None), (4, 4, None, b"c")]
    objects = spark.createDataFrame([("o", b"--")], "object_id string, data binary")
    assert bytes(store.reassembled(chunks, objects).first().data) == b"ab----c"


def test_trees(spark):
    entries = spark.createDataFrame(
        [
            ("/", "dir", None, 1),
            ("/usr", "dir", None, 9),
            ("/usr/f", "reg", 5, 4),
            ("/usr/d", "dir", None, 2),
            ("/usr/d/g", "reg", 5, 7),
            ("/run", "dir", None, 3),
            ("/run/x", "reg", 8, 30),
        ],
        "path string, kind string, leaf_id long, mtime long",
    )
    assert {r.path: r.nlink for r in tree.dir_links(entries).collect()} == {"/": 4, "/usr": 3, "/usr/d": 2, "/run": 2}
    assert {r.path: r.newest for r in tree.newest(entries).collect()} == {"/": 30, "/usr": 9, "/usr/d": 7, "/run": 30}
    assert {r.path: r.link_to for r in tree.primary_links(entries).collect() if r.link_to} == {"/usr/f": "/usr/d/g"}
    assert sorted(r.path for r in tree.without(entries, spark.createDataFrame([("/usr",)], "path string")).collect()) == ["/", "/run", "/run/x"]
    full = entries.withColumns({"mode": F.lit(7), "uid": F.lit(0), "gid": F.lit(0), "xattrs": F.lit(None).cast("map<string,string>")})
    moved = {r.path: r.mtime for r in tree.transform_for_oci(full).collect()}
    assert "/run/x" not in moved and moved["/"] == 9 and moved["/run"] == 9
    leaves = spark.createDataFrame([(5,), (8,), (11,)], "leaf_id long")
    assert {r.leaf_id: r.nlink for r in tree.leaf_links(leaves, entries).collect()} == {5: 2, 8: 1, 11: 0}
    assert [(r.leaf_id, r.error) for r in tree.leaf_errors(entries, leaves).collect()] == [(11, "orphan")]
    new_entries, new_leaves = tree.compacted(entries, leaves)
    assert {r.path: r.leaf_id for r in new_entries.collect() if r.leaf_id is not None} == {"/usr/f": 0, "/usr/d/g": 0, "/run/x": 1} and new_leaves.count() == 2


def test_streaming_import_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a",), ("b",), ("a",)], "data string").write.parquet(f"{tmp_path}/in/one")
    for _ in range(2):
        stream = spark.readStream.schema("data string").parquet(f"{tmp_path}/in/*")
        imports.import_stream(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/store").count() == 2
    batch = spark.createDataFrame([("b",), ("c",)], "data string")
    for _ in range(2):
        imports.into_store(f"{tmp_path}/store")(batch, 9)
        assert spark.read.parquet(f"{tmp_path}/store").count() == 3
