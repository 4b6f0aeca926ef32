"""A repository in a folder: the command surface as functions that return DataFrames.

A table is a list of Parquet folders, its parts. A commit writes new parts first, objects before streams and images before refs, and then
one small file that lists the parts of all tables; readers see the last whole commit, and a writer that dies leaves nothing
that a later commit or reader would see. Objects and streams only grow: an import writes what is new and reads of what is there the names
alone. Garbage collection writes anew the parts that hold something dead; other parts stay as they are. Small tables, such as refs,
are written whole.

One writer works at a time. Where a rename refuses a name that is taken, as on HDFS, the second of two writers fails; other file systems
may let it replace the first one's commit, so there writers have to take turns.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions.digest import object_path as digest_path
from .functions.digest import verity_bytes
from .operators import boot, catalog, check, fold, graph, label, store, tree
from .operators.common import cut
from .sources import archive, dumpfile, erofs, filesystem, mirror, oci, splitstream, storage

ORDER = ("objects", "streams", "images", "manifests", "configs", "referrers", "refs")
SCHEMAS = {
    "objects": schemas.OBJECTS,
    "streams": schemas.STREAMS,
    "images": schemas.IMAGES,
    "refs": schemas.REFS,
    "referrers": schemas.REFERRERS,
    "manifests": "digest string, object_id string, json string, config_digest string, layer_digests array<string>, config_media_type string",
    "configs": "digest string, object_id string, json string, named_refs map<string, string>",
}
LAYER_TYPE = splitstream.CONTENT_TYPES["ocilayer"]


class RepositoryError(ValueError):
    """A repository that can't be opened or a request that it refuses."""


class Repository:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.meta, self.versions, self.number = self._current()

    # Commits.

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @classmethod
    def init(cls, spark: SparkSession, path: str, algorithm: str = "sha256") -> Repository:
        """Creates a repository; on one that exists with the same metadata it opens it, otherwise it refuses."""
        meta = {"version": 1, "algorithm": f"fsverity-{algorithm}-12", "features": {}}
        new = object.__new__(cls)
        new.spark, new.path = spark, path.rstrip("/")
        if new._exists():
            old = cls(spark, path)
            if old.meta != meta:
                raise RepositoryError("a repository with other metadata is there")
            return old
        new.meta, new.versions, new.number = meta, {}, 0
        new._commit()
        return new

    @classmethod
    def open_upgrade(cls, spark: SparkSession, path: str) -> tuple[Repository, bool]:
        """Opens a repository; one that has objects but no commit, as after a lost ``commits`` folder, gets metadata by the length of its
        objects' ids. Whether that was done."""
        new = object.__new__(cls)
        new.spark, new.path = spark, path.rstrip("/")
        if new._exists():
            return cls(spark, path), False
        fs, folder = new._fs(f"{new.path}/objects")
        parts = [f"objects/{x.getPath().getName()}" for x in fs.listStatus(folder)] if fs.exists(folder) else []
        row = new.table("objects", parts).select(F.length("object_id").alias("n")).first() if parts else None
        if row is None or row.n not in (64, 128):
            raise RepositoryError("no repository is there")
        new.meta, new.versions, new.number = {"version": 1, "algorithm": f"fsverity-sha{4 * row.n}-12", "features": {}}, {}, 0
        new._commit(parts={"objects": parts})
        return new, True

    def reset(self) -> None:
        """Drops all streams, images, names and catalog tables; objects stay until they are collected."""
        self._commit(parts={name: [] for name in ORDER if name != "objects"})

    def _exists(self) -> bool:
        fs, p = self._fs(f"{self.path}/commits")
        return bool(fs.exists(p)) and len(fs.listStatus(p)) > 0

    def _current(self) -> tuple[dict, dict, int]:
        if not self._exists():
            raise RepositoryError("no repository is there")
        fs, p = self._fs(f"{self.path}/commits")
        numbers = [int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json")]
        last = self.spark.read.text(f"{self.path}/commits/{max(numbers):012d}.json", wholetext=True).first()[0]
        body = json.loads(last)
        if body["meta"].get("version") != 1 or not body["meta"].get("algorithm", "").startswith("fsverity-"):
            raise RepositoryError("metadata of another version or algorithm")
        return body["meta"], body["tables"], max(numbers)

    def _commit(self, whole: dict[str, DataFrame] | None = None, more: dict[str, DataFrame] | None = None, parts: dict[str, list[str]] | None = None) -> None:
        """Commits tables written whole, rows added to tables, and tables as lists of parts."""
        versions = dict(self.versions) | (parts or {})
        for name in ORDER:
            if name in (whole or {}):
                versions[name] = [self._part(name, whole[name])]
            if name in (more or {}):
                versions[name] = [*versions.get(name, []), self._part(name, more[name])]
        fs, draft = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"meta": self.meta, "tables": versions}).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/commits/{self.number + 1:012d}.json")
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(draft, final):
            raise RepositoryError("another writer has committed")
        self.versions, self.number = versions, self.number + 1

    def _part(self, name: str, rows: DataFrame) -> str:
        part = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        return part

    def table(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """The rows of a table, or of some of its parts."""
        parts = self.versions.get(name, []) if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.path}/{x}" for x in parts))

    def _without_dead(self, name: str, kept: DataFrame, key: str) -> list[str]:
        """The parts of a table of which only rows whose key is kept are left. Keys and the names of files are read to find the parts that have
        others; those alone are written anew."""
        parts = self.versions.get(name, [])
        if not parts:
            return parts
        part = F.regexp_extract("_metadata.file_path", rf"/({name}/[0-9a-f]{{32}})/", 1)
        dead = self.table(name).select(key, part.alias("part")).join(kept.select(key), key, "left_anti").select("part").distinct()
        touched = {r.part for r in dead.collect()}  # at most as many as commits
        if not touched:
            return parts
        left = self.table(name, [x for x in parts if x in touched]).join(kept.select(key), key, "left_semi")
        return [*(x for x in parts if x not in touched), self._part(name, left)]

    def metadata_json(self) -> str:
        """The metadata as it is shown."""
        return json.dumps(self.meta, indent=2) + "\n"

    def write_to_path(self, image_id: str, path: str) -> int:
        """An image's tree as files in a folder that the executors share: directories first, then files, each by the task that has its
        row. Hard links become files of their own. How many files were written."""
        rows = self.entries(image_id).join(self.table("objects").select("object_id", "data"), "object_id", "left")
        return filesystem.write_rows(rows.withColumn("content", F.coalesce("inline", "data")), path)

    @property
    def algorithm(self) -> str:
        return self.meta["algorithm"].split("-")[1]

    # Objects and streams.

    def _new_objects(self, rows: DataFrame) -> DataFrame:
        """Those objects of rows (data) that the store lacks. Of the store only the ids are read."""
        made = store.identified(rows, "data", self.algorithm).select("object_id", "size", F.col("data").cast("binary").alias("data"))
        return store.absent(made, self.table("objects"))

    def _bytes(self, object_id: str) -> bytes:
        row = self.table("objects").filter(F.col("object_id") == object_id).select("data").first()
        if row is None:
            raise RepositoryError(f"no object {object_id}")
        data = bytes(row.data)
        if verity_bytes(data, self.algorithm).hex() != object_id:
            raise RepositoryError(f"the content of {object_id} has another digest")
        return data

    def _one_row(self, data: bytes) -> DataFrame:
        return self.spark.createDataFrame([(bytearray(data),)], "data binary")

    def import_layers(self, files: DataFrame) -> DataFrame:
        """files (diff_id, content): archives to streams. Layers that are there are skipped before they are split. Returns the
        counts of what was stored."""
        have = self.table("streams").select("name")
        fresh = files.withColumn("name", F.concat(F.lit("oci-layer-"), "diff_id")).join(have, "name", "left_anti").dropDuplicates(["name"])
        rows = archive.split_rows(fresh.select("name", "content"), "name", algorithm=self.algorithm).persist()
        names = fresh.select(
            F.col("name").alias("stream_id"), F.lit(LAYER_TYPE).alias("content_type"), F.lit(None).cast("map<string, string>").alias("named_refs")
        )
        encoded = splitstream.encoded(rows, names, self.algorithm)
        heads = store.identified(splitstream.headers(encoded), "content", self.algorithm).drop("content").persist()
        broken = heads.filter("error is not null or object_refs is null").select("stream_id", "error").first()
        if broken is not None:
            raise RepositoryError(f"the stream {broken.stream_id} does not read back: {broken.error}")
        new_streams = heads.select(F.col("stream_id").alias("name"), "object_id", "content_type", F.col("total_size"), "object_refs", "named_refs")
        external = rows.filter("kind = 'external'").select("data")
        objects = self._new_objects(external.unionAll(encoded.select(F.col("content").alias("data"))))
        known = self.table("objects").select("object_id", F.lit(True).alias("there"))
        parts = rows.filter("kind = 'external'").withColumn("seq_in_all", F.struct("stream_id", "seq")).join(known, "object_id", "left")
        methods = store.import_methods(parts, "seq_in_all").withColumn("method", F.when(F.col("there"), "present").otherwise(F.col("method")))
        counts = store.import_stats(methods).toPandas()
        self._commit(more={"objects": objects, "streams": new_streams})
        rows.unpersist()
        heads.unpersist()
        return self.spark.createDataFrame(counts)

    def ensure_stream(self, name: str, content_type: int, make: Callable[[], DataFrame], named_refs: dict[str, str] | None = None) -> str:
        """The object id of a stream; one that isn't there is made from what ``make`` returns, rows (seq, inline, data): bytes within the stream
        or objects of their own."""
        row = self.table("streams").filter(F.col("name") == name).select("object_id").first()
        if row is not None:
            return row.object_id
        made = store.identified(make(), "data", self.algorithm).withColumn("stream_id", F.lit(name))
        chunks = made.select(
            "stream_id",
            "seq",
            "inline",
            F.when(F.col("inline").isNull(), F.col("object_id")).alias("object_id"),
            F.coalesce(F.octet_length("inline"), "size").cast("long").alias("size"),
        )
        refs = self.spark.createDataFrame([(name, content_type, named_refs or {})], "stream_id string, content_type long, named_refs map<string, string>")
        heads = store.identified(splitstream.headers(splitstream.encoded(chunks, refs, self.algorithm)), "content", self.algorithm)
        head = heads.first()
        bodies = made.filter("inline is null").select(F.col("data").cast("binary").alias("data")).unionAll(heads.select(F.col("content").alias("data")))
        stream = self.spark.createDataFrame([(name, head.object_id, content_type, head.total_size, head.object_refs, named_refs or {})], SCHEMAS["streams"])
        self._commit(more={"objects": self._new_objects(bodies), "streams": stream})
        return head.object_id

    def write_blob(self, data: bytes) -> tuple[str, str]:
        """Stores bytes under their digest; the digest and the object's id. Bytes that are there stay."""
        digest = archive.sha256_id(data)
        blob = self.spark.createDataFrame([(0, None, bytearray(data))], "seq long, inline binary, data binary")
        self.ensure_stream(f"oci-blob-{digest}", splitstream.CONTENT_TYPES["oci_blob"], lambda: blob)
        return digest, verity_bytes(data, self.algorithm).hex()

    def open_blob(self, digest: str, object_id: str | None = None) -> bytes:
        """The bytes of a blob: by the id of its object, or by its digest, which must hold then."""
        if object_id is not None:
            return self._bytes(object_id)
        row = self.cat(f"oci-blob-{digest}").first()
        if row is None or archive.sha256_id(bytes(row.data)) != digest:
            raise RepositoryError(f"no blob {digest}, or one of another digest")
        return bytes(row.data)

    def open_layer(self, reference: str, position: int) -> bytes:
        """The bytes of an artifact's layer; layers that are archives are refused."""
        row = catalog.layer_at(catalog.resolve(self.table("refs"), self.table("manifests"), reference), position).first()
        if row is None or row.layer_digest is None or not row.is_blob:
            raise RepositoryError(f"no layer {position} of {reference}, or an archive")
        return self.open_blob(row.layer_digest)

    def names_under(self, category: str, prefix: str = "") -> DataFrame:
        return catalog.names_under(self.table("refs"), category, prefix)

    def has_name(self, name: str) -> bool:
        return catalog.known_names(self.spark.createDataFrame([(name,)], "name string"), self.table("refs"), self.table("streams")).first().known

    def stream(self, name: str) -> DataFrame:
        """The chunks of a stream."""
        row = self.table("streams").filter(F.col("name") == name)
        return splitstream.chunk_rows(row.join(self.table("objects").select("object_id", F.col("data").alias("content")), "object_id"))

    def cat(self, name: str) -> DataFrame:
        """(stream_id, data): a stream put together again."""
        return store.reassembled(self.stream(name), self.table("objects"))

    def ls_layer(self, diff_id: str) -> DataFrame:
        """A layer's entries in its order."""
        whole = self.cat(f"oci-layer-{diff_id}").withColumnRenamed("data", "content")
        return archive.entry_rows(whole, "stream_id", algorithm=self.algorithm).orderBy("entry_idx")

    def layer_dumpfile(self, diff_id: str) -> DataFrame:
        """(line_no, value): a layer's entries as dump lines, in its order."""
        rows = self.ls_layer(diff_id)
        as_path = F.when(F.octet_length("path") == 0, F.lit("/").cast("binary")).otherwise(F.col("path"))
        kinds = F.create_map(*(F.lit(x) for kind, (_, bits) in erofs.TYPES.items() for x in (kind, bits)))
        dumped = rows.select(
            F.col("entry_idx").alias("line_no"),
            as_path.alias("path"),
            F.when(F.col("inline").isNotNull(), F.octet_length("inline")).otherwise(F.col("size")).cast("long").alias("size"),
            (F.coalesce(F.element_at(kinds, F.col("kind")), F.lit(0)).cast("int") + F.col("mode")).alias("mode"),
            F.lit(1).cast("long").alias("nlink"),
            "uid",
            "gid",
            "rdev",
            F.col("mtime").alias("mtime_sec"),
            F.lit(0).cast("long").alias("mtime_nsec"),
            F.when(F.col("object_id").isNotNull(), digest_path(F.col("object_id")).cast("binary")).otherwise(F.col("target")).alias("payload"),
            F.col("inline").alias("content"),
            F.col("object_id").alias("digest"),
            "xattrs",
            (F.col("kind") == "hardlink").alias("hardlink"),
            F.lit(None).cast("string").alias("error"),
        )
        return dumped.select("line_no", dumpfile.lines_of(dumped).alias("value")).orderBy("line_no")

    def layer_info(self, diff_id: str) -> DataFrame:
        name = f"oci-layer-{diff_id}"
        sized = self.stream(name).join(self.table("objects").select("object_id", F.col("size").alias("object_size")), "object_id", "left").withColumn(
            "size", F.coalesce("object_size", F.octet_length("inline"))
        )
        return catalog.layer_info(sized, self.ls_layer(diff_id))

    # Images.

    def image_of(self, diff_ids: list[str], for_boot: bool = False) -> DataFrame:
        """(data) of the file system image of layers, the lowest first: folded, made canonical, encoded. An image is one value, so the task that
        encodes it holds its tree; the driver does not."""
        layers = None
        for k, diff_id in enumerate(diff_ids):
            rows = self.ls_layer(diff_id).withColumn("layer_idx", F.lit(k))
            layers = rows if layers is None else layers.unionByName(rows)
        if layers is None:
            raise RepositoryError("no layers")
        text_path = F.when(F.octet_length("path") == 0, "/").otherwise(F.col("path").cast("string"))
        entries = layers.withColumns(
            {
                "path": text_path,
                "item": F.when(F.col("kind") == "dir", "dir").when(F.col("kind") == "hardlink", "hardlink").otherwise("leaf"),
                "target_bytes": F.col("target"),
                "target": F.col("target").cast("string"),
            }
        )
        # Archives are read once; entries hold no contents but small ones.
        entries = cut(entries)
        if not fold.invalid(entries).isEmpty():
            raise RepositoryError("an entry without its directory")
        merged = fold.folded(entries)
        links = cut(fold.origins(entries))
        lost = merged.filter("item = 'hardlink'").join(links, ["layer_idx", "entry_idx"], "left_anti").select("path").first()
        if lost is not None:
            raise RepositoryError(f"the hard link {lost.path} leads nowhere")
        # A hard link is the leaf that it leads to.
        values = ["kind", "mode", "uid", "gid", "mtime", "size", "rdev", "target_bytes", "inline", "object_id", "xattrs"]
        puts = entries.select(F.col("layer_idx").alias("origin_layer"), F.col("entry_idx").alias("origin_entry"), *(F.col(x).alias(f"o_{x}") for x in values))
        rows = merged.join(links, ["layer_idx", "entry_idx"], "left").join(puts, ["origin_layer", "origin_entry"], "left")
        linked = F.col("item") == "hardlink"
        rows = rows.withColumns({x: F.when(linked, F.col(f"o_{x}")).otherwise(F.col(x)) for x in values})
        leaf = F.when(F.col("kind") != "dir", F.xxhash64(F.coalesce("origin_layer", "layer_idx"), F.coalesce("origin_entry", "entry_idx")))
        flat = rows.select("path", leaf.alias("leaf_id"), *values)
        flat = cut(flat)
        if flat.filter("path = '/'").isEmpty():
            usr = flat.filter("path = '/usr'").limit(1).withColumn("path", F.lit("/"))
            flat = flat.unionByName(usr)
        flat = tree.transform_for_oci(flat)
        if for_boot:
            # Labels come from the policy in the tree itself; without one, all labels go.
            known = flat.join(self.table("objects").select("object_id", "data"), "object_id", "left").select(
                "path", F.coalesce("inline", "data").alias("content")
            )
            policy = label.load_policy(known)
            flat = label.relabelled(tree.emptied_for_boot(flat), *(policy or (None,)))
        made = flat.select(
            F.lit("image").alias("image_id"),
            F.col("path").cast("binary").alias("path"),
            "leaf_id",
            *(F.col(x).alias("target") if x == "target_bytes" else F.col(x) for x in values),
        )
        return erofs.image_rows(made, self.algorithm).select(F.col("content").alias("data"))

    def create_image(self, root: erofs.Node, name: str | None = None) -> str:
        """Stores the image of a tree; its id."""
        return self.import_image(erofs.encode(root, self.algorithm), name)

    def compute_id(self, root: erofs.Node) -> str:
        return verity_bytes(erofs.encode(root, self.algorithm), self.algorithm).hex()

    def import_image(self, data: bytes, name: str | None = None) -> str:
        """Stores an image's bytes; with a name, a ref to it."""
        return self._import_image(self._one_row(data), name)

    def _import_image(self, rows: DataFrame, name: str | None = None) -> str:
        """Stores the image in the one row (data); of it the driver learns the id."""
        rows = cut(rows)
        image_id = store.identified(rows, "data", self.algorithm).select("object_id").first().object_id
        row = self.spark.createDataFrame([(image_id, image_id)], SCHEMAS["images"])
        whole = {"images": store.upsert(self.table("images"), row, ["name"])}
        if name:
            whole["refs"] = store.upsert(self.table("refs"), self.spark.createDataFrame([("images", name, image_id)], SCHEMAS["refs"]), ["category", "name"])
        self._commit(whole, {"objects": self._new_objects(rows)})
        return image_id

    def images(self) -> DataFrame:
        return self.table("images").join(self.table("objects").select("object_id", F.col("data").alias("content")), "object_id").select(
            F.col("name").alias("image_id"), "content"
        )

    def image_objects(self, image_id: str | None = None) -> DataFrame:
        """(image_id, object_id) of what images' metadata name."""
        rows = self.images() if image_id is None else self.images().filter(F.col("image_id") == image_id)
        return erofs.image_objects(rows, algorithm=self.algorithm)

    def entries(self, image_id: str) -> DataFrame:
        rows = erofs.entry_rows(self.images().filter(F.col("image_id") == image_id), algorithm=self.algorithm)
        return rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")))).filter("error is null").drop("error")

    def create_dumpfile(self, image_id: str) -> list[str]:
        """The lines of an image's tree. One image's tree is what the caller asked to hold."""
        return dump_lines(erofs.decode(self._bytes(image_id), self.algorithm))

    def dump_files(self, image_id: str, wanted: list[str], backing_path_only: bool = False) -> DataFrame:
        """The entries of paths; a path that isn't there is an error."""
        asked = self.spark.createDataFrame([(x.encode(),) for x in wanted], "path binary")
        rows = asked.join(self.entries(image_id), "path", "left")
        lost = [bytes(r.path).decode(errors="replace") for r in rows.filter("kind is null").collect()]
        if lost:
            raise RepositoryError(f"no such paths: {lost}")
        return rows.select(
            "path", F.concat(F.substring("object_id", 1, 2), F.lit("/"), F.substring("object_id", 3, 1 << 20)).alias("backing_path")
        ) if backing_path_only else rows

    # Catalog.

    def pull(self, manifest_json: str, config_json: str, layers: DataFrame, name: str | None = None) -> str:
        """Imports an image: its layers (diff_id, content), configuration and manifest, whose digests are those of their exact bytes; what is
        there is skipped. With a name, a tag. The manifest's digest."""
        self.import_layers(layers)
        sha = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
        manifest, config = json.loads(manifest_json), json.loads(config_json)
        config_digest, digest = sha(config_json), sha(manifest_json)
        if manifest["config"]["digest"] != config_digest:
            raise RepositoryError("the manifest names another configuration")
        media = manifest["config"].get("mediaType", "")
        refs = {}
        if media == catalog.CONFIG_MEDIA_TYPE:
            ids = config.get("rootfs", {}).get("diff_ids", [])
            known = {r.name: r.object_id for r in self.table("streams").filter(F.col("name").isin([f"oci-layer-{x}" for x in ids])).collect()}
            missing = [x for x in ids if f"oci-layer-{x}" not in known]
            if missing:
                raise RepositoryError(f"no layers {missing}")
            refs = {x: known[f"oci-layer-{x}"] for x in ids}
        objects = self._new_objects(self._one_row(config_json.encode()).unionAll(self._one_row(manifest_json.encode())))
        ids = {s: verity_bytes(s.encode(), self.algorithm).hex() for s in (config_json, manifest_json)}
        config_row = self.spark.createDataFrame([(config_digest, ids[config_json], config_json, refs)], SCHEMAS["configs"])
        layer_digests = [x["digest"] for x in manifest.get("layers", [])]
        manifest_row = self.spark.createDataFrame([(digest, ids[manifest_json], manifest_json, config_digest, layer_digests, media)], SCHEMAS["manifests"])
        kinds = splitstream.CONTENT_TYPES
        stream_rows = [
            (f"oci-config-{config_digest}", ids[config_json], kinds["ociconfg"], len(config_json.encode()), [], refs),
            (f"oci-manifest-{digest}", ids[manifest_json], kinds["ocimanif"], len(manifest_json.encode()), [], {f"config:{config_digest}": ids[config_json]}),
        ]
        # A configuration that is there keeps the images that it names.
        whole = {
            "configs": store.upsert(config_row, self.table("configs").join(config_row.select("digest"), "digest", "left_semi"), ["digest"]).unionByName(
                self.table("configs").join(config_row.select("digest"), "digest", "left_anti")
            ),
            "manifests": store.upsert(self.table("manifests"), manifest_row, ["digest"]),
        }
        new_streams = self.spark.createDataFrame(stream_rows, SCHEMAS["streams"]).join(self.table("streams").select("name"), "name", "left_anti")
        subject = manifest.get("subject", {}).get("digest")
        if subject:
            whole["referrers"] = catalog.add_referrer(self.table("referrers"), subject, digest)
        if name:
            whole["refs"] = catalog.tag(self.table("refs"), name, digest)
        self._commit(whole, {"objects": objects, "streams": new_streams})
        return digest

    def import_storage(self, store_path: str, image: str, name: str | None = None) -> str:
        """Imports an image, by id or name, from a local container store in a folder that all executors see."""
        found = storage.image_by_key(storage.images(self.spark, store_path), image).first()
        if found is None:
            raise RepositoryError(f"no image {image} in {store_path}")
        return self.pull(*storage.image_layers(self.spark, store_path, found.id), name)

    def pull_layout(self, path: str, name: str | None = None) -> str:
        """Imports an image from a layout in a folder, under its tag there."""
        manifest, config, layers = oci.image(self.spark, path, name)
        return self.pull(manifest, config, layers, name)

    def upgrade(self) -> dict[str, int]:
        """Makes the file system images that tagged images lack; how many were made, were there, or are no images."""
        found = catalog.upgrade_outcomes(self.table("refs"), self.table("manifests"), self.table("configs"))
        counts = {r.outcome: r.n for r in found.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        for row in found.filter("outcome = 'upgraded'").select("digest").collect():
            self.mount_image("@" + row.digest)
        return counts

    def remove_boot_image(self, reference: str) -> None:
        """Takes the boot image's name from the image's configuration; garbage collection takes the rest."""
        manifest = catalog.resolve(self.table("refs"), self.table("manifests"), reference).first()
        self._name_image(manifest.config_digest, None, True)

    def _name_image(self, config_digest: str, image_id: str | None, boot: bool) -> None:
        """Writes an image's name into a configuration, and anew the references of its stream, although their content is the same."""
        made = self.spark.createDataFrame([(config_digest, image_id)], "digest string, image_id string")
        configs = catalog.with_image(self.table("configs"), made, boot)
        changed = configs.filter(F.col("digest") == config_digest).select(F.concat(F.lit("oci-config-"), "digest").alias("name"), "named_refs")
        self._commit({"configs": configs, "streams": catalog.rewritten(self.table("streams"), changed)})

    def _catalogued(self, reference: str) -> tuple[str, str, str, dict[str, str]]:
        """Digest and text of a reference's manifest, and of its configuration the text and its references; both texts must have their digest."""
        row = catalog.resolve(self.table("refs"), self.table("manifests"), reference).first()
        config = row and self.table("configs").filter(F.col("digest") == row.config_digest).first()
        if row is None or config is None:
            raise RepositoryError(f"no image {reference}, or none with a configuration")
        for digest, body in ((row.digest, row.json), (row.config_digest, config.json)):
            if archive.sha256_id(body.encode()) != digest:
                raise RepositoryError(f"the content of {digest} has another digest")
        return row.digest, row.json, config.json, config.named_refs or {}

    def manifest_json(self, reference: str) -> str:
        return self._catalogued(reference)[1]

    def config_json(self, reference: str) -> str:
        return self._catalogued(reference)[2]

    def open_config(self, reference: str) -> tuple[dict, dict[str, str]]:
        """A reference's configuration and the objects of its layers by digest, without the names of images made from it."""
        _, _, config, refs = self._catalogued(reference)
        return json.loads(config), {k: v for k, v in refs.items() if k not in (catalog.IMAGE_REF, catalog.BOOT_REF)}

    def label(self, reference: str, key: str) -> str | None:
        """The value of a label of a reference's configuration."""
        return ((self.open_config(reference)[0].get("config") or {}).get("Labels") or {}).get(key)

    def name_stream(self, stream: str, name: str) -> None:
        """Sets a ref to a stream that is there."""
        if self.table("streams").filter(F.col("name") == stream).isEmpty():
            raise RepositoryError(f"no stream {stream}")
        row = self.spark.createDataFrame([("streams", name, stream)], SCHEMAS["refs"])
        self._commit({"refs": store.upsert(self.table("refs"), row, ["category", "name"])})

    def oci_images(self) -> DataFrame:
        return catalog.images(self.table("refs"), self.table("manifests"), self.table("configs"), self.table("referrers"))

    def inspect(self, reference: str) -> DataFrame:
        found = catalog.resolve(self.table("refs"), self.table("manifests"), reference)
        return catalog.inspected(found, self.table("configs"), self.table("referrers"))

    def tag(self, name: str, digest: str) -> None:
        self._commit({"refs": catalog.tag(self.table("refs"), name, digest)})

    def untag(self, name: str) -> None:
        self._commit({"refs": catalog.untag(self.table("refs"), name)})

    def mount_image(self, reference: str, for_boot: bool = False) -> str:
        """The id of the file system image of a tagged image; made, stored and named in its configuration where it lacks one."""
        manifest = catalog.resolve(self.table("refs"), self.table("manifests"), reference).first()
        if manifest is None:
            raise RepositoryError(f"no image {reference}")
        have = catalog.image_of(self.table("manifests"), self.table("configs"), for_boot).filter(F.col("manifest_digest") == manifest.digest).first()
        if have is not None:
            return have.image_id
        config = self.table("configs").filter(F.col("digest") == manifest.config_digest)
        diff_ids = [r.diff_id for r in catalog.layer_diff_ids(config).orderBy("position").collect()]
        image_id = self._import_image(self.image_of(diff_ids, for_boot))
        self._name_image(manifest.config_digest, image_id, for_boot)
        return image_id

    def boot_resources(self, image_id: str) -> DataFrame:
        """The boot entries of an image's tree."""
        stored = self.table("objects").select("object_id", "data")
        rows = self.entries(image_id).join(stored, "object_id", "left").select(
            F.col("path").cast("string").alias("path"), "kind", F.coalesce("inline", "data").alias("content")
        )
        return boot.resources(rows)

    # Upkeep.

    def gc(self, extra: list[str] | None = None, dry_run: bool = False) -> DataFrame:
        """Drops what no ref or extra name reaches; the counts. Images that configurations name count as named by their streams."""
        images = F.map_filter("named_refs", lambda k, v: k.isin(catalog.IMAGE_REF, catalog.BOOT_REF))
        named = self.table("configs").select(F.explode(F.map_values(images)).alias("name"))
        named = named.unionAll(self.spark.createDataFrame([(x,) for x in extra or []], "name string"))
        streams = self.table("streams")
        kept, kept_streams, kept_images, counts = graph.gc(
            self.table("objects"), self._plain_refs(), streams, self.table("images"), self.image_objects().withColumnRenamed("image_id", "name"), named
        )
        found = counts.toPandas()
        if not dry_run:
            ids = kept.select("object_id")
            manifests = self.table("manifests").join(ids, "object_id", "left_semi")
            whole = {
                "images": kept_images,
                "manifests": manifests,
                "configs": self.table("configs").join(ids, "object_id", "left_semi"),
                "referrers": catalog.dangling_referrers(self.table("referrers"), manifests)[0],
            }
            self._commit(
                whole, parts={"objects": self._without_dead("objects", ids, "object_id"), "streams": self._without_dead("streams", kept_streams, "name")}
            )
        return self.spark.createDataFrame(found)

    def _plain_refs(self) -> DataFrame:
        return self.table("refs")

    def fsck(self, name: str | None = None) -> DataFrame:
        """All errors: of objects, links, refs, streams and images, of streams and images that can't be decoded, and of tagged images; with a name
        those of that tag alone."""
        held = self.table("objects")
        staged = check.tagged_images(catalog.tags(self.table("refs")), self.table("manifests"), self.table("configs"), held, name).filter("stage is not null")
        tagged = check.errors(staged, "image", path="name", detail="stage")
        if name is not None:
            return tagged
        named = self.image_objects().withColumnRenamed("image_id", "name")
        found = check.repository(held, self.table("streams"), self.table("images"), named, self._plain_refs(), algorithm=self.algorithm)
        # Manifests and configurations are streams without a frame.
        plain = splitstream.CONTENT_TYPES["ociconfg"], splitstream.CONTENT_TYPES["ocimanif"]
        bodies = self.table("streams").filter(~F.col("content_type").isin(*plain)).join(held.select("object_id", F.col("data").alias("content")), "object_id")
        lost_images = erofs.problems(self.images(), algorithm=self.algorithm).withColumnRenamed("image_id", "name")
        return check.union(found, check.unreadable("streams", splitstream.problems(bodies)), check.unreadable("images", lost_images), tagged)

    def pull_registry(self, base: str, repository: str, reference: str, name: str | None = None, headers: dict[str, str] | None = None) -> str:
        """Imports an image from a registry; the manifest's digest."""
        return self.pull(*mirror.image(self.spark, base, repository, reference, headers), name)

    def fetch_http(self, base: str, stream: str) -> int:
        """Copies a stream and all that it reaches from a mirror of a repository; objects that are there stay. How many were new. Each round
        fetches the streams that the last one named; then come the objects, and contents are checked against the digests that name them."""
        spark, held = self.spark, self.table("objects").select("object_id")
        root, body = mirror.stream(base, stream)
        root = root or verity_bytes(body, self.algorithm).hex()
        frontier, seen, heads, new = spark.createDataFrame([(root,)], "object_id string"), None, None, None
        names = spark.createDataFrame([], "node string, name string")
        while not frontier.isEmpty():
            there = self.table("objects").join(frontier, "object_id", "left_semi").select(
                "object_id", F.col("data").alias("content"), F.lit(False).alias("new")
            )
            came = mirror.objects(frontier.join(held, "object_id", "left_anti"), base).withColumn("new", F.lit(True))
            bodies = cut(there.unionByName(came))
            self._refuse_wrong(bodies)
            read = cut(splitstream.headers(bodies).select("object_id", "new", "content", "content_type", "total_size", "object_refs", "named_refs", "error"))
            broken = read.filter("error is not null").first()
            if broken is not None:
                raise RepositoryError(f"the stream {broken.object_id}: {broken.error}")
            heads = read if heads is None else heads.unionByName(read)
            names = names.unionByName(read.select(F.explode("named_refs").alias("name", "node")).select("node", "name")).distinct()
            seen = frontier if seen is None else seen.union(frontier)
            frontier = cut(read.select(F.explode(F.map_values("named_refs")).alias("object_id")).distinct().join(seen, "object_id", "left_anti"))
        self._refuse_two_names(names)
        ids = heads.select(F.explode("object_refs").alias("object_id")).distinct().join(heads.select("object_id"), "object_id", "left_anti")
        parts = cut(mirror.objects(ids.join(held, "object_id", "left_anti"), base))
        self._refuse_wrong(parts)
        every = heads.filter("new").select("object_id", "content").unionByName(parts)
        objects = every.select("object_id", F.octet_length("content").cast("long").alias("size"), F.col("content").alias("data"))
        # Streams that others name are known by the digest of what they hold.
        known = self.table("objects").select("object_id", "data").unionByName(objects.select("object_id", "data"))
        named = heads.join(names.withColumnRenamed("node", "object_id"), "object_id")
        whole = store.reassembled(splitstream.chunk_rows(named.select("name", "content")), known)
        wrong = whole.filter(F.col("stream_id").startswith("sha256:") & (F.concat(F.lit("sha256:"), F.sha2("data", 256)) != F.col("stream_id"))).first()
        if wrong is not None:
            raise RepositoryError(f"the content of {wrong.stream_id} has another digest")
        columns = ["name", "object_id", "content_type", "total_size", "object_refs", "named_refs"]
        streams = named.withColumn("name", F.concat(F.lit("oci-layer-"), "name")).select(*columns).unionByName(
            heads.filter(F.col("object_id") == root).withColumn("name", F.lit(stream)).select(*columns)
        )
        n = objects.count()
        self._commit(more={"objects": objects, "streams": streams.join(self.table("streams").select("name"), "name", "left_anti")})
        return n

    def _refuse_two_names(self, names: DataFrame) -> None:
        """names (node, name): a stream that others know by two names is an error, as one of them must be wrong."""
        two = graph.conflicts(names).first()
        if two is not None:
            raise RepositoryError(f"the stream {two.node} has the names {list(two.names)}")

    def _refuse_wrong(self, rows: DataFrame) -> None:
        """rows (object_id, content) whose content has another digest are an error."""
        wrong = store.verified(rows.select("object_id", "content"), "content", self.algorithm).select("named").first()
        if wrong is not None:
            raise RepositoryError(f"the content of {wrong.named} has another digest")

    def write_boot(self, image_id: str, path: str, prefix: str, insecure: bool = False, subdir: str | None = None) -> int:
        """Writes an image's boot entries below a folder that the executors share: files first, then the entries, whose kernels get the image's
        id as an argument of this prefix. Unified images are written if they name the image. How many files were written."""
        stored = self.table("objects").select("object_id", "data")
        tree_rows = self.entries(image_id).join(stored, "object_id", "left").select(
            F.col("path").cast("string").alias("path"), "kind", F.coalesce("inline", "data").alias("content")
        )
        files = boot.boot_files(tree_rows, image_id, prefix, insecure, subdir)
        return filesystem.write_rows(boot.with_folders(files), path)

    def fetch(self, other: Repository, stream: str) -> int:
        """Copies a stream and all that it reaches from another repository; objects that are there stay. How many were new."""
        theirs = other.table("streams")
        edges = theirs.select(F.col("object_id").alias("src"), F.explode(F.map_values("named_refs")).alias("dst"))
        start = theirs.filter(F.col("name") == stream).select(F.col("object_id").alias("node"))
        reached = graph.closure(edges, start).select(F.col("node").alias("object_id"))
        wanted = theirs.join(reached, "object_id", "left_semi")
        self._refuse_two_names(wanted.select(F.explode("named_refs").alias("name", "node")).select("node", "name").distinct())
        ids = reached.union(wanted.select(F.explode("object_refs"))).distinct()
        new = ids.join(self.table("objects").select("object_id"), "object_id", "left_anti")
        rows = other.table("objects").join(new, "object_id", "left_semi").select("object_id", "size", "data")
        wrong = store.verified(rows, "data", self.algorithm)
        if not wrong.isEmpty():
            raise RepositoryError("a fetched object has another digest")
        n = rows.count()
        fresh = wanted.select(*self.table("streams").columns).join(self.table("streams").select("name"), "name", "left_anti")
        self._commit(more={"objects": rows, "streams": fresh})
        return n


def dump_lines(root: erofs.Node) -> list[str]:
    """A tree as dump lines: in tree order, the first path of a leaf in full, the others as links."""
    out, first = [], {}
    links: dict[int, int] = {}
    rows = list(erofs.rows_of(root))
    for _, _, leaf in rows:
        if leaf is not None:
            links[leaf] = links.get(leaf, 0) + 1
    for path, n, leaf in rows:
        if leaf is not None and leaf in first:
            out.append(dumpfile.link_line(path, first[leaf]))
            continue
        first[leaf] = path
        nlink = 2 + sum(c.kind == "dir" for c in n.children.values()) if n.kind == "dir" else links[leaf]
        size = n.size if n.object_id is not None else len(n.inline or b"") if n.kind == "reg" else len(n.target) if n.kind == "lnk" else 0
        payload = f"{n.object_id[:2]}/{n.object_id[2:]}".encode() if n.object_id is not None else n.target
        out.append(
            dumpfile.line(
                path,
                erofs.TYPES[n.kind][1] | n.mode,
                size,
                nlink,
                n.uid,
                n.gid,
                n.rdev,
                n.mtime,
                payload,
                n.inline or b"" if n.kind == "reg" else b"",
                n.object_id,
                n.xattrs,
            )
        )
    return out
