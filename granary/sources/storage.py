"""Local container storage: its JSON tables, look-ups over several stores, layer chains."""

from __future__ import annotations

import base64
import gzip
import json
import os
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..schemas import IMAGES_JSON, LAYERS_JSON, TAR_SPLIT
from . import archive


def layers(spark: SparkSession, store: str) -> DataFrame:
    """id, parent, diff_digest, diff_size and compressed_size of a store's layers.json."""
    rows = spark.read.schema(LAYERS_JSON).option("multiLine", True).json(f"{store}/overlay-layers/layers.json")
    return rows.select(
        "id", "parent", F.col("diff-digest").alias("diff_digest"), F.col("diff-size").alias("diff_size"), F.col("compressed-size").alias("compressed_size")
    )


def images(spark: SparkSession, store: str) -> DataFrame:
    """id and names of a store's images.json; without names, an empty list."""
    return spark.read.schema(IMAGES_JSON).option("multiLine", True).json(f"{store}/overlay-images/images.json").withColumn(
        "names", F.coalesce("names", F.array().cast("array<string>"))
    )


def every_store(spark: SparkSession, stores: list[str], table=layers) -> DataFrame:  # noqa: ANN001
    """The rows of several stores with store_rank, the first store first."""
    out = None
    for rank, store in enumerate(stores):
        rows = table(spark, store).withColumn("store_rank", F.lit(rank))
        out = rows if out is None else out.unionAll(rows)
    return out


def additional_stores(options: str) -> list[str]:
    """Stores named by additionalimagestore= in a comma list of options."""
    return [x.partition("=")[2] for x in options.split(",") if x.strip().startswith("additionalimagestore=") and x.partition("=")[2]]


def config(content: str) -> dict:
    """A storage configuration's driver, roots and additional stores."""
    storage = tomllib.loads(content).get("storage", {})
    return {
        "driver": storage.get("driver"),
        "graphroot": storage.get("graphroot"),
        "runroot": storage.get("runroot"),
        "stores": storage.get("options", {}).get("additionalimagestores", []),
    }


def diff_ids(config_json: Column) -> Column:
    """A configuration's layer digests without the name of their hash."""
    return F.transform(
        F.from_json(config_json, "rootfs struct<diff_ids: array<string>>")["rootfs"]["diff_ids"], lambda x: F.regexp_replace(x, r"\Asha256:", "")
    )


def config_key(name: str) -> str:
    """The file name under which a store keeps a value of this key."""
    return "=" + base64.b64encode(name.encode()).decode()


def resolved(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (position, diff_digest) with the id of the layer in the first store that has it, in order; null where none has."""
    order = Window.partitionBy("diff_digest").orderBy("store_rank", "id")
    ranked = known if "store_rank" in known.columns else known.withColumn("store_rank", F.lit(0))
    best = ranked.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("diff_digest", "id", "store_rank")
    return wanted.join(best, "diff_digest", "left").select("position", "diff_digest", "id", "store_rank")


def named(found: DataFrame, name: str) -> DataFrame:
    """The image of a name: the whole name, then a name that ends in it after a slash, then either with the tag latest."""
    rows = found.select("id", F.explode("names").alias("name"))
    last = lambda n: F.col("name").endswith("/" + n)
    tagged = f"{name}:latest"
    tier = F.when(F.col("name") == name, 1).when(last(name), 2).when((F.col("name") == tagged) | last(tagged), 3)
    return rows.withColumn("tier", tier).filter("tier is not null").orderBy("tier", "name", "id").limit(1)


def image_size(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(image_id, size): the sum of the sizes of an image's layers, those without a size counting nothing."""
    return wanted.join(known.select(F.col("id").alias("layer_id"), "diff_size"), "layer_id", "left").groupBy("image_id").agg(
        F.sum(F.coalesce("diff_size", F.lit(0))).alias("size")
    )


def chain(known: DataFrame, start: str, depth: int = 500) -> DataFrame:
    """(id, depth) of a layer and its ancestors."""
    edges = known.filter("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    roots = known.sparkSession.createDataFrame([(start,)], "node string")
    return graph.closure(edges, roots, depth=depth).withColumnRenamed("node", "id")


def first_in_chain(files: DataFrame, chained: DataFrame) -> DataFrame:
    """Of files (layer_id, path, ...) the one nearest to the start of the chain for each path."""
    values = [x for x in files.columns if x != "path"]
    return files.join(
        chained.withColumnRenamed("id", "layer_id"), "layer_id"
    ).groupBy("path").agg(F.min_by(F.struct(*values), "depth").alias("hit"), F.min("depth").alias("depth")).select("path", "depth", "hit.*")


def lower_links(lower: Column) -> Column:
    """Link names of a layer's list of those below it."""
    return F.transform(F.filter(F.split(lower, ":"), lambda x: x.startswith("l/")), lambda x: F.substring(x, 3, 1 << 20))


def link_target(target: Column) -> Column:
    """The layer that a short link leads to: the folder above the last."""
    return F.element_at(F.split(target, "/"), -2)


def tar_split(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives taken apart, from NDJSON that may be compressed, with payloads as bytes."""
    return spark.read.schema(TAR_SPLIT).json(path).withColumn("payload", F.unbase64("payload"))


def layer_sizes(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (layer_id) with the layer's parent and sizes."""
    return wanted.join(known.select(F.col("id").alias("layer_id"), "parent", "diff_size", "compressed_size"), "layer_id", "left")


def image_by_key(found: DataFrame, key: str) -> DataFrame:
    """The image of an id, else of a name."""
    by_id = found.filter(F.col("id") == key).select("id", F.lit(key).alias("name"), F.lit(0).alias("tier"))
    return by_id.unionAll(named(found, key).select("id", "name", "tier")).orderBy("tier").limit(1)


def zipped(images: DataFrame) -> DataFrame:
    """(image_id, position, layer_id, diff_id, error) of images (image_id, layer_ids, diff_ids), lists paired by position. Lists of different
    lengths don't belong together: such an image is one row with an error."""
    x, y = F.size("layer_ids"), F.size("diff_ids")
    error = F.when(x != y, F.concat(x.cast("string"), F.lit(" layers and "), y.cast("string"), F.lit(" digests")))
    pairs = F.when(error.isNull(), F.arrays_zip("layer_ids", "diff_ids"))
    return images.select("image_id", error.alias("error"), F.posexplode_outer(pairs).alias("position", "pair")).select(
        "image_id", "position", F.col("pair.layer_ids").alias("layer_id"), F.col("pair.diff_ids").alias("diff_id"), "error"
    )


def layer_archives(wanted: DataFrame, store: str) -> DataFrame:
    """(diff_id, content) of layers (layer_id, diff_id, chain): each layer's archive from its records and the files in its folder or that of
    one below it, the chain's order. The store is a folder that all executors see; a layer is a row, so it fits in memory."""
    root = store.removeprefix("file://").rstrip("/")

    def content_in(chain: list[str]) -> Callable[[str], bytes]:
        def content_of(name: str) -> bytes:
            for layer in chain:
                at = os.path.join(root, "overlay", layer, "diff", name)
                if os.path.isfile(at) and not os.path.islink(at):
                    with open(at, "rb") as f:
                        return f.read()
            raise archive.ArchiveError(f"no layer has {name}")

        return content_of

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer, diff_id, chain in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with gzip.open(os.path.join(root, "overlay-layers", f"{layer}.tar-split.gz"), "rt") as records:
                    body = archive.from_tar_split((x for x in records if x.strip()), content_in([layer, *chain]))
                if archive.sha256_id(body) != diff_id:
                    raise archive.ArchiveError(f"the layer {layer} is not {diff_id}")
                yield pa.RecordBatch.from_arrays([pa.array([diff_id]), pa.array([body], pa.binary())], ["diff_id", "content"])

    return wanted.select("layer_id", "diff_id", "chain").mapInArrow(work, "diff_id string, content binary")


def image_layers(spark: SparkSession, store: str, image_id: str) -> tuple[str, str, DataFrame]:
    """Manifest, configuration and layers (diff_id, content) of an image in a store. The configuration's layers are those of the chain that
    ends in the image's top layer, paired by position."""
    read = lambda name: spark.read.text(f"{store}/overlay-images/{image_id}/{name}", wholetext=True).first()[0]
    manifest = read("manifest")
    config_json = read(config_key(json.loads(manifest)["config"]["digest"]))
    wanted = json.loads(config_json).get("rootfs", {}).get("diff_ids", [])
    top = spark.read.schema("id string, layer string").option("multiLine", True).json(f"{store}/overlay-images/images.json").filter(
        F.col("id") == image_id
    ).first()
    known = layers(spark, store)
    chained = [r.id for r in chain(known, top.layer).orderBy("depth").collect()] if top and top.layer else []
    # The chain begins with the top layer, the digests with the lowest one.
    pairs = zipped(spark.createDataFrame([(image_id, chained[::-1], wanted)], "image_id string, layer_ids array<string>, diff_ids array<string>")).collect()
    if any(p.error for p in pairs):
        raise archive.ArchiveError(pairs[0].error)
    rows = [(p.layer_id, p.diff_id, chained[len(chained) - p.position :]) for p in pairs if p.layer_id is not None]
    return manifest, config_json, layer_archives(spark.createDataFrame(rows, "layer_id string, diff_id string, chain array<string>"), store)
