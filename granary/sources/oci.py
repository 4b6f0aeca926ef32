"""Image layouts in folders: an index, manifests, configurations and layers as blobs named by their digest."""

from __future__ import annotations

import gzip
import json

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_tar_media_type

REF_NAME = "org.opencontainers.image.ref.name"


class LayoutError(ValueError):
    """A layout that lacks a blob or holds one with another digest."""


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(digest, content) of a layout's blobs. A filter on digest reads the content of those blobs alone where it is given to the
    path: see ``blob``."""
    files = spark.read.format("binaryFile").load(f"{path}/blobs/sha256/*")
    return files.select(F.concat(F.lit("sha256:"), F.regexp_extract("path", r"([0-9a-f]{64})\z", 1)).alias("digest"), "content")


def blob(spark: SparkSession, path: str, digest: str) -> bytes:
    """One small blob, such as a manifest; its digest must hold."""
    kind, _, name = digest.partition(":")
    row = spark.read.format("binaryFile").load(f"{path}/blobs/{kind}/{name}").select(
        "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("real")
    ).first()
    if row is None or row.real != digest:
        raise LayoutError(f"{digest} has another digest")
    return bytes(row.content)


def broken(found: DataFrame) -> DataFrame:
    """Blobs whose content has another digest than their name."""
    return found.filter(F.concat(F.lit("sha256:"), F.sha2("content", 256)) != F.col("digest")).select("digest")


def index(spark: SparkSession, path: str) -> list[dict]:
    """The manifests that the index lists: digest, media type, tag."""
    body = json.loads(spark.read.text(f"{path}/index.json", wholetext=True).first()[0])
    return [{"digest": m["digest"], "media_type": m.get("mediaType"), "name": m.get("annotations", {}).get(REF_NAME)} for m in body["manifests"]]


def _inflate(content: bytes, media_type: str) -> bytes:
    content = bytes(content)
    if media_type.endswith("gzip"):
        return gzip.decompress(content)
    if media_type.endswith("zstd"):
        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return content


inflated = F.udf(_inflate, T.BinaryType(), useArrow=False)


def layers(spark: SparkSession, path: str, descriptors: list[dict], diff_ids: list[str]) -> DataFrame:
    """(position, diff_id, media_type, is_tar, content) of a manifest's layers, decompressed by their media type. Lists of layers and
    of digests go together by position; a layer whose decompressed digest is another is an error row, with a null content."""
    if len(descriptors) != len(diff_ids):
        raise LayoutError(f"{len(descriptors)} layers and {len(diff_ids)} digests")
    wanted = spark.createDataFrame(
        [(k, d["digest"], i, d.get("mediaType", ""), d.get("size", 0)) for k, (d, i) in enumerate(zip(descriptors, diff_ids, strict=True))],
        "position int, digest string, diff_id string, media_type string, size long",
    )
    files = [f"{path}/blobs/{d['digest'].replace(':', '/')}" for d in descriptors]
    found = spark.read.format("binaryFile").load(files).select(
        F.concat(F.lit("sha256:"), F.regexp_extract("path", r"([0-9a-f]{64})\z", 1)).alias("digest"), "content"
    )
    rows = wanted.join(found, "digest").withColumn("content", inflated("content", "media_type"))
    ok: Column = F.concat(F.lit("sha256:"), F.sha2("content", 256)) == F.col("diff_id")
    return rows.select(
        "position", "diff_id", "media_type", is_tar_media_type(F.col("media_type")).alias("is_tar"), F.when(ok, F.col("content")).alias("content")
    )


def image(spark: SparkSession, path: str, name: str | None = None) -> tuple[str, str, DataFrame]:
    """Manifest, configuration and layers of a tag, or of the only manifest."""
    found = [m for m in index(spark, path) if name is None or m["name"] == name]
    if len(found) != 1:
        raise LayoutError(f"{len(found)} manifests of the name {name}")
    manifest = blob(spark, path, found[0]["digest"]).decode()
    parsed = json.loads(manifest)
    config = blob(spark, path, parsed["config"]["digest"]).decode()
    ids = json.loads(config).get("rootfs", {}).get("diff_ids", [])
    rows = layers(spark, path, parsed.get("layers", []), ids)
    if not rows.filter("content is null").isEmpty():
        raise LayoutError("a layer has another digest than its configuration says")
    return manifest, config, rows.select("diff_id", "content")
