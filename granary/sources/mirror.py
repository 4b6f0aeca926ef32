"""Objects, streams and images over HTTP: mirrors of repositories and registries of images.

Contents are fetched by tasks, each over its part of a list, and checked where they arrive; the driver sees lists, manifests and configurations alone.
A fetch that fails is tried again a few times, as is the task that runs it.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import object_path
from . import oci

TRIES, TIMEOUT = 3, 60
#: What a mirror says of a name that leads to an object, and the media types of manifests.
LINK = "text/x-symlink-target"
MANIFESTS = ("application/vnd.oci.image.manifest.v1+json", "application/vnd.docker.distribution.manifest.v2+json")


class MirrorError(ValueError):
    """What is not there, or is not what its name says."""


def get(url: str, headers: dict[str, str] | None = None) -> tuple[bytes, str]:
    """Body and media type."""
    for attempt in range(TRIES):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=TIMEOUT) as answer:
                return answer.read(), answer.headers.get_content_type()
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt == TRIES - 1:
                raise MirrorError(f"{url}: {e.code}") from e
        except OSError as e:
            if attempt == TRIES - 1:
                raise MirrorError(f"{url}: {e}") from e
        time.sleep(2**attempt)
    raise MirrorError(url)


def fetched(rows: DataFrame, url: str, headers: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with content: the body at the address in column ``url``. Each row is fetched by the task that has it."""
    names = rows.columns
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(url)).to_pylist()
            for k, address in enumerate(at):
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([get(address, headers)[0]], pa.binary())], [*names, "content"])

    dealt = rows.repartition(parts or rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(work, kinds + ", content binary")


def objects(ids: DataFrame, base: str) -> DataFrame:
    """(object_id, content) of the ids from a mirror's objects folder."""
    address = F.concat(F.lit(f"{base.rstrip('/')}/objects/"), object_path(F.col("object_id")))
    return fetched(ids.select("object_id", address.alias("url")), "url").select("object_id", "content")


def stream(base: str, name: str) -> tuple[str | None, bytes]:
    """The object that a mirror's name leads to, or the stream itself where the mirror gives that."""
    body, kind = get(f"{base.rstrip('/')}/streams/{name}")
    return (body.decode().strip().rsplit("objects/", 1)[-1].replace("/", ""), body) if kind == LINK else (None, body)


def image(spark: SparkSession, base: str, repository: str, reference: str, headers: dict[str, str] | None = None) -> tuple[str, str, DataFrame]:
    """Manifest, configuration and layers (diff_id, content) of an image in a registry, by tag or digest. Layers are fetched, checked against
    both their digests and decompressed by the tasks that have them."""
    root = f"{base.rstrip('/')}/v2/{repository}"
    manifest, _ = get(f"{root}/manifests/{reference}", {"Accept": ", ".join(MANIFESTS)} | (headers or {}))
    sha = lambda data: "sha256:" + hashlib.sha256(data).hexdigest()
    if reference.startswith("sha256:") and sha(manifest) != reference:
        raise MirrorError(f"the manifest is not {reference}")
    parsed = json.loads(manifest)
    config, _ = get(f"{root}/blobs/{parsed['config']['digest']}", headers)
    if sha(config) != parsed["config"]["digest"]:
        raise MirrorError("the configuration has another digest")
    layers = parsed.get("layers", [])
    wanted = json.loads(config).get("rootfs", {}).get("diff_ids", [x["digest"] for x in layers])
    if len(layers) != len(wanted):
        raise MirrorError(f"{len(layers)} layers and {len(wanted)} digests")
    rows = [(x["digest"], d, x.get("mediaType", ""), f"{root}/blobs/{x['digest']}") for x, d in zip(layers, wanted, strict=True)]
    found = fetched(spark.createDataFrame(rows, "digest string, diff_id string, media_type string, url string"), "url", headers)
    is_sha = lambda name, of: F.concat(F.lit("sha256:"), F.sha2(of, 256)) == F.col(name)
    body = F.when(is_sha("digest", "content"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("a layer is not "), "digest")))
    whole = found.withColumn("content", body).withColumn("content", oci.inflated("content", "media_type"))
    body = F.when(is_sha("diff_id", "content"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("a layer is not "), "diff_id")))
    return manifest.decode(), config.decode(), whole.select("diff_id", body.alias("content"))
