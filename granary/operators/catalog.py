"""Catalog queries over refs, manifests, configurations, layers and referrers.

manifests: (digest, object_id, json, config_digest, layer_digests array, config_media_type, layer_refs map); configs: (digest, object_id,
json, named_refs map). JSON columns hold the exact bytes as text; they are read, never written anew.

Manifests, references and referrers meet by merge joins: the planner takes digests and what is read from texts for far less than they are, and would
broadcast whole tables through the driver. Configurations are left to the planner, as many manifests may share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .store import upsert

CONFIG_MEDIA_TYPE = "application/vnd.oci.image.config.v1+json"
TAG_PREFIX = "oci/"
#: Keys of a configuration's references that name images made from it rather than layers.
IMAGE_REF, BOOT_REF = "image", "image.boot"
CONFIG = "architecture string, os string, created string, config struct<Labels: map<string, string>>, rootfs struct<diff_ids: array<string>>"


def tags(refs: DataFrame) -> DataFrame:
    """(name, digest) of tags on manifests; refs that are none are left out."""
    digest = F.regexp_extract("target", r"(?:\A|/)oci-manifest-(sha(?:256|512):[0-9a-f]+)\z", 1)
    mine = refs.filter((F.col("category") == "streams") & F.col("name").startswith(TAG_PREFIX) & (digest != ""))
    return mine.select(text.decode_tag(F.substring("name", len(TAG_PREFIX) + 1, 1 << 20)).alias("name"), digest.alias("digest"))


def tag(refs: DataFrame, name: str, digest: str) -> DataFrame:
    """refs with a tag set."""
    if name.startswith("@"):
        raise ValueError("names don't begin with @")
    spark = refs.sparkSession
    encoded = name.replace("%", "%25").replace("/", "%2F")
    change = spark.createDataFrame([("streams", TAG_PREFIX + encoded, f"oci-manifest-{digest}")], "category string, name string, target string")
    return upsert(refs, change, ["category", "name"])


def untag(refs: DataFrame, name: str) -> DataFrame:
    encoded = name.replace("%", "%25").replace("/", "%2F")
    return refs.filter(~((F.col("category") == "streams") & (F.col("name") == TAG_PREFIX + encoded)))


def resolve(refs: DataFrame, manifests: DataFrame, reference: str) -> DataFrame:
    """The manifest of a digest, written after an @, or of a tag."""
    if reference.startswith("@"):
        return manifests.filter(F.col("digest") == reference[1:])
    return manifests.join(tags(refs).filter(F.col("name") == reference).select("digest"), "digest", "left_semi")


def names_under(refs: DataFrame, category: str, prefix: str = "") -> DataFrame:
    """(name, target) of refs one level below a prefix, by the part of their name after it; an empty prefix lists the top."""
    head = prefix.strip("/") + "/" if prefix.strip("/") else ""
    rest = F.substring("name", len(head) + 1, 1 << 20)
    return refs.filter((F.col("category") == category) & F.col("name").startswith(head) & (rest != "") & ~rest.contains("/")).select(
        rest.alias("name"), "target"
    )


def known_names(wanted: DataFrame, refs: DataFrame, streams: DataFrame) -> DataFrame:
    """wanted (name) with known: there is a ref of that name and the stream that it leads to."""
    sound = refs.filter(F.col("category") == "streams").join(streams.select(F.col("name").alias("target")).hint("merge"), "target", "left_semi").select(
        "name", F.lit(True).alias("known")
    ).distinct()
    return wanted.join(sound.hint("merge"), "name", "left").select(*wanted.columns, F.coalesce("known", F.lit(False)).alias("known"))


def layer_at(manifests: DataFrame, position: int) -> DataFrame:
    """(digest, layer_digest, media_type, is_blob) of the layer at a position; a layer that is an archive is no blob. Null where there is none."""
    layer = F.get(F.from_json("json", "layers array<struct<digest: string, mediaType: string>>")["layers"], position)
    return manifests.select(
        "digest",
        layer["digest"].alias("layer_digest"),
        layer["mediaType"].alias("media_type"),
        (~text.is_tar_media_type(F.coalesce(layer["mediaType"], F.lit("")))).alias("is_blob"),
    )


def rewritten(streams: DataFrame, changes: DataFrame) -> DataFrame:
    """streams whose named references are those of changes (name, named_refs), although their content stays."""
    rows = streams.join(changes.withColumnRenamed("named_refs", "_refs"), "name", "left")
    return rows.withColumn("named_refs", F.coalesce("_refs", "named_refs")).select(*streams.columns)


def is_container(config_media_type: Column) -> Column:
    return config_media_type == CONFIG_MEDIA_TYPE


def images(refs: DataFrame, manifests: DataFrame, configs: DataFrame, referrers: DataFrame) -> DataFrame:
    """A row for each tag whose manifest and configuration can be read."""
    counts = referrers.join(
        manifests.select(F.col("digest").alias("artifact")).hint("merge"), "artifact", "left_semi"
    ).distinct().groupBy(F.col("subject").alias("digest")).agg(F.count("*").alias("n"))
    parsed = configs.select(F.col("digest").alias("config_digest"), F.from_json("json", CONFIG).alias("c"))
    rows = tags(refs).join(manifests.hint("merge"), "digest").join(parsed, "config_digest").join(counts.hint("merge"), "digest", "left")
    blank = F.lit("")
    container = is_container(F.col("config_media_type"))
    return rows.select(
        "name", F.col("digest").alias("manifest_digest"), container.alias("is_container"), F.when(
            container, F.coalesce("c.architecture", blank)
        ).otherwise(blank).alias("architecture"),
        F.when(container, F.coalesce("c.os", blank)).otherwise(blank).alias("os"), F.when(
            container, F.col("c.created")
        ).alias("created"), F.size("layer_digests").alias("layer_count"), F.coalesce("n", F.lit(0)).alias("referrer_count"),
    )


def labels(configs: DataFrame) -> DataFrame:
    """(digest, key, value) of configurations' labels."""
    return configs.select("digest", F.explode(F.from_json("json", CONFIG)["config"]["Labels"]).alias("key", "value"))


def layer_diff_ids(configs: DataFrame) -> DataFrame:
    return configs.select("digest", F.posexplode(F.from_json("json", CONFIG)["rootfs"]["diff_ids"]).alias("position", "diff_id"))


def layer_objects(configs: DataFrame) -> DataFrame:
    """(digest, diff_id, object_id): a configuration's references without the two that name images."""
    return configs.select("digest", F.explode(F.map_filter("named_refs", lambda k, v: ~k.isin(IMAGE_REF, BOOT_REF))).alias("diff_id", "object_id"))


def image_of(manifests: DataFrame, configs: DataFrame, boot: bool = False) -> DataFrame:
    """(manifest_digest, image_id) where the manifest's configuration names an image."""
    key = BOOT_REF if boot else IMAGE_REF
    named = configs.select(F.col("digest").alias("config_digest"), F.try_element_at("named_refs", F.lit(key)).alias("image_id")).filter("image_id is not null")
    return manifests.select(F.col("digest").alias("manifest_digest"), "config_digest").join(named, "config_digest").select("manifest_digest", "image_id")


def with_image(configs: DataFrame, images_made: DataFrame, boot: bool = False) -> DataFrame:
    """configs that name the images made, (digest, image_id); a null image takes the name away."""
    key = BOOT_REF if boot else IMAGE_REF
    rows = configs.join(images_made.withColumn("_hit", F.lit(True)), "digest", "left")
    bare = F.map_filter("named_refs", lambda k, v: k != key)
    refs = F.when(F.col("_hit").isNull(), F.col("named_refs")).when(F.col("image_id").isNull(), bare).otherwise(
        F.map_concat(bare, F.create_map(F.lit(key), F.col("image_id")))
    )
    return rows.withColumn("named_refs", refs).drop("image_id", "_hit")


def referrers_of(referrers: DataFrame, manifests: DataFrame, subject: str | None = None) -> DataFrame:
    """(subject, artifact, object_id) of artifacts that are still there."""
    mine = referrers if subject is None else referrers.filter(F.col("subject") == subject)
    there = manifests.select(F.col("digest").alias("artifact"), "object_id").hint("merge")
    return mine.distinct().join(there, "artifact").select("subject", "artifact", "object_id")


def add_referrer(referrers: DataFrame, subject: str, artifact: str) -> DataFrame:
    row = referrers.sparkSession.createDataFrame([(subject, artifact)], "subject string, artifact string")
    return referrers.unionByName(row).distinct()


def remove_referrer(referrers: DataFrame, subject: str, artifact: str | None = None) -> DataFrame:
    """Without one edge, or without all edges of a subject."""
    test = F.col("subject") == subject
    return referrers.filter(~(test if artifact is None else test & (F.col("artifact") == artifact)))


def dangling_referrers(referrers: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that stay, and those whose subject is gone."""
    known = manifests.select(F.col("digest").alias("subject")).hint("merge")
    return referrers.join(known, "subject", "left_semi"), referrers.join(known, "subject", "left_anti")


def inspected(manifests: DataFrame, configs: DataFrame, referrers: DataFrame) -> DataFrame:
    """(digest, json): manifest, configuration and referrers in one document."""
    found = referrers_of(referrers, manifests).groupBy(F.col("subject").alias("digest")).agg(F.sort_array(F.collect_list("artifact")).alias("artifacts"))
    rows = manifests.join(configs.select(F.col("digest").alias("config_digest"), F.col("json").alias("config_json")), "config_digest", "left").join(
        found.hint("merge"), "digest", "left"
    )
    listed = F.transform(F.coalesce("artifacts", F.array().cast("array<string>")), lambda a: F.struct(a.alias("digest")))
    # The two documents go in as they are.
    body = F.concat(
        F.lit('{"manifest":'), "json", F.lit(',"config":'), F.coalesce("config_json", F.lit("null")), F.lit(',"referrers":'), F.to_json(listed), F.lit("}")
    )
    return rows.select("digest", body.alias("json"))


def layer_info(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Of streams of layers: entries, external bytes counted for each entry, distinct external objects, and inline bytes."""
    external = F.col("object_id").isNotNull()
    sizes = chunks.groupBy("stream_id").agg(F.sum("size").alias("size"), F.sum(F.when(external, F.col("size")).otherwise(0)).alias("external_size"))
    distinct = chunks.filter(external).select("stream_id", "object_id").distinct().groupBy("stream_id").agg(F.count("*").alias("external_objects"))
    counts = entries.groupBy(F.col("archive").alias("stream_id")).agg(F.count("*").alias("entry_count"))
    rows = sizes.join(distinct, "stream_id", "left").join(counts, "stream_id", "left").na.fill(0)
    return rows.withColumn("inline_size", F.greatest(F.col("size") - F.col("external_size"), F.lit(0)))


def upgrade_outcomes(refs: DataFrame, manifests: DataFrame, configs: DataFrame) -> DataFrame:
    """Tagged manifests by what an upgrade does: images that lack their file system get one, those that have it stay, artifacts are
    skipped."""
    tagged = manifests.join(tags(refs).select("digest").distinct().hint("merge"), "digest", "left_semi")
    have = image_of(manifests, configs).select(F.col("manifest_digest").alias("digest"), F.lit(True).alias("has"))
    rows = tagged.join(have.hint("merge"), "digest", "left")
    outcome = F.when(~is_container(F.col("config_media_type")), "skipped").when(F.col("has").isNull(), "upgraded").otherwise("current")
    return rows.select("digest", outcome.alias("outcome"))


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of a listing."""
    return rows.orderBy(*order).offset(offset).limit(limit)
