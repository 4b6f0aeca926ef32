"""Integrity as constraint queries: each gives rows of one error table, and a repository is sound if none has any.

The errors' columns are type, path, object_id, ref_name and detail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import ALGORITHMS, verity
from ..schemas import META_JSON
from .common import one_row

COLUMNS = ("type", "path", "object_id", "ref_name", "detail")
KNOWN_VERSION = 1


def errors(rows: DataFrame, kind: str, **values: Column | str) -> DataFrame:
    made = {k: F.col(v) if isinstance(v, str) else v for k, v in values.items()}
    return rows.select(F.lit(kind).alias("type"), *(made.get(k, F.lit(None)).cast("string").alias(k) for k in COLUMNS[1:]))


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, found)


def metadata_problem(json: Column, known: tuple[str, ...] = ()) -> Column:
    """What is wrong with metadata: unreadable, of another version or algorithm, or features that forbid reading; null for none."""
    m = F.from_json(json, META_JSON)
    bad_features = F.array_except(F.coalesce(m["features"]["incompatible"], F.array().cast("array<string>")), F.array(*map(F.lit, known)).cast("array<string>"))
    named = F.regexp_extract(m["algorithm"], r"\Afsverity-(sha256|sha512)-12\z", 1)
    return F.when(m["version"].isNull(), "unreadable").when(m["version"] != KNOWN_VERSION, "version").when(named == "", "algorithm").when(
        F.size(bad_features) > 0, "features"
    )


def metadata(rows: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """Errors of metadata in rows (json)."""
    found = rows.withColumn("problem", metadata_problem(F.col("json"), known)).filter("problem is not null")
    return errors(found, "metadata", path=F.lit("meta.json"), detail="problem")


def write_access(features: Column, known: list[str]) -> Column:
    """read-write, or read-only where a read-only-compatible feature is unknown, or rejected where an incompatible one is."""
    unknown = lambda name: F.size(
        F.array_except(F.coalesce(features[name], F.array().cast("array<string>")), F.array(*map(F.lit, known)).cast("array<string>"))
    ) > 0
    return F.when(unknown("incompatible"), "rejected").when(unknown("read-only-compatible"), "read-only").otherwise("read-write")


def objects(rows: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """rows (object_id, data): names that are no digest, and contents with another digest than their name. Contents are hashed
    where they lie; nothing is shuffled."""
    size = 2 * ALGORITHMS[algorithm][1]
    named = F.col("object_id").rlike(rf"\A[0-9a-f]{{{size}}}\z")
    measured = rows.withColumn("measured", F.when(named, verity(F.col("data"), algorithm)))
    problem = F.when(~named, "object name").when(F.col("data").isNull(), "object unreadable").when(F.col("measured") != F.col("object_id"), "object digest")
    found = measured.withColumn("problem", problem).filter("problem is not null")
    return found.select(
        F.col("problem").alias("type"),
        F.concat(F.lit("objects/"), F.substring("object_id", 1, 2), F.lit("/"), F.substring("object_id", 3, 1 << 20)).alias("path"),
        "object_id",
        F.lit(None).cast("string").alias("ref_name"),
        F.col("measured").alias("detail"),
    )


def links(category: str, rows: DataFrame, known_objects: DataFrame) -> DataFrame:
    """Streams or images (name, object_id) whose object is missing."""
    return errors(
        rows.join(known_objects.select("object_id"), "object_id", "left_anti"),
        "broken link",
        path=F.concat(F.lit(category + "/"), "name"),
        object_id="object_id",
    )


def refs(rows: DataFrame, streams: DataFrame, images: DataFrame) -> DataFrame:
    """Refs (category, name, target) to streams or images that don't exist."""
    known = streams.select(F.lit("streams").alias("category"), F.col("name").alias("target")).unionAll(images.select(F.lit("images"), "name"))
    lost = rows.join(known.distinct(), ["category", "target"], "left_anti")
    return errors(lost, "broken ref", path=F.concat("category", F.lit("/refs/"), "name"), ref_name="name", detail="target")


def stream_refs(streams: DataFrame, known_objects: DataFrame) -> DataFrame:
    """Objects and named refs of streams that are missing."""
    known = known_objects.select("object_id")
    by_object = streams.select("name", F.explode("object_refs").alias("object_id")).join(known, "object_id", "left_anti")
    by_name = streams.select("name", F.explode("named_refs").alias("ref_name", "object_id")).join(known, "object_id", "left_anti")
    at = F.concat(F.lit("streams/"), "name")
    return errors(by_object, "missing object", path=at, object_id="object_id").unionAll(
        errors(by_name, "missing named ref", path=at, object_id="object_id", ref_name="ref_name")
    )


def image_objects(rows: DataFrame, known_objects: DataFrame) -> DataFrame:
    """rows (name, object_id) of what images' metadata name."""
    return errors(
        rows.join(known_objects.select("object_id"), "object_id", "left_anti"), "missing object", path=F.concat(F.lit("images/"), "name"), object_id="object_id"
    )


def unreadable(category: str, rows: DataFrame) -> DataFrame:
    """rows (name, error) of streams or images that can't be decoded."""
    return errors(rows, f"unreadable {category.removesuffix('s')}", path=F.concat(F.lit(category + "/"), "name"), detail="error")


def repository(
    held: DataFrame, streams: DataFrame, images: DataFrame, named: DataFrame, all_refs: DataFrame, meta: DataFrame | None = None, algorithm: str = "sha256"
) -> DataFrame:
    """All errors of a repository that its tables show; contents that can't be decoded are ``unreadable``."""
    found = [
        objects(held, algorithm),
        links("streams", streams, held),
        links("images", images, held),
        refs(all_refs, streams, images),
        stream_refs(streams, held),
        image_objects(named, held),
    ]
    return union(*([metadata(meta)] if meta is not None else []), *found)


def counts(held: DataFrame, streams: DataFrame, images: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how much was checked and how many errors there are; sound where there are none."""
    checked = [
        held.agg(F.count("*").alias("objects_checked")), streams.agg(F.count("*").alias("streams_checked")), images.agg(F.count("*").alias("images_checked"))
    ]
    wrong = found.agg(
        F.count("*").alias("errors"),
        F.count_if(F.col("type").startswith("object ")).alias("objects_corrupted"),
        F.count_if(F.col("type").startswith("broken")).alias("broken_links"),
        F.count_if(F.col("type").startswith("missing")).alias("missing_objects"),
    )
    return one_row([*checked, wrong]).withColumn("is_ok", F.col("errors") == 0)


def tagged_images(tags: DataFrame, manifests: DataFrame, configs: DataFrame, known_objects: DataFrame, name: str | None = None) -> DataFrame:
    """(name, stage): the first check that each tag, or the one of a name, fails: manifest missing, manifest digest, configuration missing,
    configuration digest, layer missing; null for sound ones."""
    tags = tags if name is None else tags.filter(F.col("name") == name)
    named = configs.select(F.col("digest").alias("config_digest"), F.explode(F.map_values("named_refs")).alias("object_id"))
    layers = named.join(known_objects.select("object_id"), "object_id", "left_anti").groupBy("config_digest").agg(F.count("*").alias("lost"))
    rows = tags.join(manifests.withColumnRenamed("json", "m_json").withColumn("has_m", F.lit(True)), "digest", "left")
    rows = rows.join(
        configs.select(F.col("digest").alias("config_digest"), F.col("json").alias("c_json"), F.lit(True).alias("has_c")), "config_digest", "left"
    ).join(layers, "config_digest", "left")
    sha = lambda c: F.concat(F.lit("sha256:"), F.sha2(F.col(c).cast("binary"), 256))
    stage = staged(
        {
            "manifest missing": F.col("has_m").isNull(),
            "manifest digest": sha("m_json") != F.col("digest"),
            "configuration missing": F.col("has_c").isNull(),
            "configuration digest": sha("c_json") != F.col("config_digest"),
            "layer missing": F.col("lost") > 0,
        }
    )
    return rows.select("name", stage.alias("stage"))


def staged(stages: dict[str, Column]) -> Column:
    """The name of the first condition that holds, so that a row counts for one stage alone; null where none does."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in stages.items()))


def stage_counts(rows: DataFrame) -> DataFrame:
    """(stage, n) of rows with a stage, sound ones under "ok"."""
    return rows.groupBy(F.coalesce("stage", F.lit("ok")).alias("stage")).agg(F.count("*").alias("n"))
