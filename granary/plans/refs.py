"""Queries over manifests, configurations, tags, referrers, stores and whole repositories, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, text
from ..operators import catalog, check, graph, store
from ..operators.common import cut
from ..sources import storage
from .registry import query, table

_ARTIFACT = "application/x-artifact"


def sha(value: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2((F.col(value) if isinstance(value, str) else value).cast("binary"), 256))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as images: c_custkey, name, the configuration of their kind and a manifest of their own."""
    rows = table(spark, sf_dir, "customer").withColumns(
        {
            "name": F.concat("c_name", F.lit("/v%1")),
            "arch": F.when(F.col("c_custkey") % 2 == 0, "amd64").otherwise("arm64"),
            "media": F.when(F.col("c_mktsegment") == "BUILDING", _ARTIFACT).otherwise(catalog.CONFIG_MEDIA_TYPE),
            "layer": sha("c_mktsegment"),
        }
    )
    parts = ('{"architecture":"', "arch", '","os":"linux","config":{"Labels":{"segment":"', "c_mktsegment", '"}},"rootfs":{"diff_ids":["', "layer", '"]}}')
    rows = rows.withColumn("config_json", F.concat(*(F.lit(x) if k % 2 == 0 else F.col(x) for k, x in enumerate(parts))))
    rows = rows.withColumn("config_digest", sha("config_json"))
    parts = (
        '{"config":{"mediaType":"',
        "media",
        '","digest":"',
        "config_digest",
        '"},"layers":[{"digest":"',
        "layer",
        '","mediaType":"text/plain"}],"of":"',
        "c_name",
        '"}',
    )
    rows = rows.withColumn("json", F.concat(*(F.lit(x) if k % 2 == 0 else F.col(x) for k, x in enumerate(parts))))
    return rows.withColumn("digest", sha("json")).select(
        "c_custkey", "c_mktsegment", "name", "arch", "media", "layer", "config_json", "config_digest", "json", "digest"
    )


_CUSTOMERS = f"""c AS (SELECT c_custkey, c_mktsegment, c_name || '/v%1' AS name, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'amd64' ELSE 'arm64' END AS arch,
   CASE WHEN c_mktsegment = 'BUILDING' THEN '{_ARTIFACT}' ELSE '{catalog.CONFIG_MEDIA_TYPE}' END AS media, 'sha256:' || sha256(c_mktsegment) AS layer FROM customer),
cj AS (SELECT *, '{{"architecture":"' || arch || '","os":"linux","config":{{"Labels":{{"segment":"' || c_mktsegment || '"}}}},"rootfs":{{"diff_ids":["' || layer || '"]}}}}' AS config_json FROM c),
cd AS (SELECT *, 'sha256:' || sha256(config_json) AS config_digest FROM cj),
mj AS (SELECT *, '{{"config":{{"mediaType":"' || media || '","digest":"' || config_digest || '"}},"layers":[{{"digest":"' || layer || '","mediaType":"text/plain"}}],"of":"' || c_name || '"}}' AS json FROM cd),
m AS (SELECT *, 'sha256:' || sha256(json) AS digest FROM mj)"""


def manifests_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        "digest",
        F.sha2(F.col("json").cast("binary"), 256).alias("object_id"),
        "json",
        "config_digest",
        F.array("layer").alias("layer_digests"),
        F.col("media").alias("config_media_type"),
    )


def configs_of(rows: DataFrame) -> DataFrame:
    """Configurations of one architecture name an image, those of one segment an image for booting too."""
    each = rows.select("config_digest", "config_json", "layer", "arch", "c_mktsegment").distinct()
    refs = F.create_map("layer", F.concat(F.lit("object of "), "c_mktsegment"))
    refs = F.when(
        F.col("arch") == "amd64", F.map_concat(refs, F.create_map(F.lit(catalog.IMAGE_REF), F.concat(F.lit("image of "), "c_mktsegment")))
    ).otherwise(refs)
    return each.select(
        F.col("config_digest").alias("digest"),
        F.sha2(F.col("config_json").cast("binary"), 256).alias("object_id"),
        F.col("config_json").alias("json"),
        refs.alias("named_refs"),
    )


def tags_of(rows: DataFrame) -> DataFrame:
    """A tag for two of three customers, and refs that are no tags."""
    tagged = rows.filter("c_custkey % 3 <> 0").select(
        F.lit("streams").alias("category"),
        F.concat(F.lit(catalog.TAG_PREFIX), text.encode_tag(F.col("name"))).alias("name"),
        F.concat(text.identifier("manifest", F.col("digest"))).alias("target"),
    )
    return tagged.unionAll(rows.filter("c_custkey % 3 = 0").select(F.lit("images"), F.col("name"), F.col("digest")))


def referrers_of(rows: DataFrame) -> DataFrame:
    """Each customer refers to the tenth before, and every fifth to a subject that is gone."""
    ten = rows.select(
        (F.col("c_custkey") - 10).alias("c_custkey"), F.col("digest").alias("artifact")
    ).join(rows.select("c_custkey", F.col("digest").alias("subject")).hint("merge"), "c_custkey").select("subject", "artifact")
    return ten.unionAll(rows.filter("c_custkey % 5 = 0").select(sha(F.concat(F.lit("gone "), "name")).alias("subject"), F.col("digest").alias("artifact")))


_REFERRERS = """r AS (SELECT s.digest AS subject, a.digest AS artifact FROM m a JOIN m s ON s.c_custkey = a.c_custkey - 10
  UNION ALL SELECT 'sha256:' || sha256('gone ' || name), digest FROM m WHERE c_custkey % 5 = 0)"""


@query(f"""
WITH {_CUSTOMERS}, {_REFERRERS}, n AS (SELECT subject AS digest, count(*) AS referrer_count FROM r GROUP BY 1)
SELECT name, digest AS manifest_digest, media <> '{_ARTIFACT}' AS is_container, CASE WHEN media <> '{_ARTIFACT}' THEN arch ELSE '' END AS architecture,
       CASE WHEN media <> '{_ARTIFACT}' THEN 'linux' ELSE '' END AS os, CAST(1 AS BIGINT) AS layer_count, coalesce(referrer_count, 0) AS referrer_count
FROM m LEFT JOIN n USING (digest) WHERE c_custkey % 3 <> 0""")
def referrer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tagged images with what their manifests, configurations and referrers say."""
    rows = customers(spark, sf_dir)
    found = catalog.images(tags_of(rows), manifests_of(rows), configs_of(rows), referrers_of(rows))
    return found.select(
        "name", "manifest_digest", "is_container", "architecture", "os", F.col("layer_count").cast("long").alias("layer_count"), "referrer_count"
    )


@query(f"""
WITH {_CUSTOMERS}, k AS (SELECT DISTINCT config_digest, c_mktsegment, layer, arch FROM m)
SELECT 'label segment' AS kind, config_digest AS digest, c_mktsegment AS value FROM k
UNION ALL SELECT 'layer 0', config_digest, layer FROM k
UNION ALL SELECT 'object of ' || layer, config_digest, 'object of ' || c_mktsegment FROM k""")
def config_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, layers and layers' objects of configurations."""
    configs = configs_of(customers(spark, sf_dir))
    labels = catalog.labels(configs).select(F.concat(F.lit("label "), "key").alias("kind"), "digest", "value")
    layers = catalog.layer_diff_ids(configs).select(F.concat(F.lit("layer "), F.col("position").cast("string")), "digest", "diff_id")
    return labels.unionAll(layers).unionAll(catalog.layer_objects(configs).select(F.concat(F.lit("object of "), "diff_id"), "digest", "object_id"))


@query(f"""
WITH {_CUSTOMERS}, {_REFERRERS}
SELECT 'there' AS state, subject, artifact FROM r UNION ALL SELECT 'dangling', subject, artifact FROM r WHERE subject NOT IN (SELECT digest FROM m)
UNION ALL SELECT 'kept', subject, artifact FROM r WHERE subject IN (SELECT digest FROM m)
UNION ALL SELECT 'changed', subject, artifact FROM r WHERE subject <> (SELECT digest FROM m WHERE c_custkey = 3)
UNION ALL SELECT 'changed', 'sha256:new', 'sha256:artifact'""")
def referrer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referrers that are there, that dangle, and after edges have been added and removed."""
    rows = customers(spark, sf_dir)
    manifests, edges = manifests_of(rows), referrers_of(rows)
    of = lambda state, found: found.select(F.lit(state).alias("state"), "subject", "artifact")
    kept, gone = catalog.dangling_referrers(edges, manifests)
    third = rows.filter("c_custkey = 3").first()
    changed = catalog.add_referrer(catalog.remove_referrer(edges, third.digest), "sha256:new", "sha256:lost")
    changed = catalog.remove_referrer(catalog.add_referrer(changed, "sha256:new", "sha256:artifact"), "sha256:new", "sha256:lost")
    return of("there", catalog.referrers_of(edges, manifests)).unionAll(of("dangling", gone)).unionAll(of("kept", kept)).unionAll(of("changed", changed))


@query(f"""
WITH {_CUSTOMERS}, t AS (SELECT name, digest FROM m WHERE c_custkey % 3 <> 0 AND c_custkey <> 4 UNION ALL SELECT 'new/tag', digest FROM m WHERE c_custkey = 3)
SELECT 'tag' AS kind, name, digest FROM t UNION ALL SELECT 'resolved', name, digest FROM t WHERE name = 'new/tag'
UNION ALL SELECT 'by digest', name, digest FROM m WHERE c_custkey = 6""")
def tag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags after one was set and one taken away, and references led to their manifests."""
    rows = customers(spark, sf_dir)
    one = {r.c_custkey: r for r in rows.filter("c_custkey in (3, 4, 6)").select("c_custkey", "name", "digest").collect()}
    refs = catalog.untag(catalog.tag(tags_of(rows), "new/tag", one[3].digest), one[4].name)
    manifests = manifests_of(rows)
    resolved = catalog.resolve(refs, manifests, "new/tag").select(F.lit("resolved").alias("kind"), F.lit("new/tag").alias("name"), "digest")
    by_digest = catalog.resolve(refs, manifests, "@" + one[6].digest).select(F.lit("by digest"), F.lit(one[6].name), "digest")
    return catalog.tags(refs).select(F.lit("tag").alias("kind"), "name", "digest").unionAll(resolved).unionAll(by_digest)


@query(f"""
WITH {_CUSTOMERS} SELECT CASE WHEN media = '{_ARTIFACT}' THEN 'skipped' WHEN arch = 'amd64' THEN 'current' ELSE 'upgraded' END AS outcome, count(*) AS n
FROM m WHERE c_custkey % 3 <> 0 GROUP BY 1""")
def upgrade_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    return catalog.upgrade_outcomes(tags_of(rows), manifests_of(rows), configs_of(rows)).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""
WITH {_CUSTOMERS}
SELECT 'image' AS kind, digest, 'image of ' || c_mktsegment AS image_id FROM m WHERE arch = 'amd64' UNION ALL SELECT 'boot', digest, 'booted' FROM m WHERE arch = 'arm64'
UNION ALL SELECT 'left', digest, 'image of ' || c_mktsegment FROM m WHERE arch = 'amd64' AND c_mktsegment <> 'MACHINERY'""")
def images_of_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images that manifests' configurations name: as they are, after images for booting were made, and after some were taken away."""
    rows = customers(spark, sf_dir)
    manifests, configs = manifests_of(rows), configs_of(rows)
    of = lambda kind, found: found.select(F.lit(kind).alias("kind"), F.col("manifest_digest").alias("digest"), "image_id")
    arm = rows.filter("arch = 'arm64'").select(F.col("config_digest").alias("digest"), F.lit("booted").alias("image_id")).distinct()
    gone = rows.filter("c_mktsegment = 'MACHINERY'").select(F.col("config_digest").alias("digest"), F.lit(None).cast("string").alias("image_id")).distinct()
    booted = catalog.with_image(configs, arm, boot=True)
    return of("image", catalog.image_of(manifests, booted)).unionAll(of("boot", catalog.image_of(manifests, booted, True))).unionAll(
        of("left", catalog.image_of(manifests, catalog.with_image(booted, gone)))
    )


@query(f"""
WITH {_CUSTOMERS}, s AS (SELECT name, CASE WHEN c_custkey % 7 = 1 THEN 'manifest missing' WHEN c_custkey % 11 = 1 THEN 'manifest digest' WHEN c_mktsegment = 'FURNITURE' THEN 'configuration missing'
  WHEN c_mktsegment = 'AUTOMOBILE' THEN 'configuration digest' WHEN c_mktsegment = 'MACHINERY' THEN 'layer missing' END AS stage FROM m WHERE c_custkey % 3 <> 0)
SELECT coalesce(stage, 'ok') AS stage, name FROM s UNION ALL SELECT 'count ' || coalesce(stage, 'ok'), CAST(count(*) AS VARCHAR) FROM s GROUP BY 1
UNION ALL SELECT 'one', name FROM s WHERE stage = 'layer missing' AND name = (SELECT min(name) FROM s WHERE stage = 'layer missing')""")
def staged_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that each tagged image fails, each image in one stage alone; and the check of one tag."""
    rows = customers(spark, sf_dir)
    manifests = manifests_of(
        rows.filter("c_custkey % 7 <> 1").withColumn("json", F.when(F.col("c_custkey") % 11 == 1, F.concat("json", F.lit(" "))).otherwise(F.col("json")))
    )
    configs = configs_of(rows.filter("c_mktsegment <> 'FURNITURE'"))
    configs = configs.withColumn("json", F.when(F.col("json").contains("AUTOMOBILE"), F.concat("json", F.lit(" "))).otherwise(F.col("json")))
    held = rows.filter("c_mktsegment <> 'MACHINERY'").select(F.concat(F.lit("object of "), "c_mktsegment").alias("object_id")).distinct()
    held = held.unionAll(rows.select(F.concat(F.lit("image of "), "c_mktsegment")).distinct())
    tags = catalog.tags(tags_of(rows))
    found = check.tagged_images(tags, manifests, configs, held)
    counts = check.stage_counts(found).select(F.concat(F.lit("count "), "stage").alias("stage"), F.col("n").cast("string").alias("name"))
    lost = found.filter("stage = 'layer missing'").agg(F.min("name").alias("name")).first().name
    one = check.tagged_images(tags, manifests, configs, held, lost).select(F.lit("one").alias("stage"), "name")
    return found.select(F.coalesce("stage", F.lit("ok")).alias("stage"), "name").unionAll(counts).unionAll(one)


@query(f"""
WITH {_CUSTOMERS}, {_REFERRERS}, n AS (SELECT subject AS digest, count(*) AS n, min(artifact) AS least FROM r GROUP BY 1)
SELECT digest, media AS media_type, arch AS architecture, CAST(coalesce(n, 0) AS BIGINT) AS referrers, least AS first_referrer FROM m LEFT JOIN n USING (digest)""")
def inspect_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest, configuration and referrers of each image in one document; what is read back from it is compared."""
    rows = customers(spark, sf_dir)
    made = catalog.inspected(manifests_of(rows), configs_of(rows), referrers_of(rows))
    back = F.from_json(
        "json", "manifest struct<config: struct<mediaType: string>>, config struct<architecture: string>, referrers array<struct<digest: string>>"
    )
    read = made.select("digest", back.alias("x"))
    least = F.array_min(F.transform("x.referrers", lambda r: r["digest"]))
    return read.select(
        "digest",
        F.col("x.manifest.config.mediaType").alias("media_type"),
        F.col("x.config.architecture").alias("architecture"),
        F.size("x.referrers").cast("long").alias("referrers"),
        least.alias("first_referrer"),
    )


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS stream_id, CAST(sum(l_quantity) AS BIGINT) AS size, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_quantity > 10), 0) AS BIGINT) AS external_size,
       count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 10) AS external_objects, count(*) AS entry_count, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_quantity <= 10), 0) AS BIGINT) AS inline_size
FROM lineitem GROUP BY 1""")
def layer_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as layers: lines of a larger quantity are objects, others bytes within the stream."""
    items = table(spark, sf_dir, "lineitem").withColumn("stream_id", F.col("l_orderkey").cast("string"))
    chunks = items.select(
        "stream_id", F.when(F.col("l_quantity") > 10, F.col("l_partkey").cast("string")).alias("object_id"), F.col("l_quantity").cast("long").alias("size")
    )
    return catalog.layer_info(chunks, items.select(F.col("stream_id").alias("archive")))


@query(
    "SELECT l_partkey % 97 AS subject_of, count(*) AS removed FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) GROUP BY 1"
)
def cleanup_orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers refer to parts; edges to parts that are gone are cleaned up."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("artifact")).distinct()
    kept = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("digest"))
    _, gone = catalog.dangling_referrers(edges, kept)
    return gone.groupBy((F.col("subject") % 97).alias("subject_of")).agg(F.count("*").alias("removed"))


@query(f"""
WITH {_CUSTOMERS}
SELECT 'below' AS kind, 'v%251' AS name, c_name AS value FROM m WHERE c_custkey = 7 UNION ALL SELECT 'known', name, CAST(c_custkey % 2 = 0 AS VARCHAR) FROM m
UNION ALL SELECT 'layer', digest, layer FROM m""")
def names_and_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs one level below a prefix, names with and without a stream, and the layer at a position."""
    rows = customers(spark, sf_dir)
    refs = rows.select(
        F.lit("streams").alias("category"),
        F.concat_ws("/", F.substring_index("name", "/", 1), F.lit("v%251")).alias("name"),
        F.substring_index("name", "/", 1).alias("target"),
    )
    below = catalog.names_under(refs, "streams", "Customer#000000007").select(F.lit("below").alias("kind"), "name", F.col("target").alias("value"))
    streams = rows.filter("c_custkey % 2 = 0").select(F.col("digest").alias("name"))
    named = rows.select(F.lit("streams").alias("category"), "name", F.col("digest").alias("target"))
    known = catalog.known_names(rows.select("name"), named, streams).select(F.lit("known"), "name", F.col("known").cast("string"))
    layers = catalog.layer_at(manifests_of(rows), 0).filter("is_blob").select(F.lit("layer"), "digest", "layer_digest")
    return below.unionAll(known).unionAll(layers)


# Repositories: documents are the objects; customers, suppliers and orders name them.


def store_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Objects, refs, streams, images and what images name. Objects' ids are plain digests. Texts are hashed once and streams put together once,
    as every round of a walk reads them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = cut(docs.select("doc_id", digest.content_id(F.col("text")).alias("object_id"), F.octet_length("text").cast("long").alias("size")))
    objects = ids.select("object_id", "size").distinct()
    key = lambda rows, by, name: rows.join(
        ids.select(F.col("doc_id").alias("_k"), F.col("object_id").alias(name)).hint("merge"), F.expr(by) == F.col("_k"), "left"
    ).drop("_k").withColumn(name, F.coalesce(name, F.concat(F.lit("gone "), F.expr(by).cast("string"))))
    streams = table(spark, sf_dir, "customer").select("c_custkey")
    streams = key(key(key(streams, "c_custkey", "object_id"), "c_custkey + 1", "one"), "c_custkey * 2 + 3", "next")
    streams = cut(
        streams.select(
            F.concat(F.lit("s"), "c_custkey").alias("name"),
            "object_id",
            F.array("one").alias("object_refs"),
            F.create_map(F.lit("next"), "next").alias("named_refs"),
        )
    )
    images = key(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey * 5", "object_id").select(
        F.concat(F.lit("i"), "s_suppkey").alias("name"), "object_id"
    )
    named = key(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey * 7 + 1", "object_id").select(
        F.concat(F.lit("i"), "s_suppkey").alias("name"), "object_id"
    )
    refs = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 0").select(
        F.lit("streams").alias("category"), F.concat(F.lit("n"), "c_custkey").alias("name"), F.concat(F.lit("s"), F.col("c_custkey") + 1).alias("target")
    )
    refs = refs.unionAll(
        table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select(
            F.lit("images"), F.concat(F.lit("m"), "s_suppkey"), F.concat(F.lit("i"), F.col("s_suppkey") * 2)
        )
    )
    return objects, refs, streams, images, named


_STORE = """d AS (SELECT doc_id, sha256(text) AS object_id FROM documents), o AS (SELECT DISTINCT sha256(text) AS object_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents),
s AS (SELECT 's' || c_custkey AS name, coalesce(a.object_id, 'gone ' || c_custkey) AS object_id, coalesce(b.object_id, 'gone ' || (c_custkey + 1)) AS one, coalesce(n.object_id, 'gone ' || (c_custkey * 2 + 3)) AS next
      FROM customer LEFT JOIN d a ON a.doc_id = c_custkey LEFT JOIN d b ON b.doc_id = c_custkey + 1 LEFT JOIN d n ON n.doc_id = c_custkey * 2 + 3),
i AS (SELECT 'i' || s_suppkey AS name, coalesce(a.object_id, 'gone ' || (s_suppkey * 5)) AS object_id, coalesce(b.object_id, 'gone ' || (s_suppkey * 7 + 1)) AS named
      FROM supplier LEFT JOIN d a ON a.doc_id = s_suppkey * 5 LEFT JOIN d b ON b.doc_id = s_suppkey * 7 + 1),
f AS (SELECT 'streams' AS category, 'n' || c_custkey AS name, 's' || (c_custkey + 1) AS target FROM customer WHERE c_custkey % 50 = 0
      UNION ALL SELECT 'images', 'm' || s_suppkey, 'i' || (s_suppkey * 2) FROM supplier WHERE s_suppkey % 4 = 0)"""


@query(f"""
WITH RECURSIVE {_STORE}, w(object_id) AS (SELECT object_id FROM s WHERE name IN (SELECT target FROM f WHERE category = 'streams') OR name = 's5'
  UNION SELECT t.object_id FROM w JOIN s ON s.object_id = w.object_id JOIN s t ON t.object_id = s.next),
live AS (SELECT object_id FROM i WHERE name IN (SELECT target FROM f WHERE category = 'images') UNION SELECT named FROM i WHERE name IN (SELECT target FROM f WHERE category = 'images')
  UNION SELECT object_id FROM w UNION SELECT one FROM s JOIN w USING (object_id) UNION SELECT next FROM s JOIN w USING (object_id)),
x AS (SELECT (SELECT count(*) FROM o WHERE object_id NOT IN (SELECT object_id FROM live)) AS objects_removed,
  (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM o WHERE object_id NOT IN (SELECT object_id FROM live)) AS objects_bytes,
  (SELECT count(*) FROM i WHERE object_id NOT IN (SELECT object_id FROM live)) AS images_pruned, (SELECT count(*) FROM s WHERE object_id NOT IN (SELECT object_id FROM live)) AS streams_pruned)
SELECT 'objects removed' AS what, CAST(objects_removed AS VARCHAR) AS value FROM x UNION ALL SELECT 'bytes', CAST(objects_bytes AS VARCHAR) FROM x
UNION ALL SELECT 'images pruned', CAST(images_pruned AS VARCHAR) FROM x UNION ALL SELECT 'streams pruned', CAST(streams_pruned AS VARCHAR) FROM x
UNION ALL SELECT 'object', object_id FROM o WHERE object_id IN (SELECT object_id FROM live) UNION ALL SELECT 'stream', name FROM s WHERE object_id IN (SELECT object_id FROM live)
UNION ALL SELECT 'image', name FROM i WHERE object_id IN (SELECT object_id FROM live)""")
def gc_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collection of the whole store counts and leaves, with one extra name to keep."""
    kept, streams, images, counts = graph.gc(*store_tables(spark, sf_dir), ["s5"])
    told = {"objects removed": "objects_removed", "bytes": "objects_bytes", "images pruned": "images_pruned", "streams pruned": "streams_pruned"}
    wide = counts.select(F.explode(F.create_map(*(y for k, v in told.items() for y in (F.lit(k), F.col(v).cast("string"))))).alias("what", "value"))
    of = lambda kind, rows, name: rows.select(F.lit(kind), name)
    return wide.unionAll(of("object", kept, "object_id")).unionAll(of("stream", streams, "name")).unionAll(of("image", images, "name"))


_ERRORS = f"""{_STORE}, e AS (
  SELECT 'object name' AS type, 'objects/' || substr(object_id, 1, 2) || '/' || substr(object_id, 3) AS path, object_id, NULL AS ref_name, NULL AS detail FROM (SELECT 'zz' || doc_id AS object_id FROM documents WHERE doc_id % 50 = 9)
  UNION ALL SELECT 'object unreadable', 'objects/' || substr(x, 1, 2) || '/' || substr(x, 3), x, NULL, NULL FROM (SELECT sha256('lost ' || doc_id) AS x FROM documents WHERE doc_id % 50 = 11)
  UNION ALL SELECT 'broken link', 'streams/' || name, object_id, NULL, NULL FROM s WHERE object_id LIKE 'gone %'
  UNION ALL SELECT 'broken link', 'images/' || name, object_id, NULL, NULL FROM i WHERE object_id LIKE 'gone %'
  UNION ALL SELECT 'broken ref', category || '/refs/' || name, NULL, name, target FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE f.category = 'streams' AND s.name = target UNION ALL SELECT 1 FROM i WHERE f.category = 'images' AND i.name = target)
  UNION ALL SELECT 'missing object', 'streams/' || name, one, NULL, NULL FROM s WHERE one LIKE 'gone %'
  UNION ALL SELECT 'missing named ref', 'streams/' || name, next, 'next', NULL FROM s WHERE next LIKE 'gone %'
  UNION ALL SELECT 'missing object', 'images/' || name, named, NULL, NULL FROM i WHERE named LIKE 'gone %')"""


def damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The errors of the store with objects of odd names and without content, and the objects that were checked. Digests of contents are the
    business of ``object_digests``."""
    objects, refs, streams, images, named = store_tables(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id")
    nothing = F.lit(None).cast("binary").alias("data")
    odd = docs.filter("doc_id % 50 = 9").select(F.concat(F.lit("zz"), "doc_id").alias("object_id"), nothing)
    odd = odd.unionAll(docs.filter("doc_id % 50 = 11").select(F.sha2(F.concat(F.lit("lost "), "doc_id").cast("binary"), 256), nothing))
    known = objects.select("object_id")
    found = [
        check.objects(odd),
        check.links("streams", streams, known),
        check.links("images", images, known),
        check.refs(refs, streams, images),
        check.stream_refs(streams, known),
        check.image_objects(named, known),
    ]
    return check.union(*found), odd


@query(f"WITH {_ERRORS} SELECT type, path, object_id, ref_name, detail FROM e")
def fsck_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged(spark, sf_dir)[0]


@query(f"""
WITH {_ERRORS} SELECT (SELECT count(*) FROM documents WHERE doc_id % 50 IN (9, 11)) AS objects_checked, (SELECT count(*) FROM s) AS streams_checked, (SELECT count(*) FROM i) AS images_checked,
 count(*) AS errors, count(*) FILTER (WHERE starts_with(type, 'object ')) AS objects_corrupted, count(*) FILTER (WHERE starts_with(type, 'broken')) AS broken_links,
 count(*) FILTER (WHERE starts_with(type, 'missing')) AS missing_objects, count(*) = 0 AS is_ok FROM e""")
def fsck_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, streams, images, _ = store_tables(spark, sf_dir)
    found, odd = damaged(spark, sf_dir)
    return check.counts(odd, streams, images, found)


@query("SELECT 'object digest' AS type, c_custkey FROM customer WHERE c_custkey % 9 = 4")
def object_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short contents under their Merkle digest, every ninth with a byte more than it had when it was named."""
    body = F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), "c_name")
    rows = table(spark, sf_dir, "customer").select("c_custkey", body.cast("binary").alias("body"))
    more = F.when(F.col("c_custkey") % 9 == 4, F.concat(F.col("body"), F.lit("x").cast("binary"))).otherwise(F.col("body"))
    held = store.identified(rows, "body", "sha256").select("object_id", more.alias("data"), "c_custkey")
    wrong = check.objects(held.select("object_id", "data")).select("object_id", "type").distinct()
    return held.join(wrong, "object_id").select("type", "c_custkey")


@query("""
WITH j AS (SELECT user_id, list_distinct(list(event_type)) AS f FROM events WHERE value >= 200 GROUP BY 1)
SELECT user_id, CASE WHEN list_contains(f, 'error') THEN 'rejected' WHEN list_contains(f, 'signup') THEN 'read-only' ELSE 'read-write' END AS access,
       CASE WHEN user_id % 10 = 1 THEN 'unreadable' WHEN user_id % 10 = 2 THEN 'version' WHEN user_id % 10 = 3 THEN 'algorithm' WHEN list_contains(f, 'error') THEN 'features' END AS problem FROM j""")
def feature_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of a user's events of a high value as feature flags of metadata: what access they leave, and what is wrong with the metadata."""
    kinds = table(spark, sf_dir, "events").filter("value >= 200").groupBy("user_id").agg(F.collect_set("event_type").alias("f"))
    only = lambda *names: F.array_intersect("f", F.array(*map(F.lit, names)))
    rows = kinds.withColumn(
        "features", F.struct(only("view", "click").alias("compatible"), only("signup").alias("read-only-compatible"), only("error").alias("incompatible"))
    )
    algorithm = F.when(F.col("user_id") % 10 == 3, "md5").otherwise("fsverity-sha512-12")
    made = F.to_json(F.struct(F.when(F.col("user_id") % 10 == 2, 2).otherwise(1).alias("version"), algorithm.alias("algorithm"), "features"))
    rows = rows.withColumn("json", F.when(F.col("user_id") % 10 == 1, "{").otherwise(made))
    return rows.select("user_id", check.write_access(F.col("features"), ["view"]).alias("access"), check.metadata_problem(F.col("json")).alias("problem"))


# Container storage.


@query("""
SELECT 'chain' AS kind, CAST(n AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM (WITH RECURSIVE w(n, b) AS (SELECT 97, 0 UNION ALL SELECT n // 2, b + 1 FROM w WHERE n > 0) SELECT * FROM w)
UNION ALL SELECT 'size', CAST(o_custkey AS VARCHAR), CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 0 END) AS VARCHAR) FROM orders GROUP BY o_custkey
UNION ALL SELECT 'resolved', 'd' || c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '0 a' || c_custkey WHEN c_custkey % 3 = 0 THEN '1 b' || c_custkey END FROM customer
UNION ALL SELECT 'nearest', 'p' || (n % 5), CAST(min_by(n, d) AS VARCHAR) FROM (WITH RECURSIVE w(n, d) AS (SELECT 97, 0 UNION ALL SELECT n // 2, d + 1 FROM w WHERE n > 0) SELECT * FROM w) GROUP BY n % 5""")
def storage_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of layers, sizes of images, layers in the first store that has them, and files in the nearest layer of a chain."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    ids = customer.filter("c_custkey < 100").select("c_custkey")
    layers = ids.select(
        F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 2).cast("string")).alias("parent")
    )
    chained = storage.chain(layers, "97")
    wanted = orders.select(F.col("o_custkey").cast("string").alias("image_id"), F.col("o_orderkey").cast("string").alias("layer_id"))
    known = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("diff_size"))
    sizes = storage.image_size(wanted, known)
    of = lambda rank, name, every: customer.filter(f"c_custkey % {every} = 0").select(
        F.concat(F.lit(name), "c_custkey").alias("id"), F.concat(F.lit("d"), "c_custkey").alias("diff_digest"), F.lit(rank).alias("store_rank")
    )
    asked = customer.select(F.col("c_custkey").alias("position"), F.concat(F.lit("d"), "c_custkey").alias("diff_digest"))
    found = storage.resolved(asked, of(0, "a", 4).unionAll(of(1, "b", 3)))
    files = ids.select(F.col("c_custkey").cast("string").alias("layer_id"), F.concat(F.lit("p"), F.col("c_custkey") % 5).alias("path"))
    nearest = storage.first_in_chain(files, chained)
    row = lambda kind, rows, a, b: rows.select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"), b.cast("string").alias("b"))
    return (
        row("chain", chained, "id", F.col("depth"))
        .unionAll(row("size", sizes, "image_id", F.col("size")))
        .unionAll(row("resolved", found, "diff_digest", F.concat(F.col("store_rank").cast("string"), F.lit(" "), F.col("id"))))
        .unionAll(row("nearest", nearest, "path", F.col("layer_id")))
    )


_ASKED = ("small ring", "bolt", "red", "gear", "nothing")


@query(f"""
WITH q(asked) AS (VALUES {", ".join(f"('{x}')" for x in _ASKED)}), n AS (SELECT p_partkey, p_type || '/' || replace(p_name, ' widget', ':latest') AS name FROM part UNION ALL SELECT p_partkey, p_name FROM part),
m AS (SELECT asked, name, p_partkey, CASE WHEN name = asked THEN 1 WHEN ends_with(name, '/' || asked) THEN 2 WHEN name = asked || ':latest' OR ends_with(name, '/' || asked || ':latest') THEN 3 END AS tier FROM q, n)
SELECT asked, CAST(arg_min(tier, (tier, name, CAST(p_partkey AS VARCHAR))) AS INTEGER) AS tier, arg_min(name, (tier, name, CAST(p_partkey AS VARCHAR))) AS name,
  arg_min(CAST(p_partkey AS VARCHAR), (tier, name, CAST(p_partkey AS VARCHAR))) AS id FROM m WHERE tier IS NOT NULL GROUP BY 1
UNION ALL SELECT '7', 0, '7', '7'""")
def name_match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by the whole name, then by its last part, then with the default tag; and by id."""
    part = table(spark, sf_dir, "part")
    full = F.concat("p_type", F.lit("/"), F.replace(F.col("p_name"), F.lit(" widget"), F.lit(":latest")))
    images = part.select(F.col("p_partkey").cast("string").alias("id"), F.array(full, "p_name").alias("names"))
    out = storage.image_by_key(images, "7").select(F.lit("7").alias("asked"), "tier", "name", "id")
    for asked in _ASKED:
        out = out.unionAll(storage.named(images, asked).select(F.lit(asked).alias("asked"), "tier", "name", "id"))
    return out


@query("""
WITH a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
b AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS pos FROM lineitem)
SELECT CAST(a.l_orderkey AS VARCHAR) AS image_id, a.pos AS position, CAST(a.l_partkey AS VARCHAR) AS layer_id, CAST(b.l_suppkey AS VARCHAR) AS diff_id, NULL AS error FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.pos = b.pos WHERE n <> 3
UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), NULL, NULL, NULL, '3 layers and 2 digests' FROM a WHERE n = 3""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of each order paired by position; lists of different lengths are an error. Orders of three lines lose one on one side."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("a"), F.sort_array(F.collect_list("l_suppkey")).alias("b")
    )
    short = F.when(F.size("b") == 3, F.slice("b", 1, 2)).otherwise(F.col("b"))
    lists = rows.select(
        F.col("l_orderkey").cast("string").alias("image_id"),
        F.col("a.l_partkey").cast("array<string>").alias("layer_ids"),
        short.cast("array<string>").alias("diff_ids"),
    )
    return storage.zipped(lists).withColumn("position", F.col("position").cast("long"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(array_to_string(list_transform(range(0, c_custkey % 4), lambda k: 'L' || k), ' '), '') AS links, 'up' || c_custkey AS target,
       'aa' || c_custkey || ' bb' AS diff_ids FROM customer""")
def storage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of lower layers, short links and configurations' digests, taken apart."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    lower = F.array_join(
        F.concat(
            F.array(F.lit("x/none")),
            F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 4 - 1).cast("int")), lambda k: F.concat(F.lit("l/L"), k.cast("string"))),
        ),
        ":",
    )
    lower = F.when(F.col("c_custkey") % 4 == 0, "x/none").otherwise(lower)
    config = F.concat(F.lit('{"rootfs":{"diff_ids":["sha256:aa'), "c_custkey", F.lit('","bb"]}}'))
    return rows.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.array_join(storage.lower_links(lower), " ").alias("links"),
        storage.link_target(F.concat(F.lit("../up"), "c_custkey", F.lit("/diff"))).alias("target"),
        F.array_join(storage.diff_ids(config), " ").alias("diff_ids"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def resolve_ref_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines led on from reference to reference to their region."""
    items, orders, customer, nation, region = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    hops = [
        (orders.select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey"),
        (customer.select("c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey"),
        (nation.select("n_nationkey", "n_name", "n_regionkey"), "c_nationkey", "n_nationkey"),
        (region, "n_regionkey", "r_regionkey"),
    ]
    return graph.led_on(items.select("l_orderkey", "l_linenumber", "l_partkey"), hops).select(
        "l_orderkey", "l_linenumber", "l_partkey", "c_name", "n_name", "r_name"
    )


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents ORDER BY size DESC, doc_id LIMIT 25")
def size_desc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return store.largest(sized, 25, "size", "doc_id")


@query("SELECT c_name AS name, c_custkey FROM customer ORDER BY c_name LIMIT 50 OFFSET 100")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_custkey"), ["name"], 100, 50)
