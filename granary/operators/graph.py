"""Reachability: closures over reference edges, mark and sweep, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, one_row


def closure(edges: DataFrame, roots: DataFrame, node: str = "node", depth: int | None = None) -> DataFrame:
    """(node, depth): everything reachable from the roots along (src, dst). Each round joins only the nodes found in the round
    before and drops those seen, so shared nodes and cycles end; rounds are cut from their lineage."""
    frontier = cut(roots.select(F.col(node).alias("node")).distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    step = 0
    while (depth is None or step < depth) and not frontier.isEmpty():
        step += 1
        reached = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        # What was seen grows with the table, and the planner doesn't know.
        frontier = cut(reached.join(seen.hint("merge"), "node", "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionAll(frontier)
    return seen


def sweep(objects: DataFrame, live: DataFrame, key: str = "node") -> DataFrame:
    """Objects that nothing live refers to."""
    return objects.join(live, key, "left_anti")


def gc_result(dead: DataFrame, size: str = "bytes") -> DataFrame:
    return dead.agg(F.count("*").alias("objects_removed"), F.coalesce(F.sum(size), F.lit(0)).alias("objects_bytes"))


def dangling(links: DataFrame, targets: DataFrame, link_key: str, target_key: str) -> DataFrame:
    """Links whose target is missing."""
    return links.join(targets.select(F.col(target_key).alias(link_key)).distinct(), link_key, "left_anti")


def conflicts(names: DataFrame) -> DataFrame:
    """Objects known by more than one name: (node, names)."""
    return names.groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("names")).filter(F.size("names") > 1)


def live_objects(refs: DataFrame, streams: DataFrame, images: DataFrame, image_objects: DataFrame, extra: list[str] | DataFrame | None = None) -> DataFrame:
    """object_id of everything that garbage collection keeps.

    refs: (category, name, target); streams: (name, object_id, object_refs array, named_refs map); images: (name, object_id);
    image_objects: (name, object_id) for what an image's metadata names. Roots are the refs' targets and the extra names, a list or a table (name). An image
    keeps itself and what it names; a stream keeps itself, its object refs and its named refs, and the walk goes on where a named
    ref is a stream."""
    spark = refs.sparkSession
    named = extra.select("name") if isinstance(extra, DataFrame) else spark.createDataFrame([(x,) for x in extra or []], "name string")
    roots = lambda kind: refs.filter(F.col("category") == kind).select(F.col("target").alias("name")).union(named).distinct()
    kept_images = images.join(roots("images"), "name", "left_semi")
    of_images = kept_images.select("object_id").union(image_objects.join(kept_images.select("name"), "name", "left_semi").select("object_id"))
    links = streams.select("object_id", F.explode(F.map_values("named_refs")).alias("dst"))
    start = streams.join(roots("streams"), "name", "left_semi").select(F.col("object_id").alias("node"))
    onward = links.join(streams.select(F.col("object_id").alias("dst")).distinct().hint("merge"), "dst", "left_semi")
    # Every round of the walk reads the links: they are made once, and those of the same two ends are one.
    walked = closure(cut(onward.select(F.col("object_id").alias("src"), "dst").distinct()), start).select(F.col("node").alias("object_id"))
    met = streams.join(walked.hint("merge"), "object_id", "left_semi")
    of_streams = met.select("object_id").union(met.select(F.explode("object_refs"))).union(met.select(F.explode(F.map_values("named_refs"))))
    return of_images.union(of_streams).distinct()


def gc(
    objects: DataFrame, refs: DataFrame, streams: DataFrame, images: DataFrame, image_objects: DataFrame, extra: list[str] | DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Objects, streams and images that stay, and one row of counts. Streams and images whose object goes are pruned."""
    live = cut(live_objects(refs, streams, images, image_objects, extra)).hint("merge")
    stays = lambda df: df.join(live, "object_id", "left_semi")
    gone = objects.join(live, "object_id", "left_anti")
    size = lambda df, name: df.join(live, "object_id", "left_anti").agg(F.count("*").alias(name))
    removed = gone.agg(F.count("*").alias("objects_removed"), F.coalesce(F.sum("size"), F.lit(0)).alias("objects_bytes"))
    counts = one_row([removed, size(images, "images_pruned"), size(streams, "streams_pruned")])
    return stays(objects), stays(streams), stays(images), counts


def led_on(rows: DataFrame, hops: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """rows led on from table to table: each hop is a table, the column that refers to it and the table's key. Rows whose reference leads nowhere
    leave."""
    for table, reference, key in hops:
        rows = rows.join(table, F.col(reference) == F.col(key))
    return rows
