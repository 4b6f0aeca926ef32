"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written_at


def connected(edges: DataFrame) -> DataFrame:
    """(node, least): for every node of the edges (a, b), the least node that it is connected with, nodes ordered as integers. Each
    round hooks every node to the least root in its neighbourhood and then shortens all paths; rounds are written to the shared folder. Edges
    inside a component found so far leave, so the rounds get smaller."""
    spark = edges.sparkSession
    live, live_at = written_at(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    done: list[DataFrame] = []  # (node, least) of each round; node is no root any more
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        # The least neighbour, where it is less than the node itself: trees without cycles, as every step goes down.
        hooks, at = written_at(both.filter("b < a").groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "node"), "hooks")
        while True:
            # Paths shorten by half.
            nxt = hooks.alias("h").join(hooks.alias("g"), F.col("h.up") == F.col("g.node"), "left").select(
                F.col("h.node").alias("node"), F.coalesce("g.up", "h.up").alias("up"), F.col("g.up").isNotNull().alias("moved")
            )
            shorter, new_at = written_at(nxt, "hooks")
            moved = not shorter.filter("moved").isEmpty()
            remove(spark, at)
            hooks, at = shorter.select("node", "up"), new_at
            if not moved:
                break
        done.append(hooks.withColumnRenamed("up", "least"))
        root = lambda name: F.coalesce(F.col(f"{name}.up"), F.col(f"e.{name}"))
        moved_edges = (
            live.alias("e").join(hooks.withColumnRenamed("node", "node_a").alias("a"), F.col("e.a") == F.col("node_a"), "left").join(
                hooks.withColumnRenamed("node", "node_b").alias("b"), F.col("e.b") == F.col("node_b"), "left"
            )
        ).select(F.least(root("a"), root("b")).alias("a"), F.greatest(root("a"), root("b")).alias("b"))
        nxt_live, nxt_at = written_at(moved_edges.filter("a <> b").distinct(), "edges")
        remove(spark, live_at)
        live, live_at = nxt_live, nxt_at
    if not done:
        return spark.createDataFrame([], "node long, least long")
    out = done[0]
    for later in done[1:]:
        # A root of an earlier round may have got a root since.
        out = out.alias("x").join(later.alias("y"), F.col("x.least") == F.col("y.node"), "left").select(
            "x.node", F.coalesce("y.least", "x.least").alias("least")
        ).union(later)
    return out
