"""The content-addressed store: insert if absent, import statistics, publishing in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import content_id, verity
from ..schemas import INLINE_MAX


def storage_class(data: Column, limit: int = INLINE_MAX) -> Column:
    return F.when(F.octet_length(data) <= limit, "inline").otherwise("external")


def identified(df: DataFrame, data: str = "data", algorithm: str | None = None) -> DataFrame:
    """df with object_id and size. Without an algorithm the id is the plain SHA-256, otherwise the Merkle digest."""
    value = F.col(data).cast("binary")
    return df.withColumns({"object_id": content_id(value) if algorithm is None else verity(value, algorithm), "size": F.octet_length(value).cast("long")})


def absent(batch: DataFrame, store: DataFrame, keys: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """One row for each object of the batch that the store lacks. Ids are compared before contents move: the store's side of
    the join carries its keys alone."""
    return batch.dropDuplicates(list(keys)).join(store.select(*keys), list(keys), "left_anti")


def verified(matched: DataFrame, data: str = "data", algorithm: str | None = None) -> DataFrame:
    """Objects whose content doesn't have the digest that names them."""
    return identified(matched.withColumnRenamed("object_id", "named"), data, algorithm).filter("object_id <> named")


def import_methods(batch: DataFrame, order: str, key: str = "object_id") -> DataFrame:
    """batch with method: the first row of an object in the order given stores it, later ones find it present."""
    first = batch.groupBy(key).agg(F.min(order).alias("_first"))
    return batch.join(first, key).withColumn("method", F.when(F.col(order) == F.col("_first"), "copied").otherwise("present")).drop("_first")


def import_stats(methods: DataFrame, *by: str, size: str = "size") -> DataFrame:
    """Objects and bytes by what happened to them. Present objects count, their bytes don't."""
    new = F.col("method") != "present"
    one = methods.groupBy(*by) if by else methods.groupBy()
    return one.agg(
        F.count_if(new).alias("new_objects"),
        F.coalesce(F.sum(F.when(new, F.col(size))), F.lit(0)).cast("long").alias("new_bytes"),
        F.count_if(~new).alias("present_objects"),
        F.count("*").alias("total_objects"),
    )


def merged_stats(stats: DataFrame) -> DataFrame:
    """Component-wise sums."""
    return stats.agg(*(F.sum(x).cast("long").alias(x) for x in ("new_objects", "new_bytes", "present_objects", "total_objects")))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the table whose key the changes lack, and the changes."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def first_store_wins(wanted: DataFrame, stores: list[DataFrame], key: str, value: str) -> DataFrame:
    """wanted with the value from the first store that has its key, and that store's rank; null where none has."""
    every = None
    for rank, store in enumerate(stores):
        rows = store.select(key, F.struct(F.lit(rank).alias("rank"), F.col(value).alias("value")).alias("hit"))
        every = rows if every is None else every.unionAll(rows)
    best = every.groupBy(key).agg(F.min("hit").alias("hit"))
    return wanted.join(best, key, "left").select(*wanted.columns, F.col("hit.rank").alias("store_rank"), F.col("hit.value").alias(value))


def coalesced(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", inline: str = "inline") -> DataFrame:
    """Adjacent inline chunks of a stream become one: (stream, first_seq, last_seq, external object_id or inline bytes)."""
    order = Window.partitionBy(stream).orderBy(seq)
    external = F.col(inline).isNull()
    # Every external chunk is a run of its own; the inline ones between two are one.
    starts = external | F.coalesce(F.lag(external).over(order), F.lit(True))
    runs = chunks.withColumn("_starts", starts.cast("int")).withColumn("run", F.sum("_starts").over(order))
    joined = F.expr(f"listagg(`{inline}`) within group (order by `{seq}`)")
    return runs.groupBy(stream, "run").agg(
        F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.first("object_id").alias("object_id"), joined.alias(inline)
    )


def reassembled(chunks: DataFrame, objects: DataFrame, stream: str = "stream_id", seq: str = "seq", inline: str = "inline") -> DataFrame:
    """(stream, data): the chunks' bytes in order, external ones from the objects. Streams are rows, so they fit in one."""
    # Contents are shuffled whatever the planner guesses of their size: broadcast, they would pass through the driver.
    held = objects.select("object_id", "data").hint("merge")
    full = chunks.join(held, "object_id", "left").withColumn("_bytes", F.coalesce(F.col(inline), F.col("data")))
    return full.groupBy(stream).agg(F.expr(f"listagg(`_bytes`) within group (order by `{seq}`)").alias("data"))


def largest(rows: DataFrame, n: int, size: str = "size", *ties: str) -> DataFrame:
    """The n largest rows, ties in the order given: each task keeps n, so nothing is sorted as a whole."""
    return rows.orderBy(F.desc(size), *ties).limit(n)
