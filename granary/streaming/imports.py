"""Incremental imports: micro-batches of objects into a store that takes each object once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import store


def into_store(path: str, data: str = "data", algorithm: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. A batch that runs again, after a failure, finds its objects there and adds nothing. Objects lie in
    folders by the first byte of their id, so only those folders are compared and written."""

    def add(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = store.identified(batch, data, algorithm).selectExpr(
            "object_id", "size", f"cast(`{data}` as binary) as data", "substring(object_id, 1, 2) as fan"
        )
        try:
            held = spark.read.schema("object_id string, size long, data binary, fan string").parquet(path)
            new = store.absent(rows, held, ("fan", "object_id"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = rows.dropDuplicates(["object_id"])
        new.write.mode("append").partitionBy("fan").parquet(path)

    return add


def import_stream(stream: DataFrame, path: str, checkpoint: str, data: str = "data", algorithm: str | None = None) -> StreamingQuery:
    """Runs until all that has arrived is in the store."""
    return stream.writeStream.foreachBatch(into_store(path, data, algorithm)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_sightings(stream: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Each key once while it may still come again: state older than the watermark goes."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
