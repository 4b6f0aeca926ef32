"""Helpers of the operators: lineage cuts and numbering without a single-task window."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the cluster's checkpoint folder; sets one only where there is none, as in local tests."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the checkpoint folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str | Column], name: str = "idx", start: int = 0) -> DataFrame:
    """Rows numbered from ``start`` in the order given. Rows are range-partitioned and each partition counts its own; the driver
    only learns how many rows each partition has."""
    keys = [F.col(x) if isinstance(x, str) else x for x in order]
    held = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, start
    for k in sorted(sizes):
        before[k] = total
        total += sizes[k]
    if not before:
        return held.withColumn(name, F.lit(None).cast("long")).drop("_at")
    base = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), part)
    return held.withColumn(name, place + base).drop("_at")


def one_row(frames: list[DataFrame]) -> DataFrame:
    """Frames of one row and different columns as one row."""
    names = [x for f in frames for x in f.columns]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    return every.agg(*(F.max(x).alias(x) for x in names))
