"""What the operators share: the shared folder, written intermediate tables and text conventions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: As a regular expression for Java, Python and DuckDB's RE2.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, as in local tests, a temporary
    folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What this process has written to the shared folder, in order.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end what was written to the shared folder within it, but for the paths in the list that it gives. What was planned on those
    tables must have been written or collected by then."""
    start, keep = len(_made), []
    try:
        yield keep
    finally:
        inside = _made[start:]
        del _made[start:]
        _made.extend(x for x in inside if x in keep)
        for path in inside:
            if path not in keep:
                remove(spark, path)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The same rows, written to a table in the shared folder and read back: this cuts the lineage, and a lost executor costs no
    more than the tasks it ran."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for inner columns that none of df's columns has, in any case of letters."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        k = f"_{name}"
        while k.lower() in taken:
            k = "_" + k
        taken.add(k.lower())
        out.append(k)
    return out


def aside(df: DataFrame, results: list[str], read: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """df without columns of the names of results: such a column is called ``<name>_before`` instead, with as many underscores in front as
    make the name new. Also the present names of the columns in read."""
    moved: dict[str, str] = {}
    taken = {x.lower() for x in [*df.columns, *results]}
    for name in df.columns:
        if name.lower() in {x.lower() for x in results}:
            new = f"{name.lower()}_before"
            while new.lower() in taken:
                new = "_" + new
            taken.add(new.lower())
            moved[name] = new
    return df.withColumnsRenamed(moved) if moved else df, [next((v for k, v in moved.items() if k.lower() == x.lower()), x) for x in read or []]


def text_of(column: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def hash128(column: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a string: together they tell any number of strings apart that a cluster can hold."""
    return F.xxhash64(column), F.xxhash64(F.lit("second"), column)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Bytes of an Arrow batch in the queries and the pipeline.
BATCH_BYTES = 8 << 20


def session(spark: SparkSession) -> SparkSession:
    """The session with a bound on the bytes of an Arrow batch, unless it has one of its own: batches of long texts have to fit in Python
    workers. Operators leave the session's settings as they are; only queries and the pipeline call this."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864", "67108864b"):
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


#: A key is hot if it holds more than one in so many rows: so many keys are at most, which is what a join broadcasts of them.
HOT = 4096


def met_by_key(rows: DataFrame, keyed: DataFrame, on: list[str], held: str) -> DataFrame:
    """The inner join of rows with keyed, whose keys are unique and which says in column ``held`` how many rows have each key at least. The
    few keys that hold many rows are broadcast, HOT of them at most, so that their rows stay where they are; the others are shuffled, and none
    of them fills a task. rows and keyed are read twice."""
    total = rows.count()
    hot = F.col(held) * HOT > total
    few = F.broadcast(keyed.filter(hot))
    rest = rows.join(few.select(*on), on, "left_anti").join(keyed.filter(~hot), on)
    return rows.join(few, on).unionByName(rest)
