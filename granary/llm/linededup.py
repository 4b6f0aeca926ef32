"""Line deduplication against levelled sorted runs of line hashes. DataFrame operations only.

A run is a table of line hashes, (h1, h2, n_docs, owner), bucketed and sorted by hash. Documents come in batches of descending doc_id,
as many as their lines ask for. Each batch merge-anti-joins the runs: a line that no run holds is new, and the batch's largest doc_id with
it becomes its owner; of a line that a run holds only the count is added. The batch then adds its own sorted run. ``FANOUT`` runs of one
level are compacted into one run of the next, by merging them along their buckets, so a line hash lies in at most FANOUT x log(batches)
runs. Runs are never shuffled: a batch is dealt by the same hashes. After the last batch all runs are compacted into one, whose
rows say which lines go.

Only ids, positions and 128-bit hashes of long lines are shuffled until the end; then each document meets the positions it loses.
A line that a third of all documents hold is one row of a run, as every batch aggregates before it shuffles; where lines meet what is
common, the few lines that many documents hold are broadcast and the others dealt by hash.

Defined cases: null or empty texts are one empty line; a row without a doc_id counts, with all others of that kind, as one
document that comes before all others, and never owns a line that another holds; rows that share a doc_id count as one document;
repeated rows lose the same lines; an empty table gives an empty result; extra columns pass through, those called n_lines or n_dropped
under other names (``aside``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, aside, free_names, hash128, met_by_key, new_path, remove, text_of, written_at

MIN_CHARS, MIN_DOCS = 40, 5
FANOUT = 2
#: Lines of a batch at most, and batches at least.
BATCH_LINES, LEAST_BATCHES = 2_000_000_000, 6
#: The id of rows without one.
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


class LineRuns:
    """Runs by level. ``add`` takes one batch of (h1, h2, n_docs, largest). A run is a bucketed table: its rows lie by hash of their key in
    files that are sorted by it, so what is dealt by the same hash meets it without the run's rows being shuffled."""

    KEY = ("h1", "h2")

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[tuple[str, str]]] = []
        # As many as a shuffle has, so that a batch needs no other partitioning to meet a run.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, batch: DataFrame) -> None:
        """Keys that no run holds are new: the batch's largest document owns them. Of others only the count is added."""
        rows, known = batch, F.lit(False)
        for k, (name, _) in enumerate(x for level in self.levels for x in level):
            # Every key is new in one run alone; its rows in others are counts.
            held = self.spark.table(name).filter("owner is not null").select(*self.KEY, F.lit(True).alias(f"held{k}"))
            rows, known = rows.join(held.hint("merge"), list(self.KEY), "left"), known | F.col(f"held{k}").isNotNull()
        self._put(0, self._written(rows.select(*self.KEY, "n_docs", F.when(~known, F.col("largest")).alias("owner"))))

    def _written(self, rows: DataFrame) -> tuple[str, str]:
        path = new_path(self.spark, "lines-run")
        name = f"granary_{path.rsplit('-', 1)[1]}"
        rows.write.option("path", path).bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY).saveAsTable(name)
        return name, path

    def _put(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(old))

    def _merged(self, runs: list[tuple[str, str]]) -> tuple[str, str]:
        """One run of several, two at a time: a merge join along their buckets, which adds up the counts and keeps the one owner."""
        while len(runs) > 1:
            (one, at), (two, there), *rest = runs
            other = self.spark.table(two).withColumnsRenamed({"n_docs": "n", "owner": "o"})
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))
            both = self.spark.table(one).join(other.hint("merge"), list(self.KEY), "full")
            runs = [*rest, self._written(both.select(*self.KEY, total.alias("n_docs"), F.coalesce("owner", "o").alias("owner")))]
            self._drop([(one, at), (two, there)])
        return runs[0]

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, path)

    def compacted(self) -> DataFrame:
        """(h1, h2, n_docs, owner) of every line added, as one run."""
        run = self._merged([x for level in self.levels for x in level])
        self.levels = [[run]]
        return self.spark.table(run[0])

    def close(self) -> None:
        """Removes all runs."""
        for level in self.levels:
            self._drop(level)
        self.levels = []


def long_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """id, hashes of the whole text, position and hashes of the key of every line with at least min_chars."""
    t1, t2 = hash128(text_of(text))
    lines = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        t1.alias("t1"),
        t2.alias("t2"),
        F.posexplode(F.split(text_of(text), "\n", -1)).alias("pos", "line"),
    )
    keyed = lines.filter(F.length("line") >= min_chars).select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).filter(
        F.length("key") >= min_chars
    )
    h1, h2 = hash128(F.col("key"))
    return keyed.select("id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))


def batches_of(lines: DataFrame, batches: int | None, batch_lines: int) -> list[DataFrame]:
    """lines in batches by descending id, as many as their number asks for."""
    k = batches or max(LEAST_BATCHES, -(-lines.count() // batch_lines))
    cuts = lines.select(F.percentile_approx("id", [x / k for x in range(1, k)], 1000).alias("cuts")).first()["cuts"] if k > 1 else []
    edges = sorted(set(cuts or []), reverse=True)
    out = []
    for n in range(len(edges) + 1):
        part = lines.filter(F.col("id") <= edges[n - 1]) if n else lines
        out.append(part.filter(F.col("id") > edges[n]) if n < len(edges) else part)
    return out


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, batch_lines: int = BATCH_LINES, n_chars: str | None = None
) -> DataFrame:
    """docs with the text that is left in place of the whole one, and the columns n_lines (before) and n_dropped. Keys of at least
    min_chars code points that at least min_docs documents hold lose their lines everywhere but in the largest doc_id. n_chars:
    a column to hold the length of what is left."""
    docs, [doc_id, text] = aside(docs, ["n_lines", "n_dropped"], [doc_id, text])
    lines, lines_at = written_at(long_lines(docs, doc_id, text, min_chars), "lines")
    runs = LineRuns(docs.sparkSession)
    for part in batches_of(lines, batches, batch_lines):
        # Lines repeat within documents and across them: first one row for each document and line, then one for each line.
        once = part.select("h1", "h2", "id").distinct()
        runs.add(once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("largest")))
    common, common_at = written_at(runs.compacted().filter(F.col("n_docs") >= min_docs), "lines-common")
    runs.close()
    met = met_by_key(lines, common, ["h1", "h2"], "n_docs")
    lost, lost_at = written_at(met.filter(F.col("id") < F.col("owner")).groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("lost")), "lines-lost")
    for path in (lines_at, common_at):
        remove(docs.sparkSession, path)
    own_id, one, two, gone, split = free_names(docs, "id", "t1", "t2", "lost", "lines")
    own = {own_id: F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))} | dict(zip((one, two), hash128(text_of(text)), strict=True))
    both = docs.withColumns(own).join(lost.toDF(own_id, one, two, gone), [own_id, one, two], "left")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone), lambda i: F.get(split, i))
    # A document that loses nothing keeps its text as it is; its lines are only counted.
    whole = F.col(gone).isNull()
    rows = both.withColumn(split, F.when(~whole, F.split(text_of(text), "\n", -1))).withColumns(
        {
            text: F.when(whole, F.col(text)).otherwise(F.array_join(left, "\n")),
            "n_lines": (F.length(text_of(text)) - F.length(F.replace(text_of(text), F.lit("\n"), F.lit(""))) + 1).cast("long"),
            "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        }
    )
    if n_chars:
        rows = rows.withColumn(n_chars, F.length(text_of(text)).cast(docs.schema[n_chars].dataType))
    return rows.select(*docs.columns, "n_lines", "n_dropped")


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l),
hot AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, hot.owner IS NOT NULL AND k.doc_id < hot.owner AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
