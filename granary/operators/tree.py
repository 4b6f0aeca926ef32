"""Trees as rows: (path, kind, leaf_id, ...) with kind dir, reg, chr, blk, fifo, sock or lnk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .common import numbered

FORMATS = {0o040000: "dir", 0o100000: "reg", 0o120000: "lnk", 0o020000: "chr", 0o060000: "blk", 0o010000: "fifo", 0o140000: "sock"}


def kind_of_mode(mode: Column) -> Column:
    out = None
    for bits, name in FORMATS.items():
        test = mode.bitwiseAND(0o170000) == bits
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def ordered(entries: DataFrame, name: str = "ordinal") -> DataFrame:
    """Depth-first order, each directory before its children, siblings by name: a number for each row."""
    return numbered(entries.withColumn("_parts", paths.parts(F.col("path"))), ["_parts"], name).drop("_parts")


def children(entries: DataFrame, of: str) -> DataFrame:
    """The names in one directory in order."""
    return entries.filter(paths.parent(F.col("path")) == of).withColumn("name", paths.name(F.col("path"))).orderBy("name")


def lookup(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path) with its entry, null where there is none."""
    return wanted.join(entries, "path", "left")


def dir_links(entries: DataFrame) -> DataFrame:
    """(path, nlink) of directories: two, and one for each directory in it."""
    dirs = entries.filter("kind = 'dir'").select("path")
    below = dirs.select(paths.parent(F.col("path")).alias("path")).filter("path is not null").groupBy("path").agg(F.count("*").alias("n"))
    return dirs.join(below, "path", "left").select("path", (F.lit(2) + F.coalesce("n", F.lit(0))).alias("nlink"))


def leaf_links(leaves: DataFrame, entries: DataFrame, key: str = "leaf_id") -> DataFrame:
    """Leaves with the number of entries that name them, zero included."""
    counts = entries.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("nlink"))
    return leaves.join(counts, key, "left").withColumn("nlink", F.coalesce("nlink", F.lit(0)))


def newest(entries: DataFrame, mtime: str = "mtime") -> DataFrame:
    """(path, newest): the newest time in each directory's subtree. Every row goes to all its ancestors, and partial maxima are
    taken before the shuffle."""
    up = entries.select(F.explode(paths.ancestors(F.col("path"))).alias("path"), mtime)
    own = entries.filter("kind = 'dir'").select("path", mtime)
    return up.unionAll(own).groupBy("path").agg(F.max(mtime).alias("newest"))


def primary_links(entries: DataFrame) -> DataFrame:
    """entries with link_to: null for the first path of a leaf in tree order, that path for the others."""
    first = entries.filter("leaf_id is not null").groupBy("leaf_id").agg(F.min(paths.parts(F.col("path"))).alias("_first"))
    rows = entries.join(first, "leaf_id", "left").withColumn("_first", paths.of_parts(F.col("_first")))
    return rows.withColumn("link_to", F.when(F.col("_first") != F.col("path"), F.col("_first"))).drop("_first")


def without(entries: DataFrame, doomed: DataFrame) -> DataFrame:
    """Entries that are neither one of the doomed paths nor below one."""
    each = entries.select("path", F.explode(paths.ancestors(F.col("path"), itself=True)).alias("above"))
    gone = each.join(doomed.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return entries.join(gone, "path", "left_anti")


def cleared(entries: DataFrame, dirs: list[str]) -> DataFrame:
    """Entries without what lies below the named directories, which stay."""
    inside = None
    for d in dirs:
        test = F.col("path").startswith(d.rstrip("/") + "/") & (F.col("path") != d)
        inside = test if inside is None else inside | test
    return entries if inside is None else entries.filter(~inside)


def taken_from(entries: DataFrame, of: str, to: list[str], fields: list[str]) -> DataFrame:
    """Stat fields of the named rows replaced by those of one row, such as the root's by those of /usr; without that row they stay."""
    source = entries.filter(F.col("path") == of).agg(F.first(F.struct(*fields)).alias("stat")).scalar()
    rows = entries.withColumn("_stat", F.when(F.col("path").isin(to), source))
    return rows.withColumns({x: F.when(F.col("_stat").isNull(), F.col(x)).otherwise(F.col(f"_stat.{x}")) for x in fields}).drop("_stat")


def transform_for_oci(entries: DataFrame) -> DataFrame:
    """The root takes /usr's stat; /run is emptied and takes its time."""
    rooted = taken_from(entries, "/usr", ["/"], ["mode", "uid", "gid", "mtime", "xattrs"])
    return taken_from(cleared(rooted, ["/run"]), "/usr", ["/run"], ["mtime"])


def emptied_for_boot(entries: DataFrame) -> DataFrame:
    return taken_from(cleared(entries, ["/boot", "/sysroot"]), "/usr", ["/boot", "/sysroot"], ["mtime"])


def compacted(entries: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves that entries name, numbered anew without gaps, and the entries with the new numbers."""
    used = numbered(leaves.join(entries.select("leaf_id"), "leaf_id", "left_semi"), ["leaf_id"], "_new")
    moved = entries.join(used.select("leaf_id", "_new"), "leaf_id", "left").drop("leaf_id").withColumnRenamed("_new", "leaf_id")
    return moved, used.drop("leaf_id").withColumnRenamed("_new", "leaf_id")


def leaf_errors(entries: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaf ids that entries name but no leaf has, and leaves that no entry names."""
    named = entries.filter("leaf_id is not null").select("leaf_id").distinct()
    missing = named.join(leaves.select("leaf_id"), "leaf_id", "left_anti").withColumn("error", F.lit("out of range"))
    return missing.unionByName(leaves.select("leaf_id").join(named, "leaf_id", "left_anti").withColumn("error", F.lit("orphan")))


def shared_values(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Values used more than once, numbered in their order: the dictionary of shared values."""
    return numbered(pairs.groupBy(*keys).agg(F.count("*").alias("uses")).filter("uses > 1"), list(keys), "idx")


def dictionary(rows: DataFrame, value: str, seq: str) -> DataFrame:
    """(value, first_seq, idx): values numbered by their first appearance."""
    return numbered(rows.groupBy(value).agg(F.min(seq).alias("first_seq")), ["first_seq"], "idx")


def filtered_xattrs(entries: DataFrame, keep: list[str], column: str = "xattrs") -> DataFrame:
    return entries.withColumn(column, F.map_filter(column, lambda k, v: k.cast("string").isin(keep)))


def scanned_once(files: DataFrame) -> DataFrame:
    """Of the rows of an inode (dev, ino) the first path in tree order."""
    order = Window.partitionBy("dev", "ino").orderBy(paths.parts(F.col("path")))
    return files.withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row")


def below(entries: DataFrame, path: str) -> DataFrame:
    """A directory and all in it."""
    return entries.filter((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))


def with_stats(entries: DataFrame, **changes: Callable[[Column], Column]) -> DataFrame:
    """entries with fields of their stat changed by functions of the old value. Rows of one leaf have one stat, so they stay alike."""
    return entries.withColumns({name: change(F.col(name)) for name, change in changes.items()})


def with_regular(entries: DataFrame, **changes: Callable[[Column], Column]) -> DataFrame:
    """entries with fields of regular files changed; all else stays."""
    regular = F.col("kind") == "reg"
    return entries.withColumns({name: F.when(regular, change(F.col(name))).otherwise(F.col(name)) for name, change in changes.items()})


def plain_xattrs(entries: DataFrame, column: str = "xattrs") -> DataFrame:
    """entries without the attribute that marks a directory as one with whiteouts in another form."""
    marks = ("trusted.overlay.opaque", "user.overlay.opaque")
    return entries.withColumn(column, F.map_filter(column, lambda k, v: ~(k.cast("string").isin(*marks) & (v.cast("string") == "x"))))


#: What a look-up can want.
ANYTHING, DIRECTORY, LEAF, REGULAR = "anything", "directory", "leaf", "regular"


def resolved(entries: DataFrame, wanted: DataFrame, what: str = ANYTHING) -> DataFrame:
    """wanted (path) with the entry's kind and leaf_id and an error: an invalid name, a path below something that is no directory, one that isn't
    there, or an entry of another kind than is wanted. Paths meet their entry and those above it by equality."""
    kinds = entries.select("path", "kind", "leaf_id")
    parts = F.split(F.substring("path", 2, 1 << 20), "/")
    odd = (F.col("path") != "/") & (~F.col("path").startswith("/") | F.exists(parts, lambda x: x.isin("", ".", "..")))
    asked = wanted.select("path").distinct().withColumn("invalid", odd)
    above = asked.filter("not invalid").select("path", F.explode(paths.ancestors(F.col("path"))).alias("above"))
    met = above.join(kinds.select(F.col("path").alias("above"), F.col("kind").alias("above_kind")), "above", "left")
    # The first thing on the way that isn't a directory decides.
    depth = F.size(paths.parts(F.col("above")))
    blocked = met.filter("above_kind is null or above_kind <> 'dir'").groupBy("path").agg(
        F.min_by(F.coalesce("above_kind", F.lit("none")), depth).alias("stop")
    )
    rows = asked.join(blocked, "path", "left").join(kinds, "path", "left")
    is_dir = F.col("kind") == "dir"
    wrong = {ANYTHING: F.lit(False), DIRECTORY: ~is_dir, LEAF: is_dir, REGULAR: F.col("kind") != "reg"}[what]
    error = (
        F.when(F.col("invalid"), "invalid name")
        .when(F.col("stop") == "none", "not found")
        .when(F.col("stop").isNotNull(), "not a directory")
        .when(F.col("kind").isNull(), "not found")
        .when(wrong & (F.lit(what) == DIRECTORY), "not a directory")
        .when(wrong & is_dir, "a directory")
        .when(wrong, "not a regular file")
    )
    found = rows.select(
        "path", F.when(error.isNull(), F.col("kind")).alias("kind"), F.when(error.isNull(), F.col("leaf_id")).alias("leaf_id"), error.alias("error")
    )
    return wanted.join(found, "path", "left")


def inserted(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries with new ones, each in place of what was at its path, a directory with all in it included."""
    return without(entries, new.select("path")).unionByName(new)


def popped(entries: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """What was at a path, with all below it, and the tree without it."""
    return below(entries, path), without(entries, entries.sparkSession.createDataFrame([(path,)], "path string"))
