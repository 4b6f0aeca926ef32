"""Layers of changes folded into one tree, with tombstones.

Entries are ordered by (layer_idx, entry_idx). A directory put on a directory changes its stat alone; any other put replaces what was
there. ".wh.X" removes X beside it with its subtree; ".wh..wh..opq" removes all children of its directory. The fold has a closed
form: a path is in the result if its last put comes after every event that removes it, and those are whiteouts of the path or an
ancestor, opaque marks of an ancestor, and puts of anything but a directory on an ancestor. So it takes equi-joins only, whatever
the number of layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .common import cut

WHITEOUT, OPAQUE = ".wh.", ".wh..wh..opq"


def events(entries: DataFrame) -> DataFrame:
    """entries (layer_idx, entry_idx, path, item, target, ...) with seq, event (put, whiteout or opaque) and the path it is about."""
    name = paths.name(F.col("path"))
    above = F.coalesce(paths.parent(F.col("path")), F.lit("/"))
    beside = F.when(above == "/", F.concat(F.lit("/"), F.substring(name, 5, 1 << 20))).otherwise(F.concat(above, F.lit("/"), F.substring(name, 5, 1 << 20)))
    kind = F.when(name == OPAQUE, "opaque").when(name.startswith(WHITEOUT), "whiteout").otherwise("put")
    rows = entries.withColumns({"seq": F.struct("layer_idx", "entry_idx"), "event": kind})
    # A bare ".wh." names nothing and so removes nothing.
    return rows.withColumn(
        "about", F.when(F.col("event") == "opaque", above).when((F.col("event") == "whiteout") & (name != WHITEOUT), beside).otherwise(F.col("path"))
    )


def kills(found: DataFrame) -> DataFrame:
    """(about, on_self, below): the last event that removes the path itself, and the last that removes what is below it."""
    put_over = (F.col("event") == "put") & (F.col("item") != "dir")
    return found.groupBy("about").agg(
        F.max(F.when(F.col("event") == "whiteout", F.col("seq"))).alias("on_self"),
        F.max(F.when((F.col("event") != "put") | put_over, F.col("seq"))).alias("below"),
    )


def folded(entries: DataFrame) -> DataFrame:
    """The merged tree: the last put of every path that is left, with its columns."""
    found = events(entries)
    values = [x for x in entries.columns if x != "path"]
    last = found.filter("event = 'put'").groupBy("path").agg(F.max_by(F.struct("seq", *values), F.col("seq")).alias("last"))
    dead = kills(found).filter("on_self is not null or below is not null")
    each = last.select("path", F.col("last.seq").alias("seq"), F.explode(paths.ancestors(F.col("path"), itself=True)).alias("about"))
    hit = F.when(F.col("about") == F.col("path"), F.col("on_self")).otherwise(F.col("below"))
    gone = each.join(dead, "about").filter(hit > F.col("seq")).select("path").distinct()
    return last.join(gone, "path", "left_anti").select("path", *(F.col(f"last.{x}").alias(x) for x in values))


def invalid(entries: DataFrame) -> DataFrame:
    """Entries whose parent is no directory when their turn comes, and anything but a directory put on the root: the fold's input
    is valid if there are none. Each entry meets the last thing that happened to its directory before it, in one pass in order."""
    found = events(entries)
    puts = found.filter("event = 'put'").select(F.col("path").alias("dir"), "seq", F.when(F.col("item") == "dir", "dir").otherwise("other").alias("state"))
    line = puts.unionByName(kills_by_path(found).select(F.col("path").alias("dir"), "seq", F.lit("gone").alias("state")))
    # Of a path that names a tombstone, the directory is that of the tombstone.
    need = found.filter("path <> '/'").withColumn("dir", F.coalesce(paths.parent(F.col("path")), F.lit("/"))).filter("dir <> '/'")
    rows = line.withColumn("path", F.lit(None).cast("string")).unionByName(need.select("dir", "seq", F.lit(None).cast("string").alias("state"), "path"))
    # What an entry does itself comes after it has been looked at.
    order = Window.partitionBy("dir").orderBy("seq", F.col("path").isNull())
    seen = rows.withColumn("last", F.last("state", ignorenulls=True).over(order)).filter("path is not null")
    orphans = seen.filter(F.coalesce("last", F.lit("gone")) != "dir").select(
        "seq.layer_idx", "seq.entry_idx", "path", F.lit("no parent directory").alias("error")
    )
    root = found.filter("path = '/' and item <> 'dir'").select("layer_idx", "entry_idx", "path", F.lit("the root is a directory").alias("error"))
    return orphans.unionByName(root)


def kills_by_path(found: DataFrame) -> DataFrame:
    """(path, seq) for every put path and event that removes it by itself or an ancestor."""
    put_over = (F.col("event") == "put") & (F.col("item") != "dir")
    kill = found.filter((F.col("event") != "put") | put_over).select("about", F.col("seq"), (F.col("event") == "whiteout").alias("self"))
    each = found.filter("event = 'put'").select("path").distinct().select("path", F.explode(paths.ancestors(F.col("path"), itself=True)).alias("about"))
    return each.join(kill, "about").filter((F.col("about") != F.col("path")) | F.col("self")).select("path", "seq").distinct()


def origins(entries: DataFrame) -> DataFrame:
    """(layer_idx, entry_idx, origin_layer, origin_entry) for each hard link: the leaf put that its target was when the link's turn
    came, through other links. Each round leads all open links to the last put of their target before them, in one pass over puts and links in
    order; as each step leads to an earlier put, the rounds end. Links that lead nowhere have no row."""
    puts = events(entries).filter("event = 'put'").select("path", "seq", "item", "target")
    open_links = puts.filter("item = 'hardlink'").select(F.col("seq").alias("link"), F.col("target").alias("path"), F.col("seq").alias("before"))
    leaves = puts.select("path", F.col("seq").alias("before"), F.struct(F.col("seq").alias("at"), "item", F.col("target").alias("next")).alias("put"))
    done = None
    while True:
        rows = leaves.unionByName(open_links, allowMissingColumns=True)
        # A put at a link's own turn is the link itself.
        order = Window.partitionBy("path").orderBy("before", F.col("link").isNull())
        step = rows.withColumn("hit", F.last("put", ignorenulls=True).over(order)).filter("link is not null and hit is not null")
        step = cut(step.select("link", "hit"))
        found = step.filter("hit.item = 'leaf'").select("link", F.col("hit.at").alias("origin"))
        done = found if done is None else done.unionAll(found)
        open_links = step.filter("hit.item = 'hardlink'").select("link", F.col("hit.next").alias("path"), F.col("hit.at").alias("before"))
        if open_links.isEmpty():
            break
    return done.select("link.layer_idx", "link.entry_idx", F.col("origin.layer_idx").alias("origin_layer"), F.col("origin.entry_idx").alias("origin_entry"))


def whiteout(entry_name: Column) -> Column:
    """A name that takes away the one after its mark."""
    return entry_name.startswith(WHITEOUT) & ~entry_name.isin(WHITEOUT, OPAQUE)


def stored_whiteout(kind: Column, rdev: Column) -> Column:
    """The form that whiteouts have in a store's folders: a character device of the number zero."""
    return (kind == "chr") & (rdev == 0)


def opaque(xattrs: Column) -> Column:
    """A stored directory that hides what lies below it: an overlay attribute says y."""
    said = lambda name: F.coalesce(F.element_at(xattrs, F.lit(name).cast("binary")) == F.lit("y").cast("binary"), F.lit(False))
    return said("trusted.overlay.opaque") | said("user.overlay.opaque")
