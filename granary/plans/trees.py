"""Queries over trees, layers, labels and dumps, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import debug, paths, text
from ..operators import fold, label, tree
from ..sources import dumpfile
from .registry import query, table

_BINARY = "map<binary, binary>"


def parts_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of folders by type, and folders with a meaning of their own: path, kind, leaf_id, mode, uid, gid, mtime, size, xattrs.
    Parts of one size and name share a leaf."""
    part = table(spark, sf_dir, "part")
    nothing = F.create_map().cast(_BINARY)
    xattrs = F.create_map(
        F.lit("user.brand").cast("binary"), F.col("p_brand").cast("binary"), F.lit("security.selinux").cast("binary"), F.lit("old_t").cast("binary")
    )
    columns = lambda path, kind, leaf, mode, uid, mtime, size, x: [  # noqa: E731, E501
        path.alias("path"),
        kind.alias("kind"),
        leaf.cast("long").alias("leaf_id"),
        F.lit(mode).alias("mode"),
        uid.cast("long").alias("uid"),
        F.lit(0).cast("long").alias("gid"),
        mtime.cast("long").alias("mtime"),
        size.cast("long").alias("size"),
        x.alias("xattrs"),
    ]
    zero = F.lit(0)
    files = part.select(
        *columns(
            F.concat(F.lit("/usr/"), "p_type", F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), "p_partkey"),
            F.lit("reg"),
            F.floor(F.col("p_partkey") / 2),
            0o644,
            F.col("p_size"),
            F.col("p_partkey"),
            F.col("p_size"),
            xattrs,
        )
    )
    dirs = part.select(F.concat(F.lit("/usr/"), "p_type").alias("path")).distinct()
    dirs = dirs.unionAll(spark.createDataFrame([(x,) for x in ("/", "/usr", "/run", "/boot", "/sysroot", "/run/lock")], "path string"))
    own = dirs.select(
        *columns(
            F.col("path"),
            F.lit("dir"),
            F.lit(None),
            0o755,
            F.when(F.col("path") == "/usr", 7).otherwise(0),
            F.when(F.col("path") == "/usr", 1234).otherwise(1),
            zero,
            nothing,
        )
    )
    run = part.filter("p_size = 1").select(
        *columns(F.concat(F.lit("/run/lock/"), "p_partkey"), F.lit("reg"), F.col("p_partkey") + 1_000_000, 0o600, zero, zero, zero, nothing)
    )
    boot = part.filter("p_size = 2").select(
        *columns(F.concat(F.lit("/boot/"), "p_partkey"), F.lit("reg"), F.col("p_partkey") + 2_000_000, 0o600, zero, zero, zero, nothing)
    )
    return files.unionAll(own).unionAll(run).unionAll(boot)


_TREE = """t AS (SELECT '/usr/' || p_type || '/' || replace(p_name, ' ', '-') || '-' || p_partkey AS path, 'reg' AS kind, p_partkey // 2 AS leaf_id, 420 AS mode, CAST(p_size AS BIGINT) AS uid, p_partkey AS mtime, CAST(p_size AS BIGINT) AS size, p_brand AS brand FROM part
UNION ALL SELECT DISTINCT '/usr/' || p_type, 'dir', NULL, 493, 0, 1, 0, NULL FROM part
UNION ALL SELECT p, 'dir', NULL, 493, CASE WHEN p = '/usr' THEN 7 ELSE 0 END, CASE WHEN p = '/usr' THEN 1234 ELSE 1 END, 0, NULL FROM (VALUES ('/'), ('/usr'), ('/run'), ('/boot'), ('/sysroot'), ('/run/lock')) v(p)
UNION ALL SELECT '/run/lock/' || p_partkey, 'reg', p_partkey + 1000000, 384, 0, 0, 0, NULL FROM part WHERE p_size = 1
UNION ALL SELECT '/boot/' || p_partkey, 'reg', p_partkey + 2000000, 384, 0, 0, 0, NULL FROM part WHERE p_size = 2)"""


@query(f"""
WITH {_TREE} SELECT path, uid, mtime FROM (SELECT path, CASE WHEN path = '/' THEN 7 ELSE uid END AS uid, CASE WHEN path IN ('/', '/run', '/boot', '/sysroot') THEN 1234 ELSE mtime END AS mtime FROM t)
WHERE NOT starts_with(path, '/run/') AND NOT starts_with(path, '/boot/')""")
def canonical_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree as images hold it: the root with the stat of /usr, and emptied top-level folders."""
    return tree.emptied_for_boot(tree.transform_for_oci(parts_tree(spark, sf_dir))).select("path", "uid", "mtime")


@query(f"""
WITH {_TREE}, n AS (SELECT leaf_id, row_number() OVER (ORDER BY leaf_id) - 1 AS new FROM (SELECT DISTINCT leaf_id FROM t WHERE leaf_id IS NOT NULL AND NOT starts_with(path, '/usr/PROMO')))
SELECT path, new AS leaf_id FROM t LEFT JOIN n USING (leaf_id) WHERE NOT starts_with(path, '/usr/PROMO')""")
def remap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves that are left when a folder has gone, numbered anew without gaps."""
    rows = parts_tree(spark, sf_dir)
    left = tree.without(rows, spark.createDataFrame([("/usr/PROMO",)], "path string"))
    leaves = rows.filter("leaf_id is not null").select("leaf_id").distinct()
    return tree.compacted(left, leaves)[0].select("path", "leaf_id")


@query(f"""
WITH {_TREE}, k AS (SELECT DISTINCT leaf_id FROM t WHERE leaf_id IS NOT NULL)
SELECT leaf_id, 'orphan' AS error FROM k WHERE leaf_id NOT IN (SELECT leaf_id FROM t WHERE leaf_id IS NOT NULL AND leaf_id % 3 <> 0)
UNION ALL SELECT leaf_id, 'out of range' FROM k WHERE leaf_id % 3 <> 0 AND leaf_id % 7 = 0""")
def leaf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that nothing names, and entries of leaves that aren't there."""
    rows = parts_tree(spark, sf_dir).filter("leaf_id is not null")
    entries = rows.filter("leaf_id % 3 <> 0")
    leaves = rows.select("leaf_id").distinct().filter("leaf_id % 7 <> 0 or leaf_id % 3 = 0")
    return tree.leaf_errors(entries, leaves)


@query(f"""
WITH {_TREE}, f AS (SELECT leaf_id, arg_min(path, list_filter(string_split(path, '/'), lambda x: x <> '')) AS first FROM t WHERE leaf_id IS NOT NULL GROUP BY 1)
SELECT path, CASE WHEN path <> first THEN first END AS link_to FROM t LEFT JOIN f USING (leaf_id)""")
def primary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaf in full under its first path, its other paths as links to it."""
    return tree.primary_links(parts_tree(spark, sf_dir)).select("path", "link_to")


@query(f"""
WITH {_TREE}, w AS (SELECT path FROM t WHERE size = 5 UNION ALL SELECT path || '/none' FROM t WHERE size = 6)
SELECT 'lookup' AS what, w.path AS path, t.kind AS value FROM w LEFT JOIN t USING (path)
UNION ALL SELECT 'child', path, regexp_extract(path, '([^/]*)$', 1) FROM t WHERE starts_with(path, '/usr/') AND NOT contains(substr(path, 6), '/')
UNION ALL SELECT 'below', path, kind FROM t WHERE path = '/run' OR starts_with(path, '/run/')
UNION ALL SELECT 'cleared', path, kind FROM t WHERE NOT starts_with(path, '/run/') AND NOT starts_with(path, '/usr/')""")
def tree_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths looked up, the names in a folder, a folder with all in it, and a tree with folders emptied."""
    rows = parts_tree(spark, sf_dir)
    wanted = rows.filter("size = 5").select("path").unionAll(rows.filter("size = 6").select(F.concat("path", F.lit("/none"))))
    of = lambda what, found, value: found.select(F.lit(what).alias("what"), "path", F.col(value).alias("value"))
    parts = [
        of("lookup", tree.lookup(rows, wanted), "kind"),
        of("child", tree.children(rows, "/usr"), "name"),
        of("below", tree.below(rows, "/run"), "kind"),
        of("cleared", tree.cleared(rows, ["/run", "/usr"]), "kind"),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(f"""
WITH {_TREE} SELECT path, mode, uid + 1000 AS uid, CASE WHEN kind = 'reg' THEN size * 2 ELSE size END AS size, brand FROM t""")
def changed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stat fields changed for all entries, fields of regular files alone, and attributes that are allowed to stay."""
    rows = tree.with_regular(tree.with_stats(parts_tree(spark, sf_dir), uid=lambda c: c + 1000), size=lambda c: c * 2)
    kept = tree.filtered_xattrs(tree.plain_xattrs(rows), ["user.brand"])
    sole = F.when(F.size("xattrs") == 1, F.map_values("xattrs")[0].cast("string"))
    return kept.select("path", "mode", "uid", "size", sole.alias("brand"))


_RULES = ("/.* any_t", "/usr/PROMO(/.*)? promo_t", r"/usr/[^/]+/small-.* -- small_t", "/usr/deep/.* -- deep_t", "/run -d run_t", "/boot/.* <<none>>")


@query(f"""
WITH {_TREE}, a AS (SELECT *, regexp_replace(path, '^/usr/STANDARD(/|$)', '/usr/deep\\1') AS p FROM t),
l AS (SELECT *, CASE WHEN starts_with(p, '/boot/') THEN NULL WHEN p = '/run' THEN 'run_t' WHEN starts_with(p, '/usr/deep/') AND kind = 'reg' THEN 'deep_t'
  WHEN regexp_full_match(p, '/usr/[^/]+/small-.*') AND kind = 'reg' THEN 'small_t' WHEN regexp_full_match(p, '/usr/PROMO(/.*)?') THEN 'promo_t' ELSE 'any_t' END AS own FROM a),
b AS (SELECT leaf_id, arg_max(coalesce(own, ''), list_filter(string_split(path, '/'), lambda x: x <> '')) AS of_leaf FROM l WHERE leaf_id IS NOT NULL GROUP BY 1)
SELECT path, nullif(CASE WHEN leaf_id IS NULL THEN coalesce(own, '') ELSE of_leaf END, '') AS label, brand FROM l LEFT JOIN b USING (leaf_id)""")
def policy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree labelled by a policy with an alias; old labels go."""
    made = label.relabelled(parts_tree(spark, sf_dir), label.rules(list(_RULES)), label.substitutions(["/usr/STANDARD /usr/deep"]))
    said = lambda name: F.element_at("xattrs", F.lit(name).cast("binary")).cast("string")
    return made.select("path", said("security.selinux").alias("label"), said("user.brand").alias("brand"))


_SELINUX = {
    "/etc/selinux/config": "# a comment\nSELINUX=enforcing\nSELINUXTYPE = house\nSELINUXTYPE=other\n",
    "/etc/selinux/house/contexts/files/file_contexts": "# rules\n/.* base_t\n/[A-M].* -- early_t\n",
    "/etc/selinux/house/contexts/files/file_contexts.local": "/MEDIUM.* -- medium_t\n",
    "/etc/selinux/house/contexts/files/file_contexts.subs": "/LARGE /SMALL\n",
}


@query("""
SELECT p_partkey, CASE WHEN p_type = 'MEDIUM' THEN 'medium_t' WHEN p_type = 'LARGE' THEN 'base_t' WHEN p_type < 'N' THEN 'early_t' ELSE 'base_t' END AS label FROM part""")
def policy_from_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the policy that a tree itself holds: the first type named, its local rules last, and its aliases."""
    found, aliases = label.load_policy(spark.createDataFrame(list(_SELINUX.items()), "path string, content string"))
    path = F.concat(F.lit("/"), "p_type", F.lit("/"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", label.label(label.aliased(path, aliases), F.lit("reg"), found).alias("label"))


@query("""
SELECT event_id % 500 AS dev_ino, arg_min('/u' || user_id || '/' || event_id, ['u' || user_id, CAST(event_id AS VARCHAR)]) AS path FROM events GROUP BY 1""")
def scanned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the paths of one inode the first in tree order."""
    rows = table(spark, sf_dir, "events").select(
        F.lit(1).alias("dev"), (F.col("event_id") % 500).alias("ino"), F.concat(F.lit("/u"), "user_id", F.lit("/"), "event_id").alias("path")
    )
    return tree.scanned_once(rows).select(F.col("ino").alias("dev_ino"), "path")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes below /user: views are files, purchases links to the view, signups links to the purchase, errors opaque marks, clicks
    whiteouts of the view. Folders of users are put by every tenth event."""
    user = F.concat(F.lit("/u"), "user_id")
    kind = F.col("event_type")
    name = F.create_map(
        *(F.lit(x) for pair in {"view": "view", "purchase": "purchase", "signup": "signup", "error": ".wh..wh..opq", "click": ".wh.view"}.items() for x in pair)
    )
    target = F.when(kind == "purchase", F.concat(user, F.lit("/view"))).when(kind == "signup", F.concat(user, F.lit("/purchase")))
    events = table(spark, sf_dir, "events")
    layer = F.datediff("ts", F.lit("2024-01-01")).alias("layer_idx")
    rows = events.select(
        layer,
        (F.col("event_id") * 2).alias("entry_idx"),
        F.concat(user, F.lit("/"), F.element_at(name, kind)).alias("path"),
        F.when(target.isNotNull(), "hardlink").otherwise("leaf").alias("item"),
        target.alias("target"),
    )
    dirs = events.filter("event_id % 10 = 0").select(
        layer, (F.col("event_id") * 2 + 1).alias("entry_idx"), user.alias("path"), F.lit("dir").alias("item"), F.lit(None).cast("string").alias("target")
    )
    return rows.unionAll(dirs)


_CHANGES = """e AS (SELECT event_id, user_id, event_type, datediff('day', TIMESTAMP '2024-01-01', ts) * 1000000000 + event_id AS seq FROM events)"""


@query(f"""
WITH {_CHANGES}, w AS (SELECT *, max(CASE WHEN event_type = 'view' THEN seq END) OVER o AS v, max(CASE WHEN event_type = 'purchase' THEN seq END) OVER o AS p FROM e WINDOW o AS (PARTITION BY user_id ORDER BY seq))
SELECT event_id, v % 1000000000 AS target_id FROM w WHERE event_type = 'purchase' AND v IS NOT NULL
UNION ALL SELECT w.event_id, q.v % 1000000000 FROM w JOIN w q ON q.seq = w.p WHERE w.event_type = 'signup' AND q.v IS NOT NULL""")
def hardlink_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each hard link led to when its turn came, through other links."""
    found = fold.origins(changes(spark, sf_dir))
    return found.select((F.col("entry_idx") / 2).cast("long").alias("event_id"), (F.col("origin_entry") / 2).cast("long").alias("target_id"))


@query(f"""
WITH {_CHANGES}, w AS (SELECT *, min(CASE WHEN event_id % 10 = 0 THEN seq END) OVER (PARTITION BY user_id) AS d FROM e)
SELECT event_id * 2 AS entry_idx, 'no parent directory' AS error FROM w WHERE d IS NULL OR seq <= d""")
def orphaned_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that come before the folder that they are in."""
    return fold.invalid(changes(spark, sf_dir)).select("entry_idx", "error")


@query("""
SELECT event_id, event_type = 'click' AS removes, event_type = 'signup' AND user_id % 2 = 0 AS stored, event_type = 'error' AND user_id % 3 = 0 AS hides FROM events""")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of whiteouts: by name, as a device of a store's folder, and as an attribute that hides what lies below."""
    kind = F.col("event_type")
    name = F.when(kind == "click", ".wh.x").when(kind == "error", ".wh..wh..opq").when(kind == "view", ".wh.").otherwise("x.wh.")
    device = F.when(kind == "signup", "chr").otherwise("reg")
    xattrs = F.create_map(
        F.when(kind == "error", F.lit("trusted.overlay.opaque")).otherwise("user.x").cast("binary"),
        F.when(F.col("user_id") % 3 == 0, F.lit("y")).otherwise("x").cast("binary"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", fold.whiteout(name).alias("removes"), fold.stored_whiteout(device, F.col("user_id") % 2).alias("stored"), fold.opaque(xattrs).alias("hides")
    )


@query(
    "SELECT user_id, event_id, event_type FROM (SELECT *, max(event_id) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id) AS mark FROM events) WHERE mark IS NULL OR event_id > mark"
)
def opaque_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of their user, errors as marks that hide all files of the user before them."""
    user = F.concat(F.lit("/u"), "user_id")
    path = F.when(F.col("event_type") == "error", F.concat(user, F.lit("/.wh..wh..opq"))).otherwise(F.concat(user, F.lit("/"), "event_id"))
    entries = table(spark, sf_dir, "events").select(
        F.lit(0).alias("layer_idx"),
        F.col("event_id").alias("entry_idx"),
        path.alias("path"),
        F.lit("leaf").alias("item"),
        F.lit(None).cast("string").alias("target"),
        "user_id",
        "event_id",
        "event_type",
    )
    return fold.folded(entries).select("user_id", "event_id", "event_type")


@query("""
SELECT CAST(user_id % 4 AS VARCHAR) AS image_id, event_type AS kind, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes,
       round(100.0 * sum(length(props)) / sum(sum(length(props))) OVER (PARTITION BY user_id % 4), 6) AS percent FROM events GROUP BY user_id % 4, event_type""")
def space_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The space of each kind of segment in each image."""
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).cast("string").alias("image_id"), F.col("event_type").alias("kind"), F.length("props").cast("long").alias("size")
    )
    return debug.space(rows).select("image_id", "kind", "n", "bytes", F.round("percent", 6).alias("percent"))


@query("""
WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'padding' ELSE event_type END AS kind, length(props) AS size FROM events),
w AS (SELECT *, lag(kind) OVER o AS before, lead(kind) OVER o AS after FROM s WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT before, after, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM w WHERE kind = 'padding' GROUP BY 1, 2""")
def gap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding by what lies on its two sides."""
    kind = F.when(F.col("event_type") == "error", "padding").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("image_id"), F.col("event_id").alias("offset"), kind.alias("kind"), F.length("props").cast("long").alias("size")
    )
    return debug.padding_between(rows)


@query(r"""
SELECT p_partkey AS line_no, '/a/' || replace(p_name, ' ', '\x20') || ' ' || length(p_brand || '=' || chr(10)) || ' 100644 1 ' || p_size || ' 0 0 1000.0 - ' || p_brand || '=\n' || ' - user.t\x3dx=' || replace(p_type, ' ', '\x20') AS value FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, '/a/link' || p_partkey || ' 0 @120000 - - - - 0.0 /a/' || replace(p_name, ' ', '\x20') || ' - -' FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, '/a/dash' || p_partkey || ' 1 120777 1 0 0 0 5.0 \x2d - -' FROM part WHERE p_partkey % 3 = 2""")
def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, hard links and symbolic links written as dump lines, with what has to be escaped."""
    part = table(spark, sf_dir, "part")
    third = F.col("p_partkey") % 3
    pick = lambda file, link, sym: F.when(third == 0, file).when(third == 1, link).otherwise(sym)
    none = F.lit(None)
    named = F.concat(F.lit("/a/"), "p_name")
    content = F.concat("p_brand", F.lit("=\n"))
    rows = part.select(
        F.col("p_partkey").alias("line_no"),
        pick(named, F.concat(F.lit("/a/link"), "p_partkey"), F.concat(F.lit("/a/dash"), "p_partkey")).cast("binary").alias("path"),
        pick(F.length(content), none, F.lit(1)).cast("long").alias("size"),
        pick(F.lit(0o100644), none, F.lit(0o120777)).cast("int").alias("mode"),
        F.lit(1).cast("long").alias("nlink"),
        pick(F.col("p_size"), none, F.lit(0)).cast("long").alias("uid"),
        *(F.lit(0).cast("long").alias(x) for x in ("gid", "rdev")),
        pick(F.lit(1000), none, F.lit(5)).cast("long").alias("mtime_sec"),
        F.lit(0).cast("long").alias("mtime_nsec"),
        pick(none, named, F.lit("-")).cast("binary").alias("payload"),
        pick(content, none, none).cast("binary").alias("content"),
        F.lit(None).cast("string").alias("digest"),
        pick(F.create_map(F.lit("user.t=x").cast("binary"), F.col("p_type").cast("binary")), none, none).cast(_BINARY).alias("xattrs"),
        (third == 1).alias("hardlink"),
        F.lit(None).cast("string").alias("error"),
    )
    return rows.select("line_no", dumpfile.lines_of(rows).alias("value"))


_BAD_LINES = {
    "a relative path": "a 0 100644 1 0 0 0 1.0 - - -",
    "dots": "/a/../b 0 100644 1 0 0 0 1.0 - - -",
    "few fields": "/a 0 100644",
    "a number": "/a x 100644 1 0 0 0 1.0 - - -",
    "an odd escape": "/a\\q 0 100644 1 0 0 0 1.0 - - -",
    "a linked folder": "/a 0 @40755 - - - - 0.0 /b - -",
    "a device number": "/a 0 100644 1 0 0 9 1.0 - - -",
    "a socket": "/a 0 140755 1 0 0 0 1.0 - - -",
    "a time": "/a 0 100644 1 0 0 0 1 - - -",
    "content of a folder": "/a 0 40755 1 0 0 0 1.0 - x -",
    "sound": "/a 1 100644 1 0 0 0 1.0 - x - k=v",
}


@query("SELECT p_partkey AS line_no, p_partkey % 11 <> 10 AS refused FROM part")
def dump_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a dump may not have, each kind many times."""
    kinds = F.array(*(F.lit(x) for x in _BAD_LINES.values()))
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.get(kinds, (F.col("p_partkey") % 11).cast("int")).alias("value"))
    return dumpfile.parsed(lines).select("line_no", F.col("error").isNotNull().alias("refused"))


@query("""
WITH g AS (SELECT DISTINCT p_type FROM part) SELECT p_partkey + 100 AS line_no, 'no parent directory' AS error FROM part WHERE p_type = 'PROMO'
UNION ALL SELECT p_partkey + 100, 'no target' FROM part WHERE p_partkey % 10 = 3 AND p_partkey % 20 = 3""")
def dump_tree_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that don't fit together: a folder that is missing, links to what isn't there."""
    part = table(spark, sf_dir, "part")
    link = F.col("p_partkey") % 10 == 3
    target = F.when(F.col("p_partkey") % 20 == 3, F.lit("/none")).otherwise(F.lit("/first"))
    value = F.when(link, F.concat(F.lit("/"), "p_type", F.lit("/k"), "p_partkey", F.lit(" 0 @120000 - - - - 0.0 "), target, F.lit(" - -"))).otherwise(
        F.concat(F.lit("/"), "p_type", F.lit("/k"), "p_partkey", F.lit(" 0 100644 1 0 0 0 1.0 - - -"))
    )
    rows = part.select((F.col("p_partkey") + 100).alias("line_no"), value.alias("value"))
    types = sorted(r.p_type for r in part.select("p_type").distinct().collect())
    head = [
        (0, "/ 0 40755 2 0 0 0 1.0 - - -"),
        (1, "/first 0 100644 1 0 0 0 1.0 - - -"),
        *((2 + k, f"/{t} 0 40755 2 0 0 0 1.0 - - -") for k, t in enumerate(types) if t != "PROMO"),
    ]
    return dumpfile.tree_errors(dumpfile.parsed(rows.unionAll(spark.createDataFrame(head, "line_no long, value string"))))


@query("""
WITH p AS (SELECT p_partkey, '/' || p_type || '/' || replace(p_name, ' ', '/') AS path FROM part)
SELECT p_partkey, path, array_to_string(list_concat(['/'], list_transform(range(1, len(string_split(path, '/')) - 1), lambda i: array_to_string(string_split(path, '/')[1 : i + 1], '/'))), ' ') AS above,
       repeat('../', len(string_split(path, '/')) - 2) || 'x/y' AS relative, p_partkey % 4 <> 0 AS canonical FROM p""")
def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders above a path, the way from it to another, and whether a path is canonical."""
    path = F.concat(F.lit("/"), "p_type", F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")))
    odd = F.when(F.col("p_partkey") % 8 == 0, F.concat(path, F.lit("/../x"))).when(F.col("p_partkey") % 8 == 4, F.concat(path, F.lit("//x"))).otherwise(path)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        path.alias("path"),
        F.array_join(paths.ancestors(path), " ").alias("above"),
        paths.relative_to(F.lit("/x/y"), path).alias("relative"),
        paths.canonical(odd).alias("canonical"),
    )


@query(
    "SELECT event_id, epoch_us(ts) AS us, CAST(((user_id + 4095) // 4096) * 4096 AS BIGINT) AS blocks, CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events"
)
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as microseconds, sizes rounded up to blocks, and dashes that stand for nothing."""
    kind = F.when(F.col("event_type") == "view", "-").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", text.micros(F.col("ts")).alias("us"), text.round_up(F.col("user_id"), 4096).alias("blocks"), text.optional(kind).alias("kind")
    )


@query(f"""
WITH {_TREE}, w AS (SELECT path, 'sound' AS sort FROM t WHERE kind = 'reg' AND size = 5 UNION ALL SELECT path || '/x', 'below a file' FROM t WHERE kind = 'reg' AND size = 6
  UNION ALL SELECT '/usr/' || p_type || '/none', 'gone' FROM part WHERE p_size = 7 UNION ALL SELECT '/none/' || p_partkey, 'gone' FROM part WHERE p_size = 8
  UNION ALL SELECT '/usr/../' || p_partkey, 'odd' FROM part WHERE p_size = 9 UNION ALL SELECT '/usr/' || p_type, 'dir' FROM part WHERE p_size = 10)
SELECT path, CASE WHEN sort = 'sound' THEN 'reg' END AS kind, CASE sort WHEN 'below a file' THEN 'not a directory' WHEN 'gone' THEN 'not found' WHEN 'odd' THEN 'invalid name' WHEN 'dir' THEN 'a directory' END AS error FROM w""")
def path_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular files looked up by path, and why a path leads to none."""
    rows = parts_tree(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    of = lambda frame, path: frame.select(path.alias("path"))
    wanted = of(rows.filter("kind = 'reg' and size = 5"), F.col("path")).unionAll(of(rows.filter("kind = 'reg' and size = 6"), F.concat("path", F.lit("/x"))))
    wanted = wanted.unionAll(of(part.filter("p_size = 7"), F.concat(F.lit("/usr/"), "p_type", F.lit("/none"))))
    wanted = wanted.unionAll(of(part.filter("p_size = 8"), F.concat(F.lit("/none/"), "p_partkey"))).unionAll(
        of(part.filter("p_size = 9"), F.concat(F.lit("/usr/../"), "p_partkey"))
    )
    wanted = wanted.unionAll(of(part.filter("p_size = 10"), F.concat(F.lit("/usr/"), "p_type")))
    return tree.resolved(rows, wanted, tree.REGULAR).select("path", "kind", "error")


@query(f"""
WITH {_TREE}, n AS (SELECT DISTINCT '/usr/' || p_type AS path FROM part WHERE p_type < 'M')
SELECT 'left' AS what, path, kind FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE t.path = n.path OR starts_with(t.path, n.path || '/')) UNION ALL SELECT 'left', path, 'lnk' FROM n
UNION ALL SELECT 'taken', path, kind FROM t WHERE path = '/usr/PROMO' OR starts_with(path, '/usr/PROMO/')""")
def tree_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links put in place of folders with all in them, and a folder taken out."""
    rows = parts_tree(spark, sf_dir).select("path", "kind")
    new = table(spark, sf_dir, "part").filter("p_type < 'M'").select(F.concat(F.lit("/usr/"), "p_type").alias("path"), F.lit("lnk").alias("kind")).distinct()
    taken, _ = tree.popped(rows, "/usr/PROMO")
    return tree.inserted(rows, new).select(F.lit("left").alias("what"), "path", "kind").unionAll(taken.select(F.lit("taken"), "path", "kind"))
