"""One query for each operator family on the driver's tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, paths, text
from ..operators import fold, graph, label, store, tree
from ..sources import archive, dumpfile, erofs, splitstream
from . import formats, refs, registry, texts, trees
from .registry import Query, query, table

__all__ = ["oracle_sql", "queries", "refs", "texts", "trees"]


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as objects: id, size and what they came from."""
    return store.identified(table(spark, sf_dir, "documents"), "text")


@query("""
SELECT sha256(text) AS object_id, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3) AS object_path, count(*) AS copies, min(doc_id) AS first_doc,
       CAST(max(octet_length(encode(text))) AS BIGINT) AS size, CAST((count(*) - 1) * max(octet_length(encode(text))) AS BIGINT) AS saved_bytes
FROM documents GROUP BY 1, 2""")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir).groupBy("object_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.max("size").alias("size"))
    return rows.select(
        "object_id",
        digest.object_path(F.col("object_id")).alias("object_path"),
        "copies",
        "first_doc",
        "size",
        ((F.col("copies") - 1) * F.col("size")).alias("saved_bytes"),
    )


@query(
    "SELECT DISTINCT substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3) AS object_path, 'sha256:' || sha256(text) AS id, sha256(text) AS back FROM documents"
)
def object_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = objects(spark, sf_dir).select("object_id").distinct()
    path = digest.object_path(F.col("object_id"))
    return ids.select(path.alias("object_path"), digest.display_id(F.col("object_id")).alias("id"), digest.from_object_path(path).alias("back"))


@query("""
SELECT CASE WHEN octet_length(encode(p_name)) + octet_length(encode(p_type)) <= 15 THEN 'inline' ELSE 'external' END AS class, count(*) AS n,
       CAST(sum(octet_length(encode(p_name)) + octet_length(encode(p_type))) AS BIGINT) AS bytes FROM part GROUP BY 1
UNION ALL SELECT 'text ' || CASE WHEN octet_length(encode(text)) <= 64 THEN 'inline' ELSE 'external' END, count(*), CAST(sum(octet_length(encode(text))) AS BIGINT) FROM documents GROUP BY 1""")
def inline_external_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat("p_name", "p_type").alias("data"))
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("data"))
    grouped = lambda rows, name: rows.groupBy(name.alias("class")).agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("bytes"))
    return grouped(parts, store.storage_class(F.col("data"), 15)).unionAll(grouped(docs, F.concat(F.lit("text "), store.storage_class(F.col("data")))))


_METHODS = "SELECT source, octet_length(encode(text)) AS size, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS is_new FROM documents"
_STATS = """count(*) FILTER (WHERE is_new) AS new_objects, CAST(coalesce(sum(size) FILTER (WHERE is_new), 0) AS BIGINT) AS new_bytes,
            count(*) FILTER (WHERE NOT is_new) AS present_objects, count(*) AS total_objects"""


@query(f"SELECT source, {_STATS} FROM ({_METHODS}) GROUP BY source")
def import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir).select("doc_id", "source", "object_id", "size")
    return store.import_stats(store.import_methods(rows, "doc_id"), "source")


@query(f"SELECT {_STATS} FROM ({_METHODS})")
def stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merged_stats(import_stats(spark, sf_dir))


@query("""
WITH x AS (SELECT 'lang' AS name, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR) FROM documents),
u AS (SELECT name, value, count(*) AS uses FROM x GROUP BY ALL HAVING count(*) > 1)
SELECT name, value, uses, row_number() OVER (ORDER BY name, value) - 1 AS idx FROM u""")
def xattr_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.col("n_chars").cast("string"))
    pairs = docs.unpivot([], ["lang", "source", "n_chars"], "name", "value")
    return tree.shared_values(pairs, ["name", "value"])


@query(
    "SELECT event_type, first_seq, row_number() OVER (ORDER BY first_seq) - 1 AS idx FROM (SELECT event_type, min(event_id) AS first_seq FROM events GROUP BY 1)"
)
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.dictionary(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, event_type IN ('purchase', 'signup') AS ext FROM events),
s AS (SELECT *, CASE WHEN ext OR coalesce(lag(ext) OVER w, true) THEN 1 ELSE 0 END AS st FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_id) AS first_seq, max(event_id) AS last_seq, max(CASE WHEN ext THEN event_type END) AS object_id,
       CASE WHEN NOT bool_or(ext) THEN string_agg(event_type, '' ORDER BY event_id) END AS inline
FROM r GROUP BY ALL""")
def coalesce_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    external = F.col("event_type").isin("purchase", "signup")
    chunks = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(~external, F.col("event_type").cast("binary")).alias("inline"), F.when(external, F.col("event_type")).alias("object_id")
    )
    rows = store.coalesced(chunks, "user_id", "event_id")
    return rows.withColumn("inline", F.col("inline").cast("string")).withColumn("run", F.col("run").cast("long"))


@query(
    "SELECT conv_id, count(*) AS chunks, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size, sha256(string_agg(text, '' ORDER BY turn)) AS object_id FROM conversations GROUP BY 1"
)
def stream_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    chunks = turns.select(
        "conv_id",
        "turn",
        F.when(F.octet_length("text") <= 64, F.col("text").cast("binary")).alias("inline"),
        digest.content_id(F.col("text")).alias("object_id"),
    )
    large = turns.filter(F.octet_length("text") > 64)
    held = large.select(digest.content_id(F.col("text")).alias("object_id"), F.col("text").cast("binary").alias("data")).dropDuplicates(["object_id"])
    whole = store.reassembled(chunks, held, "conv_id", "turn")
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("chunks"))
    return whole.join(counts, "conv_id").select(
        "conv_id", "chunks", F.octet_length("data").cast("long").alias("size"), digest.content_id(F.col("data")).alias("object_id")
    )


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as directories, orders as their files: (path, kind)."""
    region, nation, customer = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    r = F.concat(F.lit("/"), "r_name")
    n = F.concat(r, F.lit("/"), "n_name")
    named = F.broadcast(nation.join(region, nation["n_regionkey"] == region["r_regionkey"]))
    customers = customer.join(named, customer["c_nationkey"] == named["n_nationkey"])
    rows = spark.range(1).select(F.lit("/").alias("path")).unionAll(region.select(r)).unionAll(named.select(n)).unionAll(
        customers.select(F.concat(n, F.lit("/"), "c_name"))
    )
    return rows.select("path", F.lit("dir").alias("kind"))


_GEO = """SELECT '/' AS path UNION ALL SELECT '/' || r_name FROM region
  UNION ALL SELECT '/' || r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT '/' || r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(f"""
WITH g AS ({_GEO}), p AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM g)
SELECT path, len(parts) AS depth, row_number() OVER (ORDER BY parts) - 1 AS ordinal FROM p""")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.ordered(geography(spark, sf_dir))
    return rows.select("path", F.size(paths.parts(F.col("path"))).cast("long").alias("depth"), "ordinal")


@query(f"""
WITH g AS ({_GEO}), up AS (SELECT CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS path FROM g WHERE path <> '/')
SELECT g.path, 2 + count(up.path) AS nlink FROM g LEFT JOIN up USING (path) GROUP BY 1""")
def dir_nlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.dir_links(geography(spark, sf_dir))


@query("SELECT c_custkey AS leaf_id, c_name, count(o_orderkey) AS nlink FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def leaf_nlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("leaf_id"), "c_name")
    return tree.leaf_links(leaves, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("leaf_id")))


@query("""
WITH x AS (SELECT '/' || r_name AS a, '/' || r_name || '/' || n_name AS b, '/' || r_name || '/' || n_name || '/' || c_name AS c, epoch_us(o_orderdate) // 1000000 AS t
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT coalesce(c, b, a, '/') AS path, CAST(max(t) AS BIGINT) AS newest FROM x GROUP BY ROLLUP (a, b, c)""")
def newest_in_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer, orders = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders"))
    # Orders first shrink to one row for each customer.
    latest = orders.groupBy("o_custkey").agg(F.max(F.floor(text.micros(F.col("o_orderdate")) / 1_000_000)).alias("mtime"))
    named = F.broadcast(nation.join(region, nation["n_regionkey"] == region["r_regionkey"]))
    rows = latest.join(customer, latest["o_custkey"] == customer["c_custkey"]).join(named, customer["c_nationkey"] == named["n_nationkey"])
    files = rows.select(F.concat_ws("/", F.lit(""), "r_name", "n_name", "c_name", F.lit("orders")).alias("path"), F.lit("reg").alias("kind"), "mtime")
    return tree.newest(files)


def layer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes to /user/kind: errors are opaque marks, signups whiteouts of the user's view, the rest are files."""
    user = F.concat(F.lit("/u"), "user_id")
    kind = F.col("event_type")
    path = F.when(kind == "error", F.concat(user, F.lit("/.wh..wh..opq"))).when(kind == "signup", F.concat(user, F.lit("/.wh.view"))).otherwise(
        F.concat(user, F.lit("/"), kind)
    )
    return table(spark, sf_dir, "events").select(
        F.datediff(
            "ts", F.lit("2024-01-01")
        ).alias("layer_idx"), F.col("event_id").alias("entry_idx"), path.alias("path"), F.lit("leaf").alias("item"), F.lit(None).cast("string").alias("target"), "value"
    )


@query("""
WITH e AS (SELECT '/u' || user_id AS d, event_type AS k, value, (datediff('day', TIMESTAMP '2024-01-01', ts), event_id) AS seq FROM events),
put AS (SELECT d, k, max(seq) AS seq, arg_max(value, seq) AS value FROM e WHERE k IN ('view', 'click', 'purchase') GROUP BY 1, 2),
opq AS (SELECT d, max(seq) AS seq FROM e WHERE k = 'error' GROUP BY 1),
wh AS (SELECT d, max(seq) AS seq FROM e WHERE k = 'signup' GROUP BY 1)
SELECT put.d || '/' || k AS path, value FROM put LEFT JOIN opq USING (d) LEFT JOIN wh USING (d)
WHERE (opq.seq IS NULL OR put.seq > opq.seq) AND (k <> 'view' OR wh.seq IS NULL OR put.seq > wh.seq)""")
def layer_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.folded(layer_entries(spark, sf_dir)).select("path", "value")


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys from the region down to the orders."""
    pair = lambda t, a, x, b, y: table(spark, sf_dir, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return pair("nation", "r", "n_regionkey", "n", "n_nationkey").unionAll(pair("customer", "n", "c_nationkey", "c", "c_custkey")).unionAll(
        pair("orders", "c", "o_custkey", "o", "o_orderkey")
    )


_EDGES = """e(src, dst) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
_LIVE = f"{_EDGES}, live(node) AS (SELECT 'r0' UNION SELECT dst FROM live JOIN e ON src = node)"


@query(f"WITH RECURSIVE {_LIVE} SELECT node FROM live")
def gc_live_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(reference_edges(spark, sf_dir), spark.createDataFrame([("r0",)], "node string")).select("node")


@query(f"""
WITH RECURSIVE {_LIVE}, o AS (SELECT 'region' AS category, 'r' || r_regionkey AS node, length(r_name) AS bytes FROM region UNION ALL SELECT 'nation', 'n' || n_nationkey, length(n_name) FROM nation
  UNION ALL SELECT 'customer', 'c' || c_custkey, length(c_name) FROM customer UNION ALL SELECT 'orders', 'o' || o_orderkey, length(o_orderpriority) FROM orders)
SELECT category, count(*) AS objects_removed, CAST(sum(bytes) AS BIGINT) AS objects_bytes FROM o WHERE node NOT IN (SELECT node FROM live) GROUP BY 1""")
def gc_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t, a, key, text_of: table(spark, sf_dir, t).select(
        F.lit(t).alias("category"), F.concat(F.lit(a), key).alias("node"), F.length(text_of).cast("long").alias("bytes")
    )
    every = of("region", "r", "r_regionkey", "r_name").unionAll(
        of("nation", "n", "n_nationkey", "n_name")
    ).unionAll(of("customer", "c", "c_custkey", "c_name")).unionAll(of("orders", "o", "o_orderkey", "o_orderpriority"))
    return graph.sweep(every, gc_live_set(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("objects_removed"), F.sum("bytes").alias("objects_bytes"))


@query("""
SELECT 'document' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, orders, customer = (table(spark, sf_dir, x) for x in ("documents", "labels", "orders", "customer"))
    missing = lambda kind, links, targets, a, b, key: graph.dangling(links, targets, a, b).select(
        F.lit(kind).alias("kind"), F.col(key).alias("id")
    )
    return missing(
        "document", docs.select("doc_id"), labels, "doc_id", "doc_id", "doc_id"
    ).unionAll(missing("order", orders, customer, "o_custkey", "c_custkey", "o_orderkey")).unionAll(missing("customer", customer, orders, "c_custkey", "o_custkey", "c_custkey"))


@query("""
WITH s AS (SELECT n_nationkey, coalesce((SELECT min(s_name) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000), NULL) AS a,
  (SELECT min(c_name) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS b, (SELECT min(c_name) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation)
SELECT n_nationkey, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 END AS store_rank, coalesce(a, b, c) AS holder FROM s""")
def first_store_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    held = lambda rows, nation, name: rows.groupBy(F.col(nation).alias("n_nationkey")).agg(F.min(name).alias("holder"))
    stores = [
        held(supplier.filter("s_acctbal > 9000"), "s_nationkey", "s_name"),
        held(customer.filter("c_acctbal > 9900"), "c_nationkey", "c_name"),
        held(customer, "c_nationkey", "c_name"),
    ]
    return store.first_store_wins(table(spark, sf_dir, "nation").select("n_nationkey"), stores, "n_nationkey", "holder")


_RULES = ("/.* any_t", "/PROMO(/.*)? promo_t", r"/.*/small\s.* small_t", "/[A-M].*/.*ring -- ring_t", "/ECONOMY/.*bolt <<none>>", "/LARGE/old.* -d old_t")
_CASES = [
    (r"/.*.", "any_t"),
    (r"/PROMO(/.*)?.", "promo_t"),
    (r"/.*/small .*.", "small_t"),
    (r"/[A-M].*/.*ring-", "ring_t"),
    (r"/ECONOMY/.*bolt.", "<<none>>"),
    (r"/LARGE/old.*d", "old_t"),
]


@query("""
WITH r(idx, pattern, context) AS (VALUES """ + ", ".join(f"({k}, '{p}', '{c}')" for k, (p, c) in enumerate(_CASES)) + """),
m AS (SELECT p_partkey, arg_max(context, idx) AS context FROM part JOIN r ON regexp_full_match('/' || p_type || '/' || p_name || '-', pattern) GROUP BY 1)
SELECT p_partkey, nullif(context, '<<none>>') AS label FROM part LEFT JOIN m USING (p_partkey)""")
def regex_label_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), "p_type", F.lit("/"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", label.label(path, F.lit("reg"), label.rules(list(_RULES))).alias("label"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages), q AS (SELECT page_id, path, string_split(trim(path, '/'), '/') AS s FROM p)
SELECT page_id, CASE WHEN s[1] = 'en' THEN '/usr/english' || CASE WHEN len(s) > 1 THEN '/' || array_to_string(s[2:], '/') ELSE '' END
  WHEN s[1] = 'de' THEN '/deutsch' || CASE WHEN len(s) > 1 THEN '/' || array_to_string(s[2:], '/') ELSE '' END
  ELSE CASE WHEN trim(path, '/') = '' THEN '/' ELSE '/' || array_to_string(s, '/') END END AS path FROM q""")
def alias_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"\A[a-z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", label.aliased(path, {"/en": "/usr/english", "/de": "/deutsch"}).alias("path"))


@query("SELECT page_id, replace(replace(url, '%', '%25'), '/', '%2F') AS encoded, url AS decoded, NOT starts_with(url, '@') AS valid FROM pages")
def tag_encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = text.encode_tag(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", encoded.alias("encoded"), text.decode_tag(encoded).alias("decoded"), text.valid_ref_name(F.col("url")).alias("valid")
    )


@query("""
WITH p AS (SELECT page_id, '/' || trim(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS path FROM pages)
SELECT page_id, path, len(string_split(path, '/')) - 1 AS depth, regexp_extract(path, '([^/]*)$', 1) AS name,
       CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent FROM p""")
def split_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", paths.absolute(F.regexp_extract("url", r"\A[a-z]+://([^?#]*)", 1)).alias("path"))
    return rows.select(
        "page_id",
        "path",
        F.size(paths.parts(F.col("path"))).cast("long").alias("depth"),
        paths.name(F.col("path")).alias("name"),
        paths.parent(F.col("path")).alias("parent"),
    )


@query(
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS other FROM events"
)
def key_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "map<string, string>")
    return table(spark, sf_dir, "events").select(
        "event_id", text.first_of(props, ["absent", "k"]).cast("long").alias("k"), F.coalesce(props["missing"], F.lit("none")).alias("other")
    )


@query(r"""
WITH d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents),
a AS (SELECT doc_id, n, list_transform(range(0, (n + 4095) // 4096), lambda i: sha256(b[i * 4096 + 1 : least(n, (i + 1) * 4096)] || repeat('\x00'::BLOB, greatest(0, (i + 1) * 4096 - n)))) AS one FROM d),
e AS (SELECT doc_id, n, CASE WHEN n = 0 THEN repeat('00', 32) WHEN len(one) = 1 THEN one[1]
      ELSE sha256(unhex(array_to_string(one, '')) || repeat('\x00'::BLOB, 4096 - 32 * len(one))) END AS root FROM a)
SELECT doc_id, sha256(unhex('01010c0000000000' || array_to_string(list_transform(range(7, -1, -1), lambda k: substr(lpad(lower(hex(n)), 16, '0'), CAST(2 * k + 1 AS INTEGER), 2)), '') || root || repeat('00', 32 + 176))) AS digest FROM e""")
def verity_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle digests of all documents, by expressions alone."""
    return table(spark, sf_dir, "documents").select("doc_id", digest.verity(F.col("text").cast("binary")).alias("digest"))


@query(
    "SELECT doc_id, sha256(text) AS object_id FROM documents d WHERE doc_id = (SELECT min(doc_id) FROM documents x WHERE x.text = d.text) AND NOT EXISTS (SELECT 1 FROM documents y JOIN labels USING (doc_id) WHERE y.text = d.text)"
)
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a store that holds the labelled ones: the first row of each object that the store lacks."""
    docs = objects(spark, sf_dir).select("doc_id", "object_id")
    held = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("object_id").distinct()
    first = docs.groupBy("object_id").agg(F.min("doc_id").alias("doc_id"))
    return store.absent(first, held).select("doc_id", "object_id")


@query(
    "SELECT CAST(conv_id AS VARCHAR) AS stream_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size, sha256(string_agg(text, '' ORDER BY turn)) AS content FROM conversations GROUP BY 1"
)
def stream_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as stream files, long turns as objects; decoded and put together again."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").cast("binary").alias("data")
    )
    long = F.octet_length("data") > 64
    chunks = turns.select(
        "stream_id",
        "seq",
        F.when(~long, F.col("data")).alias("inline"),
        F.when(long, F.sha2("data", 256)).alias("object_id"),
        F.octet_length("data").cast("long").alias("size"),
    )
    files = splitstream.encoded(chunks)
    held = turns.filter(long).select(F.sha2("data", 256).alias("object_id"), "data").dropDuplicates(["object_id"])
    back = store.reassembled(splitstream.chunk_rows(files.withColumnRenamed("stream_id", "name")), held)
    sizes = splitstream.headers(files).select("stream_id", F.col("total_size").alias("size"))
    return back.join(sizes.hint("merge"), "stream_id").select("stream_id", "size", F.sha2("data", 256).alias("content"))


@query(f"""
WITH f AS ({formats.FILES}) SELECT owner AS archive, row_number() OVER (PARTITION BY owner ORDER BY name) - 1 AS entry_idx, '/orders/' || name AS path, 'reg' AS kind, length(body) AS size,
       CASE WHEN length(body) <= 64 THEN body END AS inline FROM f""")
def archive_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tar archive of each customer's orders, and its entries read back."""
    tars = formats.archives(spark, sf_dir)
    return archive.entry_rows(tars).select(
        "archive", "entry_idx", F.col("path").cast("string").alias("path"), "kind", "size", F.col("inline").cast("string").alias("inline")
    )


@query(f"""
WITH f AS ({formats.FILES}) SELECT owner AS image_id, '/' || name AS path, 'reg' AS kind, CASE WHEN length(body) > 64 THEN sha256(body) END AS object_id, length(body) AS size FROM f
UNION ALL SELECT DISTINCT owner, '/', 'dir', NULL, 0 FROM f""")
def image_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file system image of each customer's orders, encoded and decoded."""
    back = erofs.entry_rows(formats.images(spark, sf_dir))
    return back.select(
        "image_id",
        F.col("path").cast("string").alias("path"),
        "kind",
        "object_id",
        F.when(F.col("inline").isNotNull(), F.octet_length("inline").cast("long")).otherwise(F.col("size")).alias("size"),
    )


@query("SELECT p_partkey AS line_no, '/' || p_type || '/' || p_name AS path, p_size AS uid, p_brand || '=x' AS content, 33188 AS mode FROM part")
def dump_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dump lines, parsed."""
    part = table(spark, sf_dir, "part")
    path = F.replace(F.concat(F.lit("/"), "p_type", F.lit("/"), "p_name"), F.lit(" "), F.lit("\\x20"))
    lines = part.select(
        F.col("p_partkey").alias("line_no"),
        F.concat_ws(" ", path, F.lit("0 100644 1"), "p_size", F.lit("0 0 1000.0 -"), F.concat("p_brand", F.lit("=x")), F.lit("-")).alias("value"),
    )
    return dumpfile.parsed(lines).filter("error is null").select(
        "line_no", F.col("path").cast("string").alias("path"), F.col("uid").cast("int").alias("uid"), F.col("content").cast("string").alias("content"), "mode"
    )


