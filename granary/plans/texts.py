"""Queries over ids, names, command lines, boot entries and stored formats, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, text
from ..operators import boot, store
from ..sources import archive, erofs, splitstream
from . import formats
from .registry import query, table


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE h END AS back, CASE doc_id % 3 WHEN 0 THEN 'sha256' WHEN 1 THEN 'sha512' END AS hash,
       CASE WHEN doc_id % 2 = 0 THEN 'sha256' END AS by_length FROM d""")
def hex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read from text, algorithms from their names, and from the length of an object's name."""
    h = digest.content_id(F.col("text"))
    written = F.when(F.col("doc_id") % 4 == 1, F.substring(h, 2, 100)).when(F.col("doc_id") % 4 == 2, F.upper(h)).otherwise(h)
    name = F.when(F.col("doc_id") % 3 == 0, "fsverity-sha256-12").when(F.col("doc_id") % 3 == 1, "fsverity-sha512-12").otherwise("fsverity-sha256-13")
    file = F.when(F.col("doc_id") % 2 == 0, F.substring(h, 3, 62)).otherwise(F.substring(h, 4, 60))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lower(F.hex(digest.from_hex(written))).alias("back"),
        digest.algorithm_name(name)["hash"].alias("hash"),
        digest.algorithm_of_name(file).alias("by_length"),
    )


@query("""
WITH d AS (SELECT o_orderkey, 'sha256:' || sha256(CAST(o_orderkey AS VARCHAR)) AS d FROM orders)
SELECT o_orderkey, 'oci-manifest-' || d AS manifest, 'oci-config-' || d AS config, 'oci-layer-' || d AS layer, 'oci-blob-' || d AS blob, o_orderkey % 3 <> 2 AS is_tar,
       CASE WHEN o_orderkey % 2 = 0 THEN 'host/app:' || o_orderkey END AS stored FROM d""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of streams by their kind, media types of archives, and references of container storage."""
    d = F.concat(F.lit("sha256:"), digest.content_id(F.col("o_orderkey").cast("string")))
    key = F.col("o_orderkey")
    media = F.when(key % 3 == 0, "application/vnd.oci.image.layer.v1.tar+gzip").when(
        key % 3 == 1, "application/vnd.oci.image.layer.v1.tar"
    ).otherwise("application/json")
    reference = F.concat(F.when(key % 2 == 0, "containers-storage:").otherwise("docker://"), F.lit("host/app:"), key.cast("string"))
    kinds = [text.identifier(x, d).alias(x) for x in ("manifest", "config", "layer", "blob")]
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", *kinds, text.is_tar_media_type(media).alias("is_tar"), text.storage_reference(reference).alias("stored")
    )


@query(r"""
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents)
SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 4 END AS BIGINT) AS n, '/dev/x y"' AS root, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN h END AS digest, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN doc_id % 2 = 0 END AS insecure,
       'img=' || CASE WHEN doc_id % 2 = 0 THEN '?' ELSE '' END || h AS argument, 'ro root="/dev/x y"' || CASE WHEN doc_id % 5 <> 0 THEN ' img=new' ELSE '' END || ' quiet' || CASE WHEN doc_id % 5 = 0 THEN ' img=new' ELSE '' END AS replaced FROM d""".replace("'/dev/x y\"' AS root", "'\"/dev/x y\"' AS root"))
def cmdline_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel command lines with quoted white space: their arguments, an argument's value, the image they name, and one argument replaced."""
    h = digest.content_id(F.col("text"))
    insecure = F.col("doc_id") % 2 == 0
    argument = F.when(F.col("doc_id") % 7 == 0, F.lit("img=zz")).otherwise(text.image_argument(h, insecure, "img="))
    line = F.concat(F.lit('ro root="/dev/x y" '), F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(argument, F.lit("  "))), F.lit("quiet"))
    rows = table(spark, sf_dir, "documents").select("doc_id", h.alias("h"), line.alias("line"), text.image_argument(h, insecure, "img=").alias("argument"))
    address = text.image_address(F.col("line"), "img=")
    return rows.select(
        "doc_id",
        F.size(text.split_cmdline(F.col("line"))).cast("long").alias("n"),
        text.cmdline_value(F.col("line"), "root=").alias("root"),
        address["digest"].alias("digest"),
        address["insecure"].alias("insecure"),
        "argument",
        boot.with_argument(F.col("line"), "img=new").alias("replaced"),
    )


@query(
    r"""SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens, nullif(regexp_extract(text, '(?:^|[\x20\x09-\x0D])(th[^\x20\x09-\x0D]*)', 1), '') AS value FROM documents"""
)
def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.split_words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("tokens"), text.first_with_prefix(tokens, "th").alias("value"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Linux ''for'' "' || c_name || '"' WHEN c_custkey % 4 = 1 THEN c_name ELSE 'id' || c_custkey END AS pretty_name,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS version,
       CASE WHEN c_custkey % 4 = 0 THEN 'Linux ''for'' "' || c_name || '"' WHEN c_custkey % 4 = 1 THEN c_name ELSE 'id' || c_custkey END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ' || c_nationkey END AS label,
       c_mktsegment AS segment, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'a b' END AS dequoted FROM customer""")
def os_release_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and versions from texts of shell assignments, with quotes, comments, keys that come twice and values that don't end."""
    key = F.col("c_custkey")
    name = F.when(
        key % 4 == 0, F.concat(F.lit('PRETTY_NAME="Linux \'for\' \\"'), "c_name", F.lit('\\""'))
    ).when(key % 4 == 1, F.concat(F.lit("PRETTY_NAME='"), "c_name", F.lit("'"))).otherwise(F.lit('PRETTY_NAME="no end'))
    version = F.when(key % 3 == 0, F.lit("# VERSION_ID=9")).otherwise(F.concat(F.lit("VERSION_ID=1\nVERSION_ID="), "c_nationkey"))
    content = F.concat_ws("\n", F.lit("# names"), name, version, F.concat(F.lit("ID=id"), key.cast("string")), F.concat(F.lit("SEGMENT= "), "c_mktsegment"))
    facts = boot.os_release(content)
    quoted = F.when(key % 4 == 0, F.lit("a' 'b")).when(key % 4 == 1, F.lit('"a b"')).when(key % 4 == 2, F.lit("a\\ b")).otherwise(F.lit("'a b"))
    return table(spark, sf_dir, "customer").select(
        key,
        facts["pretty_name"].alias("pretty_name"),
        facts["version"].alias("version"),
        facts["label"].alias("label"),
        text.first_of(text.key_values(content), ["NONE", "SEGMENT"]).alias("segment"),
        boot.dequoted(quoted).alias("dequoted"),
    )


def boot_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tree of boot files: text entries, unified images with add-ons, and kernels with and without an initramfs."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    key = F.col("p_partkey").cast("string")
    of = lambda rows, path, content: rows.select(path.alias("path"), F.lit("reg").alias("kind"), content.cast("binary").alias("content"))
    entry = F.concat(F.lit("title "), "p_name", F.lit("\n# no\nlinux /v"), key, F.lit("\ninitrd /i1\ninitrd /boot/i2\noptions "), "p_type", F.lit("\n"))
    empty = F.lit("")
    texts = of(part.filter("p_size = 1"), F.concat(F.lit("/boot/loader/entries/e"), key, F.lit(".conf")), entry)
    found = of(part.filter("p_size = 1 and p_partkey % 2 = 0"), F.concat(F.lit("/boot/v"), key), F.lit("kernel"))
    unified = of(part.filter("p_size = 2"), F.concat(F.lit("/boot/EFI/Linux/u"), key, F.lit(".efi")), empty)
    addons = of(part.filter("p_size = 2 and p_partkey % 2 = 0"), F.concat(F.lit("/boot/EFI/Linux/u"), key, F.lit(".efi.extra.d/a.efi")), empty)
    kernels = of(part.filter("p_size = 3"), F.concat(F.lit("/usr/lib/modules/6."), key, F.lit("/vmlinuz")), empty)
    initramfs = of(part.filter("p_size = 3 and p_partkey % 2 = 1"), F.concat(F.lit("/usr/lib/modules/6."), key, F.lit("/initramfs.img")), empty)
    release = spark.createDataFrame(
        [("/usr/lib/os-release", "reg", bytearray(b'PRETTY_NAME="The OS"\nVERSION_ID=4\n'))], "path string, kind string, content binary"
    )
    return texts.unionAll(found).unionAll(unified).unionAll(addons).unionAll(kernels).unionAll(initramfs).unionAll(release)


@query("""
SELECT 1 AS entry_kind, 'e' || p_partkey AS name FROM part WHERE p_size = 1 UNION ALL SELECT 2, '/boot/EFI/Linux/u' || p_partkey || '.efi' FROM part WHERE p_size = 2
UNION ALL SELECT 2, '/boot/EFI/Linux/u' || p_partkey || '.efi.extra.d/a.efi' FROM part WHERE p_size = 2 AND p_partkey % 2 = 0 UNION ALL SELECT 3, '6.' || p_partkey FROM part WHERE p_size = 3""")
def boot_entry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boot entries of a tree: text entries, unified images, kernels."""
    return boot.resources(boot_tree(spark, sf_dir))


@query("""
WITH e AS (SELECT * FROM part WHERE p_size = 1)
SELECT 'title' AS what, 'e' || p_partkey AS entry, p_name AS value FROM e UNION ALL SELECT 'initrd 0', 'e' || p_partkey, '/i1' FROM e UNION ALL SELECT 'initrd 1', 'e' || p_partkey, '/boot/i2' FROM e
UNION ALL SELECT 'lines', 'e' || p_partkey, '5' FROM e UNION ALL SELECT 'file /boot/v' || p_partkey, 'e' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'reg' END FROM e
UNION ALL SELECT 'file /boot/i1', 'e' || p_partkey, NULL FROM e UNION ALL SELECT 'file /boot/i2', 'e' || p_partkey, NULL FROM e
UNION ALL SELECT 'moved', 'e' || p_partkey, '/sub/e/v' || p_partkey FROM e UNION ALL SELECT 'addon', 'u' || p_partkey, 'true' FROM part WHERE p_size = 2 AND p_partkey % 2 = 0
UNION ALL SELECT 'renamed', 'u' || p_partkey, '/boot/EFI/Linux/new.efi' FROM part WHERE p_size = 2
UNION ALL SELECT 'text', '6.' || p_partkey, 'title The OS 4|version 6.' || p_partkey || '|linux /6.' || p_partkey || '/vmlinuz|initrd /6.' || p_partkey || '/initramfs.img|options quiet|' FROM part WHERE p_size = 3 AND p_partkey % 2 = 1""")
def boot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What text entries say and which of their files are there, paths moved and renamed, and kernels written as text entries."""
    found = boot_tree(spark, sf_dir)
    entries = boot.text_entries(found)
    said = found.filter(F.col("path").endswith(".conf")).select(
        F.regexp_extract("path", r"(e\d+)\.conf", 1).alias("entry"), F.col("content").cast("string").alias("c")
    )
    title = said.select(F.lit("title").alias("what"), "entry", F.get(text.ble_values(F.col("c"), "title"), 0).alias("value"))
    initrd = said.select("entry", F.posexplode(text.ble_values(F.col("c"), "initrd")).alias("n", "value")).select(
        F.concat(F.lit("initrd "), F.col("n").cast("string")), "entry", "value"
    )
    lines = entries.groupBy("entry_id").agg(F.count("*").cast("string").alias("n")).select(F.lit("lines"), "entry_id", "n")
    files = boot.entry_files(entries, found).select(F.concat(F.lit("file "), "path"), "entry_id", "kind")
    moved = entries.filter("key = 'linux'").select(F.lit("moved"), "entry_id", boot.relocated(F.col("value"), "e", "sub"))
    unified = boot.unified_images(found)
    name = F.regexp_extract("path", r"(u\d+)\.efi", 1)
    addons = unified.filter("is_addon").select(F.lit("addon"), name, F.col("is_addon").cast("string"))
    renamed = unified.filter("not is_addon").select(F.lit("renamed"), name, boot.renamed(F.col("path"), "new"))
    kernels = boot.kernel_entries(boot.kernels(found), options="quiet").select(F.lit("text"), "entry_id", F.replace(F.col("text"), F.lit("\n"), F.lit("|")))
    return title.unionAll(initrd).unionAll(lines).unionAll(files).unionAll(moved).unionAll(addons).unionAll(renamed).unionAll(kernels)


@query("""
SELECT c_custkey, 'Unified ' || c_custkey AS label, CASE WHEN c_custkey % 2 = 0 THEN 'quiet img=' || sha256(c_name) END AS cmdline, c_custkey % 2 = 0 AND c_custkey < 10 AS writable FROM customer WHERE c_custkey < 200""")
def unified_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of portable executables: the system's name, the command line, and whether that names a given image."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").filter("c_custkey < 200").withColumn("name", F.when(key < 10, F.col("c_name")).otherwise(F.lit("other")))
    line = F.when(key % 2 == 0, F.concat(F.lit("quiet img="), digest.content_id(F.col("c_name"))))
    images = rows.select(key, "c_name", formats.executable(F.concat(F.lit('PRETTY_NAME="Unified '), key.cast("string"), F.lit('"')), line).alias("content"))
    few = rows.filter("c_custkey < 10").select(digest.content_id(F.col("c_name")).alias("id")).collect()
    fits = None
    for r in few:
        one = boot.writable(images, r.id, "img=").select("c_custkey", F.lit(True).alias("writable"))
        fits = one if fits is None else fits.unionAll(one)
    section = lambda name: boot.section_text(F.col("content"), F.lit(name))
    told = images.select("c_custkey", boot.os_release(section(".osrel"))["label"].alias("label"), section(".cmdline").alias("cmdline"))
    return told.join(fits, "c_custkey", "left").withColumn("writable", F.coalesce("writable", F.lit(False)))


# Formats, over the customers' orders as small files.


@query(f"""
WITH f AS ({formats.FILES}), b AS (SELECT owner, sha256(body) AS h FROM f WHERE length(body) > 64)
SELECT 'chunks' AS what, owner, CAST(2 * count(*) + 1 AS VARCHAR) AS value FROM b GROUP BY owner UNION ALL SELECT 'chunks', owner, '1' FROM f WHERE owner NOT IN (SELECT owner FROM b) GROUP BY owner
UNION ALL SELECT 'objects', owner, CAST(count(DISTINCT h) AS VARCHAR) FROM b GROUP BY owner UNION ALL SELECT 'whole', owner, 'true' FROM f GROUP BY owner""")
def archive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives split into inline bytes and objects, written as stream files under the longer digest, read back, and put together again byte for
    byte."""
    tars = formats.archives(spark, sf_dir)
    rows = archive.split_rows(tars, algorithm="sha512")
    counts = rows.groupBy("stream_id").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("objects"))
    files = splitstream.encoded(rows, algorithm="sha512").withColumnRenamed("stream_id", "name")
    held = rows.filter("kind = 'external'").select("object_id", "data").dropDuplicates(["object_id"])
    back = store.reassembled(splitstream.chunk_rows(files), held)
    # Whole archives on both sides: neither may be broadcast through the driver.
    same = back.join(tars.withColumnRenamed("path", "stream_id").hint("merge"), "stream_id").select("stream_id", (F.col("data") == F.col("content")).alias("same"))
    of = lambda what, found, value: found.select(
        F.lit(what).alias("what"), F.col("stream_id").alias("owner"), F.col(value).cast("string").alias("value")
    )
    return of("chunks", counts, "n").unionAll(of("objects", counts.filter("objects > 0"), "objects")).unionAll(of("whole", same, "same"))


@query(f"""
WITH f AS ({formats.FILES}), k AS (SELECT DISTINCT owner FROM f)
SELECT owner AS name, CASE CAST(owner AS BIGINT) % 4 WHEN 1 THEN 'cut' WHEN 2 THEN 'magic' WHEN 3 THEN 'size' END AS damage FROM k WHERE CAST(owner AS BIGINT) % 4 <> 0""")
def stream_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream files that were cut, lost their magic value, or have another size than their table says."""
    files = splitstream.encoded(archive.split_rows(formats.archives(spark, sf_dir))).withColumnRenamed("stream_id", "name")
    sized = splitstream.headers(files).select("name", "content", "total_size")
    n = F.col("name").cast("long") % 4
    body = F.when(n == 1, F.substring("content", F.lit(1), F.octet_length("content") - 9)).when(
        n == 2, F.concat(F.lit("x").cast("binary"), F.substring("content", 2, 1 << 30))
    ).otherwise(F.col("content"))
    broken = sized.select("name", body.alias("content"), F.when(n == 3, F.col("total_size") + 1).otherwise(F.col("total_size")).alias("total_size"))
    kind = F.when(n == 1, "cut").when(n == 2, "magic").otherwise("size")
    return splitstream.problems(broken).select("name", kind.alias("damage"))


@query(f"""
WITH f AS ({formats.FILES}) SELECT DISTINCT owner AS image_id, CASE WHEN CAST(owner AS BIGINT) % 5 = 0 THEN 'damaged' ELSE sha256(body) END AS object_id FROM f WHERE length(body) > 64 OR CAST(owner AS BIGINT) % 5 = 0""")
def objects_for_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects that images name, each once; an image that can't be read is one error and hides none of the others."""
    images = formats.images(spark, sf_dir)
    cut = images.withColumn("content", F.when(F.col("image_id").cast("long") % 5 == 0, F.substring("content", 1, 1500)).otherwise(F.col("content")))
    return erofs.image_objects(cut).unionAll(erofs.problems(cut).select("image_id", F.lit("damaged")))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE lower(hex(encode('x'))) || 'ff' END AS shown FROM orders""")
def utf8_or_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as text where they are one, else as digits."""
    data = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority").cast("binary")).otherwise(F.unhex(F.lit("78ff")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.utf8_or_hex(data).alias("shown"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS stream_id, CAST(count(*) AS BIGINT) AS chunks, CAST(count(*) FILTER (WHERE octet_length(encode(text)) > 64) AS BIGINT) AS external FROM conversations GROUP BY 1""")
def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of chunks, bytes within or numbers of files, written and read back."""
    return formats.chunk_streams(table(spark, sf_dir, "conversations"))
