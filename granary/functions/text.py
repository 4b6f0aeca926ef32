"""Names, key-value texts and command lines as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_tag(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def decode_tag(encoded: Column) -> Column:
    """One pass from the left; escapes other than %25 and %2F stay as they are."""
    # What stands between two escapes is a piece; a regular expression finds escapes from the left, as one pass does.
    marked = F.regexp_replace(encoded, "%(25|2F)", "\x00$1\x00")
    pieces = F.transform(F.split(marked, "\x00"), lambda x, i: F.when(i % 2 == 0, x).when(x == "25", "%").otherwise("/"))
    return F.array_join(pieces, "")


def valid_ref_name(name: Column) -> Column:
    return ~name.startswith("@")


def identifier(kind: str, digest: Column) -> Column:
    """kind: manifest, config, layer or blob."""
    return F.concat(F.lit({"manifest": "oci-manifest-", "config": "oci-config-", "layer": "oci-layer-", "blob": "oci-blob-"}[kind]), digest)


def optional(field: Column) -> Column:
    """A lone dash is null."""
    return F.nullif(field, F.lit("-"))


def round_up(n: Column, to: int) -> Column:
    return F.floor((n + to - 1) / to).cast("long") * to


def octal(field: Column) -> Column:
    return F.conv(field, 8, 10).cast("long")


def split_words(text: Column) -> Column:
    """Words between white space of one byte."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def first_with_prefix(tokens: Column, prefix: str) -> Column:
    return F.get(F.filter(tokens, lambda x: x.startswith(prefix)), 0)


def first_of(values: Column, keys: list[str]) -> Column:
    """The value of the first key that a map has."""
    return F.coalesce(*(values[k] for k in keys))


def split_cmdline(cmdline: Column) -> Column:
    """Arguments between white space; double quotes keep white space inside, and one without an end runs to the end."""
    return F.regexp_extract_all(cmdline, F.lit(r'(?:[^\s"]|"[^"]*(?:"|\z))+'), F.lit(0))


def cmdline_value(cmdline: Column, prefix: str) -> Column:
    """What follows the prefix in the first argument that has it."""
    hit = first_with_prefix(split_cmdline(cmdline), prefix)
    return F.substring(hit, len(prefix) + 1, 1 << 20)


def image_address(cmdline: Column, prefix: str) -> Column:
    """(digest, insecure) of the image named by a command line: 128 or 64 hex digits, after a question mark if it may be
    unverified; null where there is none that fits."""
    value = cmdline_value(cmdline, prefix)
    hex_id = F.regexp_extract(value, r"\A\??([0-9a-f]{128}|[0-9a-f]{64})\z", 1)
    return F.when(hex_id != "", F.struct(hex_id.alias("digest"), value.startswith("?").alias("insecure")))


def image_argument(digest: Column, insecure: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.when(insecure, F.lit("?")).otherwise(F.lit("")), digest)


def key_values(content: Column) -> Column:
    """KEY=value lines as a map; comments and lines without a key don't count, and the last of a key wins."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"\A[^#=][^=]*=") & ~x.startswith("#"))
    pairs = F.transform(
        lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_replace(x, r"\A[^=]*=", "")).alias("value"))
    )
    # The last of a key: pairs from the end, first come first kept.
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def ble_values(content: Column, key: str) -> Column:
    """All values of a key in a boot entry's text, in order."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(rf"\A{key}\s"))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, rf"\A{key}\s+", "")))


def utf8_or_hex(data: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.lower(F.hex(data)))


#: Media types of layers that are archives.
TAR_MEDIA_TYPES = (
    "application/vnd.oci.image.layer.v1.tar",
    "application/vnd.oci.image.layer.v1.tar+gzip",
    "application/vnd.oci.image.layer.v1.tar+zstd",
    "application/vnd.oci.image.layer.nondistributable.v1.tar",
    "application/vnd.oci.image.layer.nondistributable.v1.tar+gzip",
    "application/vnd.oci.image.layer.nondistributable.v1.tar+zstd",
)


def is_tar_media_type(media_type: Column) -> Column:
    return media_type.isin(*TAR_MEDIA_TYPES)


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time stamp without time zone, whatever the session's zone."""
    since = (time - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second")
    return (since.cast("decimal(20, 6)") * 1_000_000).cast("long")


def storage_reference(reference: Column, transport: str = "containers-storage:") -> Column:
    """The reference without the name of its transport; null where it has another."""
    return F.when(reference.startswith(transport), F.substring(reference, len(transport) + 1, 1 << 20))
