"""Boot entries of a tree: text entries, unified images and kernels, in that order.

Trees are rows (path, kind, content); content is the text or bytes of small files, or null.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text

ENTRIES, UKI_ROOTS, MODULES = "/boot/loader/entries", ("/boot/EFI/Linux", "/usr/lib/modules"), "/usr/lib/modules"


def dequote(value: str) -> str | None:
    """A shell-quoted value's text; null where a quote or an escape has no end."""
    out, at, quote = [], 0, ""
    while at < len(value):
        c = value[at]
        at += 1
        if quote == "'":
            if c == "'":
                quote = ""
            else:
                out.append(c)
        elif c == "\\":
            if at == len(value):
                return None
            if quote == '"' and value[at] not in '"\\$`':
                out.append("\\")
            out.append(value[at])
            at += 1
        elif c == quote:
            quote = ""
        elif not quote and c in "'\"":
            quote = c
        else:
            out.append(c)
    return None if quote else "".join(out)


dequoted = F.udf(dequote, T.StringType(), useArrow=False)


def release_fields(content: str | None) -> tuple[str | None, str | None, str | None]:
    """pretty name, version and label of an os-release file's text; of a key that comes twice the last counts."""
    values = dict(x.split("=", 1) for x in (content or "").split("\n") if "=" in x and x[:1] not in ("#", "="))
    pick = lambda *keys: next((v for k in keys if k in values and (v := dequote(values[k])) is not None), None)
    name, version = pick("PRETTY_NAME", "NAME", "ID"), pick("VERSION_ID", "VERSION")
    return name, version, None if name is None else f"{name} {version}" if version else name


os_release = F.udf(release_fields, T.StructType([T.StructField(x, T.StringType()) for x in ("pretty_name", "version", "label")]), useArrow=False)


def text_entries(tree: DataFrame) -> DataFrame:
    """(entry_id, key, position, value) of /boot/loader/entries/*.conf: every line of a key and a value."""
    mine = tree.filter((paths.parent(F.col("path")) == ENTRIES) & F.col("path").endswith(".conf") & (F.col("kind") == "reg"))
    lines = mine.select(
        F.regexp_replace(paths.name(F.col("path")), r"\.conf\z", "").alias("entry_id"),
        F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("position", "line"),
    )
    pair = lines.withColumns({"key": F.regexp_extract("line", r"\A([^\s#]\S*)\s+", 1), "value": F.trim(F.regexp_replace("line", r"\A\S+\s+", ""))})
    return pair.filter("key <> ''").select("entry_id", "key", "position", "value")


def entry_files(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """Text entries' linux, initrd and efi files with what the tree has at their path, null where it has none."""
    wanted = entries.filter(F.col("key").isin("linux", "initrd", "efi")).select(
        "entry_id", "key", F.when(F.col("value").startswith("/boot/"), F.col("value")).otherwise(F.concat(F.lit("/boot"), "value")).alias("path")
    )
    return wanted.join(tree, "path", "left")


def unified_images(tree: DataFrame) -> DataFrame:
    """(path, kernel_version, is_addon): .efi files under /boot/EFI/Linux, and under each kernel's folder; those deeper than the folder itself
    are add-ons."""
    path = F.col("path")
    efi = tree.filter((F.col("kind") == "reg") & path.endswith(".efi"))
    esp = efi.filter(path.startswith(UKI_ROOTS[0] + "/")).select(
        "path", F.lit(None).cast("string").alias("kernel_version"), (F.size(paths.parts(path)) > 4).alias("is_addon")
    )
    kernels = efi.filter(path.startswith(MODULES + "/") & (F.size(paths.parts(path)) > 4))
    return esp.unionAll(kernels.select("path", F.get(paths.parts(path), 3).alias("kernel_version"), (F.size(paths.parts(path)) > 5).alias("is_addon")))


def kernels(tree: DataFrame) -> DataFrame:
    """(kernel_version, vmlinuz, initramfs, os_release): the kernels under /usr/lib/modules and, where there are, their initramfs and the tree's os-release."""
    path = F.col("path")
    files = tree.filter(path.startswith(MODULES + "/") & (F.size(paths.parts(path)) == 5) & (F.col("kind") == "reg")).select(
        F.get(paths.parts(path), 3).alias("kernel_version"), paths.name(path).alias("name"), "path"
    )
    have = lambda name, column: files.filter(F.col("name") == name).select("kernel_version", F.col("path").alias(column))
    release = tree.filter(path == "/usr/lib/os-release").agg(F.first(F.col("content").cast("string"))).scalar()
    return have("vmlinuz", "vmlinuz").join(have("initramfs.img", "initramfs"), "kernel_version", "left").withColumn("os_release", release)


def resources(tree: DataFrame) -> DataFrame:
    """(entry_kind, name): all boot entries, text entries first, then unified images, then kernels."""
    one = text_entries(tree).select("entry_id").distinct().select(F.lit(1).alias("entry_kind"), F.col("entry_id").alias("name"))
    two = unified_images(tree).select(F.lit(2), "path")
    return one.unionAll(two).unionAll(kernels(tree).select(F.lit(3), "kernel_version"))


def kernel_entries(found: DataFrame, entry_id: str | None = None, options: str = "") -> DataFrame:
    """Kernels as text entries: (entry_id, text). Those without an initramfs are left out."""
    name = F.lit(entry_id) if entry_id else F.col("kernel_version")
    title = F.coalesce(os_release("os_release")["label"], F.concat(F.lit("Linux "), "kernel_version"))
    folder = F.concat(F.lit("/"), name, F.lit("/"))
    lines = [
        F.concat(F.lit("title "), title),
        F.concat(F.lit("version "), "kernel_version"),
        F.concat(F.lit("linux "), folder, F.lit("vmlinuz")),
        F.concat(F.lit("initrd "), folder, F.lit("initramfs.img")),
        F.lit(f"options {options}".rstrip()),
    ]
    return found.filter("initramfs is not null").select(name.alias("entry_id"), F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n")).alias("text"))


def with_argument(options: Column, argument: str) -> Column:
    """Kernel options with an argument in place of one of the same key, or at the end."""
    tokens = text.split_cmdline(options)
    key = argument.partition("=")[0]
    mine = lambda x: (x == key) | x.startswith(key + "=")
    replaced = F.transform(tokens, lambda x: F.when(mine(x), argument).otherwise(x))
    once = F.when(F.exists(tokens, mine), F.array_join(replaced, " ")).otherwise(F.concat_ws(" ", F.nullif(options, F.lit("")), F.lit(argument)))
    return once


def relocated(value: Column, entry_id: str, subdir: str | None = None) -> Column:
    """A linux, initrd or efi path moved to the entry's own folder."""
    folder = f"/{subdir}/{entry_id}/" if subdir else f"/{entry_id}/"
    return F.concat(F.lit(folder), paths.name(value))


def pe_section(image: bytes, name: str) -> bytes | None:
    """The contents of a section of a portable executable; null where it has none. Broken files raise ValueError."""
    try:
        if image[:2] != b"MZ":
            raise ValueError("no MZ magic")
        at = struct.unpack_from("<I", image, 0x3C)[0]
        if image[at : at + 4] != b"PE\0\0":
            raise ValueError("no PE magic")
        sections, optional = struct.unpack_from("<H", image, at + 6)[0], struct.unpack_from("<H", image, at + 20)[0]
        for k in range(sections):
            head = at + 24 + optional + 40 * k
            if image[head : head + 8].rstrip(b"\0") == name.encode():
                size, _, raw, start = struct.unpack_from("<IIII", image, head + 8)
                body = image[start : start + min(size, raw)]
                if len(body) < min(size, raw):
                    raise ValueError("a section outside the file")
                return body
    except struct.error as e:
        raise ValueError("too short") from e
    return None


def _section_text(image: bytes | None, name: str) -> str | None:
    if image is None:
        return None
    try:
        body = pe_section(bytes(image), name)
        return None if body is None else body.decode().rstrip("\0")
    except ValueError:
        return None


section_text = F.udf(_section_text, T.StringType(), useArrow=False)


def renamed(path: Column, name: Column | str) -> Column:
    """A unified image's path with a new name in the same folder."""
    new = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.regexp_replace(path, r"[^/]*\z", ""), new, F.lit(".efi"))


def writable(images: DataFrame, image_id: str, prefix: str) -> DataFrame:
    """Of unified images (path, content) those whose embedded command line names this file system image, in an argument of this
    prefix."""
    named = text.image_address(section_text(F.col("content"), F.lit(".cmdline")), prefix)
    return images.filter(named["digest"] == image_id)


def adjusted(content: Column, argument: Column) -> Column:
    """A text entry's lines with an argument among the kernel options: in place of one of its key, at the end, or on a line of its own."""
    lines = F.filter(F.split(content.cast("string"), "\n"), lambda x: x != "")
    mine = lambda x: x.rlike(r"\Aoptions(\s|\z)")
    key = F.concat(F.substring_index(argument, "=", 1), F.lit("="))
    kept = lambda x: F.filter(text.split_cmdline(F.regexp_replace(x, r"\Aoptions\s*", "")), lambda y: ~y.startswith(key))
    changed = F.transform(lines, lambda x: F.when(mine(x), F.concat_ws(" ", F.lit("options"), kept(x), argument)).otherwise(x))
    whole = F.when(F.exists(lines, mine), changed).otherwise(F.concat(lines, F.array(F.concat(F.lit("options "), argument))))
    return F.concat(F.array_join(whole, "\n"), F.lit("\n"))


def boot_files(tree: DataFrame, image_id: str, prefix: str, insecure: bool = False, subdir: str | None = None) -> DataFrame:
    """(path, kind, mode, content) of what a boot partition needs for a tree's entries: text entries with the image among the kernel options and
    the files that they name, kernels as text entries of their own, and unified images that name the image."""
    argument = F.lit(f"{prefix}{'?' if insecure else ''}{image_id}")
    below = F.lit(f"/{subdir.strip('/')}" if subdir else "")
    own = tree.filter((paths.parent(F.col("path")) == ENTRIES) & F.col("path").endswith(".conf") & (F.col("kind") == "reg"))
    entries = own.select(
        F.concat(below, F.regexp_replace("path", r"\A/boot", "")).alias("path"), adjusted(F.col("content"), argument).cast("binary").alias("content")
    )
    named = entry_files(text_entries(tree), tree).filter("kind = 'reg'")
    files = named.select(
        F.concat(below, F.regexp_replace("path", r"\A/boot", "")).alias("path"), F.col("content").cast("binary").alias("content")
    ).dropDuplicates(["path"])
    found = kernels(tree).filter("initramfs is not null")
    texts = kernel_entries(found).select(
        F.concat(below, F.lit("/loader/entries/"), "entry_id", F.lit(".conf")).alias("path"), adjusted(F.col("text"), argument).cast("binary").alias("content")
    )
    parts = found.select("kernel_version", F.explode(F.array("vmlinuz", "initramfs")).alias("from"))
    moved = parts.join(tree.select(F.col("path").alias("from"), "content"), "from")
    moved = moved.select(
        F.concat(below, F.lit("/"), "kernel_version", F.lit("/"), paths.name(F.col("from"))).alias("path"), F.col("content").cast("binary").alias("content")
    )
    unified = writable(unified_images(tree).filter("not is_addon").select("path").join(tree.select("path", "content"), "path"), image_id, prefix)
    unified = unified.select(F.concat(below, F.lit("/EFI/Linux/"), paths.name(F.col("path"))).alias("path"), F.col("content").cast("binary").alias("content"))
    every = entries.unionAll(files).unionAll(texts).unionAll(moved).unionAll(unified)
    return every.select(
        F.col("path").cast("binary").alias("path"),
        F.lit("reg").alias("kind"),
        F.lit(0o644).alias("mode"),
        F.lit(None).cast("binary").alias("target"),
        "content",
    )


def with_folders(files: DataFrame) -> DataFrame:
    """files with the folders above them."""
    above = files.select(F.explode(paths.ancestors(F.col("path").cast("string"))).alias("path")).distinct()
    dirs = above.select(
        F.col("path").cast("binary"),
        F.lit("dir").alias("kind"),
        F.lit(0o755).alias("mode"),
        *(F.lit(None).cast("binary").alias(x) for x in ("target", "content")),
    )
    return dirs.unionAll(files)
