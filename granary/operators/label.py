"""Labels by rules: the last rule whose pattern matches a path and its type wins."""

from __future__ import annotations

import functools
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = "<<none>>"
#: Type characters by rule option and by kind.
TYPES = {"--": "-", "-d": "d", "-l": "l", "-b": "b", "-c": "c", "-p": "p", "-s": "s"}
KINDS = {"reg": "-", "dir": "d", "lnk": "l", "blk": "b", "chr": "c", "fifo": "p", "sock": "s"}


def rules(lines: list[str]) -> list[tuple[str, str]]:
    """(pattern, context) of each rule: an expression, an optional type and a context. The pattern is for path and type
    character."""
    out = []
    for line in lines:
        fields = line.split()
        if not fields or fields[0].startswith("#"):
            continue
        if len(fields) == 3 and fields[1] in TYPES:
            out.append((rf"\A(?s:({fields[0]}){TYPES[fields[1]]})\z", fields[2]))
        elif len(fields) == 2:
            out.append((rf"\A(?s:({fields[0]}).)\z", fields[1]))
        else:
            raise ValueError(f"a rule of {len(fields)} fields: {line!r}")
    return out


@functools.lru_cache(8)
def _compiled(found: tuple[tuple[str, str], ...]) -> list[tuple[str, re.Pattern, str]]:
    """Rules from the last to the first, each with the plain text that its paths begin with."""
    out = []
    for pattern, context in reversed(found):
        inner = pattern[len(r"\A(?s:(") : -len(r")\z")]
        plain = re.match(r"(?:[\w/ %,:@~=-]|\\[.+\-])*", inner)[0]
        # The last character may be an optional one, and in an alternative none is sure.
        stop = inner[len(plain) : len(plain) + 1]
        sure = "" if "|" in inner else plain[: -2 if plain[-2:-1] == "\\" else -1] if stop in ("*", "?", "{") else plain
        out.append((sure.replace("\\", ""), re.compile(pattern.removesuffix(r"\z") + r"\Z"), context))
    return out


def context_of(subject: str, found: tuple[tuple[str, str], ...]) -> str | None:
    """The context of the last rule that matches a path and its type character."""
    for plain, pattern, context in _compiled(found):
        if subject.startswith(plain) and pattern.match(subject):
            return None if context == NONE else context
    return None


def label(path: Column, kind: Column, found: list[tuple[str, str]]) -> Column:
    """The context of the last rule that matches; null for none and for <<none>>. Rules are a list that was read: every worker compiles them
    once and tries them from the last, only those whose plain beginning fits."""
    every = tuple(found)
    code = F.coalesce(reduce(lambda a, b: a.when(kind == b[0], b[1]), KINDS.items(), F.when(F.lit(False), "")), F.lit("-"))

    @F.pandas_udf(T.StringType())
    def of(subjects: pd.Series) -> pd.Series:
        known = {x: context_of(x, every) for x in subjects.dropna().unique()}
        return subjects.map(lambda x: None if x is None else known[x]).astype(object)

    return of(F.concat(path, code))


def aliased(path: Column, aliases: dict[str, str]) -> Column:
    """A path with exact substitutions at each directory step: what is replaced above carries on below."""
    names = F.filter(F.split(path, "/"), lambda x: x != "")
    if not aliases:
        return path
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))

    def step(so_far: Column, name: Column) -> Column:
        here = F.concat(so_far, F.lit("/"), name)
        return F.coalesce(F.element_at(table, here), here)

    return F.coalesce(F.nullif(F.aggregate(names, F.lit(""), step), F.lit("")), F.lit("/"))


def selinux_type(config: str) -> str | None:
    """The policy that a configuration's first SELINUXTYPE= names."""
    for line in config.splitlines():
        key, found, value = line.partition("=")
        if found and key.strip().upper() == "SELINUXTYPE":
            return value.strip()
    return None


def substitutions(lines: list[str]) -> dict[str, str]:
    """Path aliases, the last of a path counting."""
    pairs = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    if any(len(x) != 2 for x in pairs):
        raise ValueError("an alias of other than two fields")
    return dict(pairs)


def load_policy(tree: DataFrame) -> tuple[list[tuple[str, str]], dict[str, str]] | None:
    """Rules and aliases of the policy that a tree (path, content) holds; None where it has none. A handful of named files are read."""
    text_of = lambda *at: {
        r.path: bytes(r.content).decode() if isinstance(r.content, bytes | bytearray) else r.content for r in tree.filter(
            F.col("path").isin(*at) & F.col("content").isNotNull()
        ).select("path", "content").collect()
    }
    name = selinux_type(text_of("/etc/selinux/config").get("/etc/selinux/config", ""))
    if name is None:
        return None
    base = f"/etc/selinux/{name}/contexts/files/file_contexts"
    files = text_of(*(base + x for x in ("", ".local", ".homedirs", ".subs", ".subs_dist")))
    if base not in files:
        return None
    lines = [y for x in ("", ".local", ".homedirs") for y in files.get(base + x, "").splitlines()]
    aliases = [y for x in (".subs", ".subs_dist") for y in files.get(base + x, "").splitlines()]
    return rules(lines), substitutions(aliases)


def relabelled(entries: DataFrame, found: list[tuple[str, str]] | None, aliases: dict[str, str] | None = None, xattr: str = "security.selinux") -> DataFrame:
    """entries with the label in xattrs (string or binary keys and values), or without any label where there are no rules. A leaf
    with several paths has the label of its last path in tree order."""
    bare = F.map_filter("xattrs", lambda k, v: k.cast("string") != xattr)
    kind = entries.schema["xattrs"].dataType
    if found is None:
        return entries.withColumn("xattrs", bare)
    rows = entries.withColumn("_label", label(aliased(F.col("path"), aliases or {}), F.col("kind"), found))
    last = rows.filter("leaf_id is not null").groupBy("leaf_id").agg(
        F.max_by(F.struct("_label"), F.filter(F.split("path", "/"), lambda x: x != "")).alias("_last")
    )
    rows = rows.join(last, "leaf_id", "left").withColumn("_label", F.when(F.col("_last").isNotNull(), F.col("_last._label")).otherwise(F.col("_label")))
    return rows.withColumn(
        "xattrs",
        F.when(F.col("_label").isNull(), bare).otherwise(
            F.map_concat(bare, F.create_map(F.lit(xattr).cast(kind.keyType), F.col("_label").cast(kind.valueType)))
        ),
    ).drop("_label", "_last")


def policy_in(spark: SparkSession, folder: str) -> tuple[list[tuple[str, str]], dict[str, str]] | None:
    """Rules and aliases of the policy in the folder of a root file system; None where it has none."""
    at = f"{folder.rstrip('/')}/etc/selinux"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    inside = F.concat(F.lit("/etc/selinux"), F.substring_index("path", "/etc/selinux", -1))
    return load_policy(files.select(inside.alias("path"), F.col("content").cast("string").alias("content")))
