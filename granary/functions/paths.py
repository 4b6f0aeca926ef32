"""Paths as columns. They are absolute, with "/" for the root; binary and string columns both work where Spark's functions do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Components below the root. Ordering rows by them is depth-first order with each directory before its children."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def of_parts(names: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(names, "/"))


def parent(path: Column) -> Column:
    """Null for the root."""
    return F.when(path != "/", F.coalesce(F.nullif(F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1), F.lit("")), F.lit("/")))


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def ancestors(path: Column, itself: bool = False) -> Column:
    """All directories above a path from the root down, and the path itself if asked for."""
    p = parts(path)
    n = F.size(p)
    above = F.transform(F.sequence(F.lit(0), n), lambda i: of_parts(F.slice(p, F.lit(1), i)))
    return above if itself else F.slice(above, F.lit(1), n)


def absolute(path: Column) -> Column:
    """A path inside an archive made absolute: one slash in front, none behind; the root is empty."""
    return F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path, r"\A/+", "")), r"/+\z", "")


def canonical(path: Column) -> Column:
    """True for absolute paths without empty, "." or ".." components, of at most 4096 bytes."""
    inner = F.slice(F.split(path, "/"), 2, 1 << 20)
    odd = F.exists(inner, lambda x: x.isin("", ".", ".."))
    return path.startswith("/") & ((path == "/") | ~odd) & (F.octet_length(path) <= 4096) & ~path.contains("\x00")


def relative_to(target: Column, link: Column) -> Column:
    """The relative path from a link to its target."""
    up = F.repeat(F.lit("../"), F.greatest(F.size(parts(link)) - 1, F.lit(0)))
    return F.concat(up, F.array_join(parts(target), "/"))
