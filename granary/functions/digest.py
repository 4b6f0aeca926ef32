"""Merkle digests of file contents, ids and object paths.

``verity`` is a plain Catalyst expression. ``verity_bytes`` is the same on bytes in Python, for codecs and tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: block size, identifiers of the hash functions, bytes of a digest.
BLOCK = 4096
ALGORITHMS = {"sha256": (1, 32, 256), "sha512": (2, 64, 512)}
DESCRIPTOR_TAIL = 32 + 144


def verity_bytes(data: bytes, algorithm: str = "sha256") -> bytes:
    number, size, _ = ALGORITHMS[algorithm]
    hashed = lambda x: hashlib.new(algorithm, x).digest()
    level = data
    if not data:
        root = bytes(size)
    else:
        while True:
            level = b"".join(hashed(level[k : k + BLOCK].ljust(BLOCK, b"\0")) for k in range(0, len(level), BLOCK))
            if len(level) == size:
                root = level
                break
    return hashed(bytes([1, number, 12, 0]) + bytes(4) + len(data).to_bytes(8, "little") + root.ljust(64, b"\0") + bytes(DESCRIPTOR_TAIL))


#: No binary value is larger.
LARGEST = (1 << 31) - 1


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _level(data: Column, bits: int) -> Column:
    zero = F.unhex(F.lit("00"))

    def hashed(data: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.octet_length(data) / BLOCK).cast("int") - 1)
        part = lambda i: F.rpad(F.substring(data, i * BLOCK + 1, F.lit(BLOCK)), F.lit(BLOCK), zero)
        return F.unhex(F.array_join(F.transform(blocks, lambda i: F.sha2(part(i), bits)), ""))

    return _once(data, hashed)


def levels_of(algorithm: str) -> int:
    """How many levels cover every size that a binary value can have."""
    fan, levels = BLOCK // ALGORITHMS[algorithm][1], 1
    while BLOCK * fan ** (levels - 1) < LARGEST:
        levels += 1
    return levels


def verity(data: Column, algorithm: str = "sha256") -> Column:
    """Digest of a binary column as lower-case hex."""
    number, size, bits = ALGORITHMS[algorithm]
    one, fan = F.octet_length(data), BLOCK // size
    # Most contents are one block, which takes no list of blocks.
    block = F.unhex(F.sha2(F.rpad(data, F.lit(BLOCK), F.unhex(F.lit("00"))), bits))
    root, level = F.when(one == 0, F.unhex(F.lit("00" * size))).when(one <= BLOCK, block), _level(data, bits)
    for depth in range(1, levels_of(algorithm)):
        level = _level(level, bits)
        root = root.when(one <= BLOCK * fan**depth, level)
    big_endian = F.unhex(F.lpad(F.hex(one.cast("long")), 16, "0"))
    little = F.concat(*(F.substring(big_endian, k, 1) for k in range(8, 0, -1)))
    zeros = lambda n: F.unhex(F.lit("00" * n))
    descriptor = F.concat(F.unhex(F.lit(f"01{number:02x}0c00" + "00" * 4)), little, F.rpad(root, F.lit(64), F.unhex(F.lit("00"))), zeros(DESCRIPTOR_TAIL))
    return F.sha2(descriptor, bits)


def content_id(text: Column) -> Column:
    """Lower-case hex of the SHA-256 of a string or binary column."""
    return F.sha2(text.cast("binary"), 256)


def display_id(hex_id: Column, algorithm: str = "sha256") -> Column:
    return F.concat(F.lit(algorithm + ":"), hex_id)


def object_path(hex_id: Column) -> Column:
    """The first byte names one of 256 folders."""
    return F.concat(F.substring(hex_id, 1, 2), F.lit("/"), F.substring(hex_id, 3, 1 << 20))


def from_object_path(path: Column) -> Column:
    """The id at the end of a path, null where there is none."""
    found = F.regexp_extract(path, r"(?:^|/)([0-9a-f]{2}/[0-9a-f]+)\z", 1)
    return F.when(found != "", F.replace(found, F.lit("/"), F.lit("")))


def from_hex(text: Column, size: int = 32) -> Column:
    """Bytes of exactly so many, else null."""
    return F.when(text.rlike(rf"\A[0-9a-fA-F]{{{2 * size}}}\z"), F.unhex(text))


def algorithm_name(text: Column) -> Column:
    """(hash, log2 of the block) of an algorithm's name such as fsverity-sha256-12; null where it is none."""
    hash_name, block = F.regexp_extract(text, r"\Afsverity-(sha256|sha512)-(\d+)\z", 1), F.regexp_extract(text, r"\Afsverity-(sha256|sha512)-(\d+)\z", 2)
    return F.when((hash_name != "") & (block == "12"), F.struct(hash_name.alias("hash"), block.cast("int").alias("log2_block")))


def algorithm_of_name(name: Column) -> Column:
    """The hash function of an object by the length of its name within a folder."""
    return F.when(F.length(name) == 62, "sha256").when(F.length(name) == 126, "sha512")
