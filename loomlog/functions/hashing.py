"""Stable key hash: FNV-1a with 64 bits as a column, its remainder, and a plain twin for literals and tests.

Spark has no unsigned 64-bit type and checks overflow, so the hash is carried as two 32-bit halves in longs. A step
multiplies by 2^40 + 435: 435 times each half stays below 2^42, and 2^40 moves the low half's low 24 bits up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of FNV-1a with 64 bits.
OFFSET = 0xCBF29CE484222325
PRIME = 0x100000001B3
LOW = 0xFFFFFFFF


def fnv1a_int(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & (1 << 64) - 1
    return h


def shard_of(data: bytes | str, shards: int) -> int:
    return fnv1a_int(data.encode() if isinstance(data, str) else data) % shards


def _bytes(value: Column) -> Column:
    """Byte values of a binary (or string) column as an array of longs; empty for an empty value.

    Read as Latin-1, each byte is one character with its value as the code point.
    """
    characters = F.split(F.decode(value.cast("binary"), "ISO-8859-1"), "")
    values = F.transform(characters, lambda c: F.ascii(c).cast("long"))
    return F.when(F.octet_length(value) > 0, values).otherwise(F.array().cast("array<bigint>"))


def fnv1a(value: Column) -> Column:
    """struct(hi, lo) of the hash of the value's bytes; null for null."""

    def step(h: Column, b: Column) -> Column:
        x = h["lo"].bitwiseXOR(b)
        low = x * F.lit(PRIME & 0xFFFF)
        hi = h["hi"] * F.lit(PRIME & 0xFFFF) + F.shiftright(low, 32) + x.bitwiseAND(F.lit(0xFFFFFF)) * F.lit(256)
        return F.struct(hi.bitwiseAND(F.lit(LOW)).alias("hi"), low.bitwiseAND(F.lit(LOW)).alias("lo"))

    start = F.struct(F.lit(OFFSET >> 32).cast("long").alias("hi"), F.lit(OFFSET & LOW).cast("long").alias("lo"))
    return F.when(value.isNotNull(), F.aggregate(_bytes(value), start, step))


def unsigned_mod(hash_: Column, n: int) -> Column:
    """Unsigned remainder of struct(hi, lo) by n < 2^31."""
    if not 0 < n < 1 << 31:
        raise ValueError("the number of shards must be from 1 to 2^31 - 1")
    return ((hash_["hi"] % n) * ((1 << 32) % n) + hash_["lo"] % n) % n


def shard(key: Column, shards: int) -> Column:
    """Shard of a key: its hash modulo the number of shards, as int."""
    return unsigned_mod(fnv1a(key), shards).cast("int")
