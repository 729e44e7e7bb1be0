"""Typed ids as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARD_BITS = 6


def string_cid(c: Column) -> Column:
    """Canonical bytes of string ids."""
    return F.concat(F.unhex(F.lit("7300")), c.cast("string").cast("binary"))


def uint_cid(c: Column) -> Column:
    """Canonical bytes of unsigned ids in BIGINT or DECIMAL(20, 0)."""
    wide = c.cast("decimal(20,0)")
    top = F.lit(str(1 << 63)).cast("decimal(20,0)")
    # HEX takes signed longs, so the upper half is moved below zero
    signed = F.when(wide >= top, (wide - top - top).cast("long")).otherwise(wide.cast("long"))
    return F.concat(F.unhex(F.lit("7500")), F.unhex(F.lpad(F.hex(signed), 16, "0")))


def digest(cid: Column) -> Column:
    """Hex SHA-256 of canonical bytes: the order of the training sample."""
    return F.sha2(cid, 256)


def shard(hex_digest: Column) -> Column:
    """0 to 63: the top six bits of the digest."""
    return F.shiftright(F.conv(F.substring(hex_digest, 1, 2), 16, 10).cast("int"), 8 - SHARD_BITS)
