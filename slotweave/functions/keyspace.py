"""Where a key belongs: its hash tag and its slot."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16_384


def hash_tag(key: Column) -> Column:
    """The text between the first '{' and the next '}' if there is any, else the whole key; null for null."""
    tag = F.regexp_extract(key, "^[^{]*[{]([^}]+)[}]", 1)
    return F.when(F.length(tag) > 0, tag).otherwise(key)


def hash_slot(key: Column, slots: int = SLOTS) -> Column:
    """CRC-32 of the key's hash tag modulo ``slots``; the empty key is in slot 0, a null key in none."""
    return F.crc32(F.encode(hash_tag(key), "UTF-8")) % F.lit(slots)


def slot_of(key: str, slots: int = SLOTS) -> int:
    """``hash_slot`` of one key on the driver, so that a literal key prunes partitions."""
    before, opened, rest = key.partition("{")
    tag, closed, _ = rest.partition("}")
    return zlib.crc32((tag if opened and closed and tag else key).encode()) % slots
