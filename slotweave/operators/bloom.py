"""Bloom filters as rows (key, word, bits): 64 bits of a filter each, so that a filter is built and probed in parts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions.hashing import murmur3_128

SEED = 0x9747B28C
CAPACITY, ERROR = 100, 0.01  # of a filter that is created by its first add
_LN2_SQUARED, _LN2 = 0.480453013918201, 0.693147180559945


def sizing(capacity: int, error_rate: float) -> tuple[int, int]:
    """(bits, hashes) of a filter for so many items at this rate of false positives; bits are whole 64-bit words."""
    if capacity <= 0 or not 0 < error_rate < 1:
        raise ValueError("capacity must be positive and the error rate between 0 and 1")
    per_entry = abs(math.log(error_rate) / _LN2_SQUARED)
    bits = math.floor(capacity * per_entry)
    return max(-(-bits // 64), 1) * 64, math.ceil(_LN2 * per_entry)


def positions(item: Column, bits: int, hashes: int) -> Column:
    """The bits of an item, as an array; null for null."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(items: pd.Series) -> pd.Series:
        import numpy as np

        there = items.notna().to_numpy()
        a, b = murmur3_128((x.encode() for x in items[there]), SEED)
        at = (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)
        out = np.full(len(items), None, object)
        for i, own in zip(np.flatnonzero(there), at.astype(np.int64)):
            out[i] = own
        return pd.Series(out)

    return of(item)


def _words(items: DataFrame, bits: int, hashes: int) -> DataFrame:
    """key, item, word, mask: what an item sets in each word; an item's bits in one word are one row."""
    at = items.select("key", "item").dropna().distinct().select("key", "item", F.explode(positions(F.col("item"), bits, hashes)).alias("at"))
    mask = F.expr("shiftleft(1L, cast(at % 64 as int))")
    return at.groupBy("key", "item", F.shiftright("at", 6).alias("word")).agg(F.bit_or(mask).alias("mask"))


def madd(items: DataFrame, capacity: int = CAPACITY, error_rate: float = ERROR) -> DataFrame:
    """Filters (key, word, bits) that hold ``items`` (key, item); null keys and items are not added."""
    bits, hashes = sizing(capacity, error_rate)
    at = items.select("key", "item").dropna().select("key", F.explode(positions(F.col("item"), bits, hashes)).alias("at"))
    return at.groupBy("key", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filters of both; they must have the same parameters."""
    return a.unionByName(b).groupBy("key", "word").agg(F.bit_or("bits").alias("bits"))


def exists(filters: DataFrame, asked: DataFrame, capacity: int = CAPACITY, error_rate: float = ERROR) -> DataFrame:
    """key, item, present (0 or 1) for each distinct row of ``asked``; 0 if there is no such filter."""
    bits, hashes = sizing(capacity, error_rate)
    probed = _words(asked, bits, hashes).join(filters, ["key", "word"], "left")
    held = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    return probed.groupBy("key", "item").agg(F.when(F.bool_and(held), 1).otherwise(0).cast("bigint").alias("present"))


def info(items: DataFrame, capacity: int = CAPACITY, error_rate: float = ERROR) -> DataFrame:
    """key, capacity, size_bytes, hashes, error_rate, inserted: adds are counted, repeated ones too."""
    bits, hashes = sizing(capacity, error_rate)
    counted = items.where("key IS NOT NULL AND item IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("inserted"))
    return counted.select("key", F.lit(capacity).cast("bigint").alias("capacity"), F.lit(bits // 8).cast("bigint").alias("size_bytes"), F.lit(hashes).cast("bigint").alias("hashes"), F.lit(error_rate).alias("error_rate"), "inserted")
