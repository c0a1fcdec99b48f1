"""Count-min sketches as rows (key, row, col, n), which add up."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions.hashing import murmur3_32

MAX_CELL = 4_294_967_295


def dimensions(error_rate: float, probability: float) -> tuple[int, int]:
    """(width, depth) such that an estimate is off by at most the rate, but for the probability."""
    if not (0 < error_rate < 1 and 0 < probability < 1):
        raise ValueError("error rate and probability must lie between 0 and 1")
    return math.ceil(2 / error_rate), math.ceil(math.log10(probability) / math.log10(0.5))


def _cells(items: DataFrame, width: int, depth: int) -> DataFrame:
    if width <= 0 or depth <= 0:
        raise ValueError("width and depth must be positive")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def columns(item: pd.Series) -> pd.Series:
        import numpy as np

        hashes = murmur3_32([x.encode() for x in item], np.arange(depth))
        return pd.Series(list((hashes % np.uint32(width)).astype(np.int64)), dtype=object)

    return items.select("*", F.posexplode(columns(F.col("item"))).alias("row", "col"))


def incrby(adds: DataFrame, width: int, depth: int) -> DataFrame:
    """Sketches of ``adds`` (key, item, n); a cell stops at 2^32 - 1.  Null keys, items and numbers are left out."""
    sums = adds.select("key", "item", "n").dropna().groupBy("key", "item").agg(F.sum("n").alias("n"))  # each item is hashed once
    return _cells(sums, width, depth).groupBy("key", "row", "col").agg(F.least(F.sum("n"), F.lit(MAX_CELL)).alias("n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("key", "row", "col").agg(F.least(F.sum("n"), F.lit(MAX_CELL)).alias("n"))


def query(sketches: DataFrame, asked: DataFrame, width: int, depth: int) -> DataFrame:
    """key, item, estimate for each distinct row of ``asked``; an estimate is never too low, and 0 without a sketch."""
    cells = _cells(asked.select("key", "item").dropna().distinct(), width, depth)
    found = cells.join(sketches, ["key", "row", "col"], "left")
    return found.groupBy("key", "item").agg(F.min(F.coalesce("n", F.lit(0))).cast("bigint").alias("estimate"))
