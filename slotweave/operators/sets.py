"""The set store: rows (key, member), unique.  Logs have the columns idx, cmd ('SADD', 'SREM'), key and member.

Rows with a null key or member are not members.  Sets without members have no rows, so their size is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(log: DataFrame) -> DataFrame:
    """The members after the last entry: those whose last change is SADD."""
    rows = log.where("key IS NOT NULL AND member IS NOT NULL AND cmd IN ('SADD', 'SREM')")
    return rows.groupBy("key", "member").agg(F.max_by("cmd", "idx").alias("_cmd")).where("_cmd = 'SADD'").drop("_cmd")


def sadd(members: DataFrame) -> DataFrame:
    return members.select("key", "member").dropna().distinct()


def sadd_replies(log: DataFrame) -> DataFrame:
    """key, member, idx, added: 1 for the first SADD of a member, else 0."""
    rows = log.where("key IS NOT NULL AND member IS NOT NULL").select("key", "member", "idx")
    first = rows.groupBy("key", "member").agg(F.min("idx").alias("_first"))
    return rows.join(first, ["key", "member"]).select("key", "member", "idx", (F.col("idx") == F.col("_first")).cast("bigint").alias("added"))


def srem(state: DataFrame, gone: DataFrame) -> DataFrame:
    return state.join(gone.select("key", "member").dropna().distinct(), ["key", "member"], "left_anti")


def scard(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def smembers(state: DataFrame, key: str | None = None) -> DataFrame:
    """All members of each set, or of one, as rows; a large set is never one value."""
    return state.select("key", "member") if key is None else state.where(F.col("key") == key).select("key", "member")


def sismember(state: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (key, member) with is_member 0 or 1."""
    found = state.select("key", "member", F.lit(1).alias("_there"))
    return asked.select("key", "member").join(found, ["key", "member"], "left").select("key", "member", F.coalesce("_there", F.lit(0)).cast("bigint").alias("is_member"))


def smismember(state: DataFrame, asked: DataFrame) -> DataFrame:
    """key, flags: for ``asked`` (key, members ARRAY) an array of 0 and 1 in the order of its members."""
    wanted = asked.select("key", F.posexplode("members").alias("at", "member"))
    flagged = wanted.join(state.select("key", "member", F.lit(1).alias("_there")), ["key", "member"], "left")
    pairs = F.sort_array(F.collect_list(F.struct("at", F.coalesce("_there", F.lit(0)).alias("flag"))))
    return flagged.groupBy("key").agg(F.transform(pairs, lambda p: p["flag"].cast("bigint")).alias("flags"))


def srand(state: DataFrame, count: int = 1, seed: int = 0) -> DataFrame:
    """``count`` members of each set in an order that the seed fixes; all of them if the set is smaller."""
    if count < 0:
        raise ValueError("count must not be negative")
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "member"), "member")
    return state.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= count).drop("_at")


def spop(state: DataFrame, count: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the members taken out, the rest)."""
    taken = srand(state, count, seed)
    return taken, srem(state, taken)


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """'union', 'intersect' or 'subtract' of two set stores, key by key."""
    a, b = sadd(a), sadd(b)
    return {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "subtract": lambda: a.subtract(b)}[how]()
