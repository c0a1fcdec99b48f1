"""The sorted-set store: rows (key, member, score) ordered by (score, member) within a key.

Scores may be infinite but not NaN; rows with a null key or member, or a null or NaN score, are not members.
Ties of the score always go by member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.functions.bounds import rank_between, within
from slotweave.operators.neighbours import spread_rank


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where("key IS NOT NULL AND member IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")


def _ascending() -> list[Column]:
    return [F.col("score"), F.col("member")]


def _descending() -> list[Column]:
    return [F.desc("score"), F.desc("member")]


def _ranked(state: DataFrame, rev: bool = False) -> DataFrame:
    return spread_rank(state, ["key"], _descending() if rev else _ascending())


def zadd(log: DataFrame, mode: str | None = None) -> DataFrame:
    """The members after a log of adds (idx, key, member, score): the last score counts, with 'nx' the first."""
    by = {None: F.max_by, "nx": F.min_by}[mode]
    return _valid(log).groupBy("key", "member").agg(by("score", "idx").alias("score"))


def zadd_xx(state: DataFrame, log: DataFrame) -> DataFrame:
    """The state after adds that only change members it has."""
    new = zadd(log).withColumnRenamed("score", "_new")
    return state.join(new, ["key", "member"], "left").select("key", "member", F.coalesce("_new", "score").alias("score"))


def zincrby(log: DataFrame, increment: str = "score") -> DataFrame:
    """The members after a log of increments: each member's sum."""
    return _valid(log.withColumn("score", F.col(increment))).groupBy("key", "member").agg(F.sum("score").alias("score"))


def zrem(state: DataFrame, gone: DataFrame) -> DataFrame:
    return state.join(gone.select("key", "member").dropna().distinct(), ["key", "member"], "left_anti")


def zscore(state: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (key, member) with their score, null for a missing member."""
    return asked.select("key", "member").join(state.select("key", "member", "score"), ["key", "member"], "left")


def zcard(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def zrank(state: DataFrame) -> DataFrame:
    """Every member with its 0-based rank, lowest score first."""
    return _ranked(state)


def zrevrank(state: DataFrame) -> DataFrame:
    return _ranked(state, rev=True)


def rank_of(state: DataFrame, key: str, member: str, rev: bool = False) -> DataFrame:
    """One row (rank) for one member, -1 if it is missing: members before it are counted, nothing is sorted."""
    own = state.where(F.col("key") == key)
    score = own.where(F.col("member") == member).agg(F.max("score").alias("_score"))
    before = (F.col("score") < F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("member") < member))
    after = (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("member") > member))
    # the other side is one row
    counted = own.join(F.broadcast(score)).agg(F.max("_score").alias("_score"), F.count_if(after if rev else before).alias("rank"))
    return counted.select(F.when(F.col("_score").isNull(), -1).otherwise(F.col("rank")).cast("bigint").alias("rank"))


def zrange(state: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    """Each key's members of rank start..stop, both inclusive; negative ranks count from the end."""
    order = _descending() if rev else _ascending()
    if 0 <= start and 0 <= stop:  # a filter on row_number alone becomes a limit per partition before the shuffle
        ranked = state.withColumn("_row", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
        return ranked.where((F.col("_row") <= stop + 1) & (F.col("_row") > start)).withColumn("rank", (F.col("_row") - 1).cast("bigint")).drop("_row")
    ranked = _ranked(state, rev).join(zcard(state).withColumnRenamed("size", "_size"), "key")
    return ranked.where(rank_between(F.col("rank"), F.col("_size"), start, stop)).drop("_size")


def zrevrange(state: DataFrame, start: int, stop: int) -> DataFrame:
    return zrange(state, start, stop, rev=True)


def zrangebyscore(state: DataFrame, low: str, high: str, offset: int = 0, count: int | None = None, rev: bool = False) -> DataFrame:
    """Each key's members within the bounds, with their 0-based position among those; ``count`` after ``offset`` of them."""
    rows = _ranked(state.where(within(F.col("score"), low, high)), rev).withColumnRenamed("rank", "position")
    rows = rows.where(F.col("position") >= max(offset, 0))
    return rows if count is None else rows.where(F.col("position") < max(offset, 0) + max(count, 0))


def zcount(state: DataFrame, low: str, high: str) -> DataFrame:
    return state.groupBy("key").agg(F.count_if(within(F.col("score"), low, high)).alias("n"))


def zpop(state: DataFrame, count: int = 1, highest: bool = True) -> tuple[DataFrame, DataFrame]:
    """(the members taken from the end of each key, the rest)."""
    taken = zrange(state, 0, count - 1, rev=highest) if count > 0 else state.withColumn("rank", F.lit(0).cast("bigint")).where(F.lit(False))
    return taken, zrem(state, taken)


def member_ranks(state: DataFrame, member: str, rev: bool = False) -> DataFrame:
    """The rows of one member with its rank in each key: the members before it are counted, nothing is sorted."""
    own = state.where(F.col("member") == member).select("key", F.col("score").alias("_score"))
    here, there = F.struct("score", "member"), F.struct(F.col("_score").alias("score"), F.lit(member).alias("member"))
    before = F.count_if(here > there if rev else here < there).cast("bigint")
    found = state.join(own, "key").groupBy("key").agg(F.first("_score").alias("score"), before.alias("rank"))
    return found.select("key", F.lit(member).alias("member"), "score", "rank")
