"""Leaderboards: rows (key, member, score BIGINT, data), best score first and then by member; ranks start at 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.operators.neighbours import spread_rank


def _order() -> list[Column]:
    return [F.desc("score"), F.col("member")]


def add(log: DataFrame) -> DataFrame:
    """The board after a log of adds (idx, key, member, score, data): scores add up, the last data counts."""
    rows = log.where("key IS NOT NULL AND member IS NOT NULL AND score IS NOT NULL")
    return rows.groupBy("key", "member").agg(F.sum("score").alias("score"), F.max_by("data", "idx").alias("data"))


def insert(log: DataFrame) -> DataFrame:
    """The board after a log of inserts (idx, key, member, score, data): the last one replaces those before."""
    rows = log.where("key IS NOT NULL AND member IS NOT NULL AND score IS NOT NULL")
    return rows.groupBy("key", "member").agg(F.max_by("score", "idx").alias("score"), F.max_by("data", "idx").alias("data"))


def update_score(board: DataFrame, changes: DataFrame) -> DataFrame:
    """The board with new scores from ``changes`` (idx, key, member, score) for members it has; their data stays."""
    new = insert(changes.withColumn("data", F.lit(None).cast("string"))).select("key", "member", F.col("score").alias("_new"))
    return board.join(new, ["key", "member"], "left").withColumn("score", F.coalesce("_new", "score")).select(*board.columns)


def delete(board: DataFrame, gone: DataFrame) -> DataFrame:
    return board.join(gone.select("key", "member").dropna().distinct(), ["key", "member"], "left_anti")


def ranks(board: DataFrame) -> DataFrame:
    """Every member with its rank; a hot board is ranked in parts."""
    return spread_rank(board, ["key"], _order()).withColumn("rank", F.col("rank") + 1)


def rank_range(board: DataFrame, start: int, end: int) -> DataFrame:
    """Ranks start..end, cut to those there are."""
    ranked = board.withColumn("_row", F.row_number().over(Window.partitionBy("key").orderBy(*_order())))
    return ranked.where((F.col("_row") <= end) & (F.col("_row") >= max(start, 1))).withColumn("rank", F.col("_row").cast("bigint")).drop("_row")


def by_rank(board: DataFrame, rank: int) -> DataFrame:
    """The member at one rank of each key; none if the board is shorter."""
    return rank_range(board, rank, rank) if rank >= 1 else ranks(board).where(F.lit(False))


def score_range(board: DataFrame, low: int, high: int) -> DataFrame:
    """Members with a score in low..high, with their rank on the whole board."""
    return ranks(board).where(F.col("score").between(low, high))


def length(board: DataFrame) -> DataFrame:
    return board.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def period_key(period: str, at: Column) -> Column:
    """lb:day:YYYYMMDD, lb:week:<ISO year><week>, lb:month:YYYYMM or lb:year:YYYY."""
    text = {
        "day": lambda: F.date_format(at, "yyyyMMdd"),
        "week": lambda: F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lpad(F.weekofyear(at).cast("string"), 2, "0")),
        "month": lambda: F.date_format(at, "yyyyMM"),
        "year": lambda: F.date_format(at, "yyyy"),
    }[period]()
    return F.concat(F.lit(f"lb:{period}:"), text)


def period_scores(events: DataFrame, member: Column, score: Column, at: Column, periods: list[str]) -> DataFrame:
    """key, member, score: each event counts in the bucket of every period."""
    keys = F.explode(F.array(*(period_key(p, at) for p in periods)))
    return events.select(keys.alias("key"), member.alias("member"), score.alias("score")).groupBy("key", "member").agg(F.sum("score").alias("score"))
