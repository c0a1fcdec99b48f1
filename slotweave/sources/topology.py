"""Topology documents as JSON files, and the flat tables of a topology."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.plans.placement import parse_shards
from slotweave.workspace import get_text, put_text

SCHEMA = (
    "version BIGINT, slot_count INT, vnodes INT, epsilon DOUBLE, shards MAP<STRING, STRUCT<id: STRING, members: MAP<STRING, STRING>>>, "
    "slots ARRAY<STRING>, migrations ARRAY<STRUCT<slot: INT, `from`: STRING, `to`: STRING, state: STRING>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; a document that does not fit the schema has nulls."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def write(df: DataFrame, path: str) -> None:
    """One topology as a JSON document, put in place by one rename; ``df`` must hold exactly one row."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("text")).take(2)
    if len(rows) != 1:
        raise ValueError("a document is one row")
    put_text(df.sparkSession, path, rows[0]["text"])


def save_state(spark: SparkSession, path: str, term: int, voted_for: str, commit_index: int) -> None:
    """A node's term, vote and commit index, put in place by one rename."""
    put_text(spark, path, json.dumps({"current_term": term, "voted_for": voted_for, "commit_index": commit_index}))


def load_state(spark: SparkSession, path: str) -> tuple[int, str, int]:
    """(term, vote, commit index); a missing or broken file is a fresh start: (0, '', -1)."""
    try:
        held = json.loads(get_text(spark, path) or "")
        return int(held.get("current_term", 0)), str(held.get("voted_for", "")), int(held.get("commit_index", 0))
    except (ValueError, AttributeError, TypeError):
        return 0, "", -1


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """shard, node, address of a layout written as 'id:node=url,node=url;...'."""
    return spark.createDataFrame(parse_shards(text), "shard STRING, node STRING, address STRING")


def slot_table(df: DataFrame) -> DataFrame:
    """version, slot, shard; unowned slots have an empty shard."""
    return df.select("version", F.posexplode("slots").alias("slot", "shard")).withColumn("shard", F.coalesce("shard", F.lit("")))


def member_table(df: DataFrame) -> DataFrame:
    return df.select("version", F.explode("shards").alias("shard", "s")).select("version", "shard", F.explode("s.members").alias("node", "address"))


def migration_table(df: DataFrame) -> DataFrame:
    return df.select("version", F.inline("migrations"))


def header(df: DataFrame) -> DataFrame:
    return df.select("version", "slot_count", "vnodes", "epsilon", F.size("shards").alias("shard_count"), F.size("migrations").alias("migration_count"))
