"""Queries that run a stream over the tables to its end, and give what its sink holds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.queries import Registry, table
from slotweave.queries.cluster import _PS, _calls, _delivered
from slotweave.queries.replays import limiter_sql
from slotweave.queries.stores import _KV, kv_log
from slotweave.sources.wal import WalSource
from slotweave.streaming import stateful
from slotweave.workspace import fresh_path

registry = Registry()
query = registry.add


def _streamed(df: DataFrame, name: str) -> DataFrame:
    """A written copy of ``df`` as a stream of its files."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(path)


BATCHES, FILES = 3, 4


def _in_order(df: DataFrame, name: str) -> DataFrame:
    """A written copy of ``df`` as a stream of several micro-batches, each of higher idx than those before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    low, high = df.agg(F.min("idx"), F.max("idx")).first()
    if low is None:
        return _streamed(df, name)
    step = (high - low) // BATCHES + 1
    for n in range(BATCHES):  # files are taken by the time they were written
        part = df.where(F.col("idx").between(low + n * step, low + (n + 1) * step - 1))
        part.repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def _to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream until its input ends; each micro-batch is written under its number, so a repeated one replaces itself."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    run = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", fresh_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    schema = stream.schema.add("_batch", T.IntegerType())
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    except AnalysisException:  # an empty input makes no batch
        return spark.createDataFrame([], schema)


@query(_KV + "SELECT * FROM state")
def stream_kv_replay(spark, folder):
    log = _streamed(kv_log(spark, folder), "stream-kv")
    rows = _to_end(stateful.replay_strings(log), "stream-kv-out", "update")
    last = rows.groupBy("key").agg(F.max_by(F.struct("value", "expire_at_ms", "live"), "_batch").alias("r"))
    return last.where("r.live").select("key", "r.value", "r.expire_at_ms")


@query(limiter_sql("sliding", 3, 86_400_000))
def stream_ratelimit(spark, folder):
    calls = _in_order(_calls(spark, folder, "sliding", 3, 86_400_000), "stream-calls")
    return _to_end(stateful.check_limits(calls), "stream-calls-out", "append").drop("_batch")


@query(_PS + "SELECT sub_id, seq, idx, payload FROM box WHERE seq <= 128")
def stream_mailboxes(spark, folder):
    delivered = _in_order(_delivered(spark, folder).select("idx", "sub_id", "kind", "channel", "payload"), "stream-box")
    return _to_end(stateful.fill_mailboxes(delivered), "stream-box-out", "append").select("sub_id", "seq", "idx", "payload")


@query("SELECT idx, term, coalesce(cmd, '') AS cmd, decode(coalesce(data, ''::BLOB)) AS data, shard FROM command_log")
def wal_round_trip(spark, folder):
    """The command log written as log files, with the shard in front of the data, and read back."""
    spark.dataSource.register(WalSource)
    log = table(spark, folder, "command_log").select("idx", "term", "cmd", F.concat(F.encode("shard", "UTF-8"), F.encode(F.lit("|"), "UTF-8"), F.coalesce("data", F.encode(F.lit(""), "UTF-8"))).alias("data"), F.lit("").alias("file"))
    path = fresh_path(spark, "wal")
    log.write.format("wal").mode("append").option("path", path).save()
    text = F.decode("data", "UTF-8")
    back = spark.read.format("wal").option("path", path).load()
    return back.select("idx", "term", "cmd", F.substring_index(text, "|", 1).alias("shard"), F.expr("substring(decode(data, 'UTF-8'), instr(decode(data, 'UTF-8'), '|') + 1)").alias("data"))
