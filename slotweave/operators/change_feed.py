"""Rebuilding the state of a table from a feed of inserts, updates and deletes.

Each bucket of keys is an embedded DuckDB table with a primary key.  Changes are upserted; on conflict the stored
sequence is compared, so that repeated and out-of-order changes do no harm, and deletes stay as tombstones that
later-arriving older changes cannot undo.  Upserts are associative: every input partition is first reduced by an
upsert of its own, so at most one row per key and partition is shuffled however hot a key is.  The bucket results
are written beside the current version and published by one rename.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotweave.functions.jsontext import parse, text_of
from slotweave.workspace import fresh_path, get_text, materialize, put_text

STATE = "shard STRING, store STRING, kv_key STRING, member STRING, seq BIGINT, live BOOLEAN, value STRING"
_STATE = pa.schema([("shard", pa.string()), ("store", pa.string()), ("kv_key", pa.string()), ("member", pa.string()), ("seq", pa.int64()), ("live", pa.bool_()), ("value", pa.string())])
_CREATE = """CREATE TABLE state(shard VARCHAR, store VARCHAR, kv_key VARCHAR, member VARCHAR, seq BIGINT, live BOOLEAN, value VARCHAR,
             PRIMARY KEY (shard, store, kv_key, member))"""
_UPSERT = """INSERT INTO state
             SELECT shard, store, kv_key, member, max(seq), arg_max(live, seq), arg_max(coalesce(value, ''), seq) FROM batch GROUP BY shard, store, kv_key, member
             ON CONFLICT DO UPDATE SET seq = excluded.seq, live = excluded.live, value = excluded.value WHERE excluded.seq > state.seq"""
BUCKET_BYTES = 24 << 20  # of the changes in a bucket: their number grows with the feed, their size doesn't
_MEMORY = "480MB"  # of a bucket's table; nothing is written to an executor's own disk
BROADCAST_ROWS = 1_000_000  # of (shard, term) pairs; more are joined by a shuffle
_SALTS = 32


def _rows(bucket) -> Iterator[pa.RecordBatch]:
    for batch in bucket.sql("SELECT * FROM state").to_arrow_reader(50_000):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(n).cast(_STATE.field(n).type) for n in _STATE.names], schema=_STATE)


def upsert(changes: Iterator[pa.RecordBatch], flush: int | None = None) -> Iterator[pa.RecordBatch]:
    """Upsert batches of changes into one DuckDB table and give its rows back, tombstones included.

    With ``flush`` the table is given back and emptied whenever that many bytes went into it: as upserts are
    associative, a part of the input may be reduced in several steps.
    """
    import duckdb

    with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": _MEMORY, "temp_directory": ""}) as bucket:
        bucket.execute(_CREATE)
        held = 0
        for batch in changes:
            if batch.num_rows:
                bucket.register("batch", pa.Table.from_batches([batch]).select(_STATE.names))
                bucket.execute(_UPSERT)
                bucket.unregister("batch")
                held += batch.nbytes
            if flush and held > flush:
                yield from _rows(bucket)
                bucket.execute("DROP TABLE state")
                bucket.execute(_CREATE)
                held = 0
        yield from _rows(bucket)


def command(data: bytes | None) -> tuple[str, dict] | None:
    """(cmd, args) of a JSON command, else None."""
    try:
        value = parse(data.decode("utf-8")) if data else None
    except ValueError:
        return None
    if not isinstance(value, dict) or not isinstance(value.get("cmd"), str):
        return None
    args = value.get("args")
    return value["cmd"], args if isinstance(args, dict) else {}


def _text(value) -> str | None:
    return value if isinstance(value, str) or value is None else text_of(value)


def keyed_changes(cmd: str, args: dict) -> Iterator[tuple[str, str, str, bool, str | None]]:
    """(store, key, member, live, value) of the records that a command writes or deletes; a command without a key writes nothing."""
    key = _text(args.get("key"))
    if key is None:
        return
    if cmd == "SET":
        yield "string", key, "", True, _text(args.get("value"))
    elif cmd == "ZADD" and (member := _text(args.get("member"))) is not None:
        yield "zset", key, member, True, _text(args.get("score"))
    elif cmd == "DEL":
        yield "string", key, "", False, None
        number = 1
        while (more := _text(args.get(str(number)))) is not None:
            yield "string", more, "", False, None
            number += 1
    elif cmd == "ZREM":
        for name, member in args.items():
            if name != "key" and member is not None:
                yield "zset", key, _text(member), False, None


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in _STATE.names]
        for shard, idx, data in zip(*(batch.column(n).to_pylist() for n in ("shard", "idx", "data"))):
            if (found := command(data)) is None:
                continue
            for store, key, member, live, value in keyed_changes(*found):
                for column, x in zip(columns, (shard, store, key, member, idx, live, value)):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STATE)], schema=_STATE)


def in_force(log: DataFrame) -> DataFrame:
    """The entries that no entry of their shard with a lower or equal idx and a higher term overrules.

    Per shard and term only the lowest idx matters: an entry is overruled from the lowest idx of any higher term
    on.  That table has a row per shard and term, not per entry.  Rows with a null shard, idx or term are no entries.
    """
    rows = log.where("shard IS NOT NULL AND idx IS NOT NULL AND term IS NOT NULL")
    spans = rows.groupBy("shard", "term").agg(F.min("idx").alias("_start"), F.max("idx").alias("_last"))
    later = Window.partitionBy("shard").orderBy(F.desc("term")).rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.select("shard", "term", "_last", F.min("_start").over(later).alias("_end"))
    # only the terms that lost entries; the log itself isn't shuffled as long as their table is small
    lost = materialize(ends.where("_last >= _end").select("shard", "term", "_end"), "lost-terms")
    if lost.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(lost), ["shard", "term"], "left")
    else:
        salted = lost.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("idx"), F.lit(_SALTS)).cast("int")).join(salted, ["shard", "term", "_salt"], "left").drop("_salt")
    return joined.where("_end IS NULL OR idx < _end").drop("_end")


def _in_buckets(reduced: DataFrame, buckets: int | None) -> DataFrame:
    """Upsert the reduced changes in buckets of keys, as many as their bytes need."""
    reduced = materialize(reduced, "reduced-changes")
    if buckets is None:
        length = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
        size = reduced.agg(F.sum(F.lit(32) + sum((length(c) for c in ("shard", "kv_key", "member", "value")), F.lit(0)))).first()[0] or 0
        buckets = max(int(reduced.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    return reduced.repartition(buckets, "shard", "store", "kv_key", "member").mapInArrow(upsert, STATE)


def apply_changes(changes: DataFrame, buckets: int | None = None) -> DataFrame:
    """The state after all ``changes`` (columns STATE), tombstones included; one row per (shard, store, kv_key, member).

    Of changes with the same sequence one counts, which the feed promises are equal.  A null value is kept as ''.
    """
    return _in_buckets(changes.mapInArrow(lambda batches: upsert(batches, BUCKET_BYTES), STATE), buckets)


def replay(log: DataFrame, buckets: int | None = None) -> DataFrame:
    """The strings and sorted sets that each shard holds after its last entry in force, tombstones included.

    Entries whose data is null, broken or no JSON command, and commands that touch other stores, have no effect.
    The command in ``data`` counts, whatever the column ``cmd`` says.
    """
    entries = in_force(log.select("shard", "idx", "term", "data")).where("data IS NOT NULL").select("shard", "idx", "data")
    return _in_buckets(entries.mapInArrow(lambda batches: upsert(_decoded(batches), BUCKET_BYTES), STATE), buckets)


def publish(state: DataFrame, target: str | None = None) -> str:
    """Write a version of the state beside the published one and make it current by one rename; returns its path.

    A reader sees the old version or the new one, never a part: the pointer file is replaced only after every
    bucket's rows lie in the new version's folder.  A job that dies before leaves the old version current.
    """
    spark = state.sparkSession
    target = target or fresh_path(spark, "state")
    version = f"{target}/v-{uuid.uuid4().hex}"
    state.write.option("compression", "zstd").parquet(version)
    put_text(spark, f"{target}/CURRENT", version)
    return target


def published(spark: SparkSession, target: str) -> DataFrame:
    """The current version of a published state."""
    version = get_text(spark, f"{target}/CURRENT")
    return spark.read.schema(STATE).parquet(version)


def live_records(log: DataFrame, target: str | None = None) -> DataFrame:
    """shard, store, kv_key, member, last_idx of the records that are live after the last entry."""
    target = publish(replay(log), target)
    return published(log.sparkSession, target).where("live").select("shard", "store", "kv_key", "member", F.col("seq").alias("last_idx"))
