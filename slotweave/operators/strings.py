"""The string store: a log of SET, DEL, EXPIRE and INCR replayed into one row per key, and reads of it.

A log has the columns idx, ts_ms, cmd, key, value and ttl_s; idx is a total order per key.  Time is a parameter, so
that results are the same whenever they are computed.  A state has the columns key, value and expire_at_ms.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.operators.neighbours import spread_rank


def replay(log: DataFrame) -> DataFrame:
    """key, value, expire_at_ms after the last entry; the last SET counts unless a DEL follows it.

    A SET drops an older expiry; an EXPIRE after the SET replaces it.  A TTL of 0 or less in SET means none, in
    EXPIRE that the key ends at once.  Entries with a null key or idx have no effect.  Two entries with one idx are
    invalid; one of them counts.
    """
    rows = log.where("key IS NOT NULL AND idx IS NOT NULL")
    at = lambda *cmds: F.col("cmd").isin(*cmds)
    expiry = F.col("ts_ms") + F.col("ttl_s") * 1000
    last = rows.groupBy("key").agg(
        F.max_by(F.struct("cmd", "idx", "value", F.when(F.col("ttl_s") > 0, expiry).alias("expire")), F.when(at("SET", "DEL"), F.col("idx"))).alias("write"),
        F.max_by(F.struct("idx", expiry.alias("expire")), F.when(at("EXPIRE"), F.col("idx"))).alias("expire"),
    )
    later = F.col("expire.idx") > F.col("write.idx")
    return last.where("write.cmd = 'SET'").select("key", F.col("write.value").alias("value"), F.when(later, F.col("expire.expire")).otherwise(F.col("write.expire")).alias("expire_at_ms"))


def live(state: DataFrame, now_ms: int) -> DataFrame:
    """The keys that have not expired; a key ends at its expiry."""
    return state.where(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms))


def get(state: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """key, value for each of ``keys``; null if the key is missing or has expired."""
    return keys.select("key").join(live(state, now_ms).select("key", "value"), "key", "left")


def ttl(state: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """key, ttl: -2 for a missing or expired key, -1 without expiry, else the whole seconds left."""
    left = F.when(F.col("_there").isNull(), -2).when(F.col("expire_at_ms").isNull(), -1).when(F.col("expire_at_ms") <= now_ms, -2)
    found = state.select("key", "expire_at_ms", F.lit(True).alias("_there"))
    return keys.select("key").join(found, "key", "left").select("key", left.otherwise(F.expr(f"(expire_at_ms - {now_ms}) div 1000")).cast("bigint").alias("ttl"))


def delete(state: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the state without ``keys``, the number of keys that existed); an expired key that is still held counts."""
    gone = keys.select("key").dropna().distinct()
    return state.join(gone, "key", "left_anti"), state.join(gone, "key", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def expire(state: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """The state with new expiries from ``changes`` (key, ttl_s); keys that are missing or have expired are left alone."""
    new = changes.groupBy("key").agg(F.max("ttl_s").alias("_ttl"))
    alive = F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms)
    return state.join(new, "key", "left").withColumn("expire_at_ms", F.when(F.col("_ttl").isNotNull() & alive, now_ms + F.col("_ttl") * 1000).otherwise(F.col("expire_at_ms"))).drop("_ttl")


def increments(log: DataFrame, block: int = 1 << 16) -> DataFrame:
    """key, idx, value after each INCR: the count since the last DEL, on top of a number that SET wrote before.

    A SET of something that is no integer makes the following INCRs null until the next SET or DEL.  Increments are
    counted within blocks of ``block`` indexes, and the few blocks of a key carry over what the blocks before left.
    """
    rows = log.where("key IS NOT NULL AND idx IS NOT NULL AND cmd IN ('SET', 'DEL', 'INCR')").withColumn("_block", F.floor(F.col("idx") / block).cast("bigint"))
    number = F.when(F.col("cmd") == "DEL", F.lit(0).cast("bigint")).when(F.col("value").rlike("^[+-]?[0-9]+$"), F.col("value").try_cast("bigint"))
    start = F.when(F.col("cmd") != "INCR", F.struct(number.alias("base"), F.col("idx").alias("at")))
    within = Window.partitionBy("key", "_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_start", F.last(start, ignorenulls=True).over(within)).withColumn("_n", F.sum(F.when(F.col("cmd") == "INCR", 1).otherwise(0)).over(within))
    # increments of the block up to and including its last start
    rows = rows.withColumn("_before", F.last(F.when(F.col("cmd") != "INCR", F.col("_n")), ignorenulls=True).over(within))
    ends = rows.groupBy("key", "_block").agg(F.max_by("_start", "idx").alias("_start"), F.max("_n").alias("_all"), F.max_by("_before", "idx").alias("_before"))
    over = Window.partitionBy("key").orderBy("_block")
    ends = ends.withColumn("_total", F.sum("_all").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.when(F.col("_start").isNotNull(), F.struct(F.col("_start.base").alias("base"), (F.col("_total") - F.col("_all") + F.col("_before")).alias("upto")))
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("key", "_block", F.last(held, ignorenulls=True).over(earlier).alias("_held"), F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_done"))
    rows = rows.where("cmd = 'INCR'").join(ends, ["key", "_block"])
    carried = F.when(F.col("_held").isNull(), F.col("_done")).otherwise(F.col("_held.base") + F.col("_done") - F.col("_held.upto"))
    value = F.when(F.col("_start").isNull(), carried + F.col("_n")).otherwise(F.col("_start.base") + F.col("_n") - F.col("_before"))
    return rows.select("key", "idx", value.cast("bigint").alias("value"))


def incr(log: DataFrame) -> DataFrame:
    """key, value after the last entry of a log of INCR and DEL only, without a window over each key's entries."""
    rows = log.where("key IS NOT NULL AND cmd IN ('DEL', 'INCR')")
    last = rows.where("cmd = 'DEL'").groupBy("key").agg(F.max("idx").alias("_deleted"))
    kept = rows.where("cmd = 'INCR'").join(last, "key", "left").where("_deleted IS NULL OR idx > _deleted")
    return kept.groupBy("key").agg(F.count(F.lit(1)).alias("value"))


def decayed_frequency(frequency: Column, last_access_ms: Column, now_ms: int) -> Column:
    """A use counter less one for each whole idle minute."""
    return F.greatest(frequency - F.floor((F.lit(now_ms) - last_access_ms) / 60_000), F.lit(0)).cast("bigint")


FIRST_FREQUENCY, LOG_FACTOR, MOST_FREQUENCY = 5, 10, 255


def chance(key: Column, idx: Column, seed: int) -> Column:
    """A number from 0 to 1 (exclusive) for each access, the same each time."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key, idx.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def use_counters(accesses: DataFrame, seed: int = 0) -> DataFrame:
    """key, last_access_ms, frequency of each key after ``accesses`` (idx, ts_ms, key): a slowly growing use counter.

    A counter starts at 5 with the first access.  Each later one first takes off one for every whole idle minute,
    then adds one with the chance 1 / (10 frequency + 1), up to 255.  The accesses of a key are a fold in the order
    of idx, with one row of state.  Rows with a null are left out.
    """
    rows = accesses.select("idx", "ts_ms", "key").dropna().withColumn("p", chance(F.col("key"), F.col("idx"), seed))

    def fold(batches):
        at, last, frequency = None, 0, 0
        for batch in batches:
            out = []
            for key, now, p in zip(batch["key"], batch["ts_ms"].tolist(), batch["p"].tolist()):
                if key != at:
                    if at is not None:
                        out.append((at, last, frequency))
                    at, last, frequency = key, now, FIRST_FREQUENCY
                    continue
                frequency = max(frequency - max((now - last) // 60_000, 0), 0)
                last = now
                if frequency < MOST_FREQUENCY and p < 1 / (frequency * LOG_FACTOR + 1):
                    frequency += 1
            yield pd.DataFrame(out, columns=["key", "last_access_ms", "frequency"])
        if at is not None:
            yield pd.DataFrame([(at, last, frequency)], columns=["key", "last_access_ms", "frequency"])

    return rows.repartition("key").sortWithinPartitions("key", "idx").mapInPandas(fold, "key STRING, last_access_ms BIGINT, frequency BIGINT")


def evict(state: DataFrame, keep: int, policy: str, now_ms: int = 0, seed: int = 0) -> DataFrame:
    """The state cut down to ``keep`` keys: 'lru' drops the longest unused, 'lfu' the least used, 'arbitrary' any.

    Ties go by key, so that the result is the same each time.  The state needs last_access_ms for 'lru', and
    frequency besides for 'lfu'.
    """
    order = {
        "lru": lambda: [F.desc("last_access_ms"), F.col("key")],
        "lfu": lambda: [decayed_frequency(F.col("frequency"), F.col("last_access_ms"), now_ms).desc(), F.col("key")],
        "arbitrary": lambda: [F.xxhash64(F.lit(seed), "key"), F.col("key")],
    }[policy]()
    ranked = spread_rank(state.withColumn("_all", F.lit(0)), ["_all"], order, "_rank")  # no task sorts all keys
    return ranked.where(F.col("_rank") < keep).select(*state.columns)
