"""Publish and subscribe over tables: subscriptions (sub_id, kind, topic), publishes (idx, channel, message)."""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotweave.functions.glob import glob_regex
from slotweave.workspace import materialize

MAILBOX = 128
SALTS = 8
IDLE_MS = 300_000


def replay_subscriptions(log: DataFrame) -> DataFrame:
    """The subscriptions after a log (idx, cmd, sub_id, kind, topic) of subscribe and unsubscribe; a null topic ends all of a kind."""
    rows = log.where("sub_id IS NOT NULL")
    ended = rows.where("cmd = 'unsubscribe' AND topic IS NULL").groupBy("sub_id", "kind").agg(F.max("idx").alias("_all"))
    last = rows.where("topic IS NOT NULL").groupBy("sub_id", "kind", "topic").agg(F.max(F.struct("idx", "cmd")).alias("_last"))
    kept = last.join(ended, ["sub_id", "kind"], "left").where("_last.cmd = 'subscribe' AND (_all IS NULL OR _last.idx > _all)")
    return kept.select("sub_id", "kind", "topic")


def _literal_prefix(pattern: str) -> str:
    """The text that everything a pattern matches begins with."""
    return re.match(r"[^*?\[\\]*", pattern).group()


def matching(channels: DataFrame, patterns: DataFrame) -> DataFrame:
    """channel, pattern for each distinct channel and each pattern that matches it.

    Patterns and channels are joined by the literal text that a pattern begins with, in any of the lengths that the
    patterns have, and then compared in full; a pattern that begins with a sign meets every channel.
    """

    @F.pandas_udf("prefix STRING, regex STRING")
    def parts(topics: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"prefix": topics.map(_literal_prefix), "regex": topics.map(glob_regex)})

    distinct = channels.select("channel").dropna().distinct()
    own = patterns.select(F.col("topic").alias("pattern")).dropna().distinct().withColumn("_p", parts("pattern")).select("pattern", F.length("_p.prefix").alias("length"), "_p.prefix", "_p.regex")
    own = materialize(own, "patterns")
    lengths = sorted(r["length"] for r in own.select("length").distinct().collect())  # as many as a pattern is long
    if not lengths:
        return distinct.select("channel", F.lit(None).cast("string").alias("pattern")).where(F.lit(False))
    begun = distinct.withColumn("prefix", F.explode(F.array(*(F.when(F.length("channel") >= n, F.substring("channel", 1, n)) for n in lengths)))).where("prefix IS NOT NULL")
    return begun.join(own, "prefix").where(F.expr("channel RLIKE regex")).select("channel", "pattern")


def fan_out(publishes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """idx, sub_id, kind ('message' or 'pmessage'), channel, pattern, payload: a copy for each subscription that matches."""
    publishes, subscriptions = publishes.select("idx", "channel", "message"), subscriptions.select("sub_id", "kind", "topic")
    # the publishes of a busy channel are spread over several tasks
    salted = publishes.withColumn("_salt", F.pmod(F.xxhash64("idx", "message"), F.lit(SALTS)).cast("int"))
    spread = lambda df: df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    exact = subscriptions.where("kind = 'channel'").select("sub_id", F.col("topic").alias("channel"))
    direct = salted.join(spread(exact), ["channel", "_salt"]).select("idx", "sub_id", F.lit("message").alias("kind"), "channel", F.lit(None).cast("string").alias("pattern"), F.col("message").alias("payload"))
    patterns = subscriptions.where("kind = 'pattern'")
    pairs = matching(publishes, patterns).join(patterns.select("sub_id", F.col("topic").alias("pattern")), "pattern")
    matched = salted.join(spread(pairs), ["channel", "_salt"]).select("idx", "sub_id", F.lit("pmessage").alias("kind"), "channel", "pattern", F.col("message").alias("payload"))
    return direct.unionByName(matched)


def deliveries_per_publish(publishes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """channel, publishes, deliveries: subscribers are counted per channel before they meet the publishes."""
    patterns = subscriptions.where("kind = 'pattern'").select("sub_id", F.col("topic").alias("pattern"))
    matched = matching(publishes, subscriptions.where("kind = 'pattern'")).join(patterns, "pattern").select("channel")
    exact = subscriptions.where("kind = 'channel'").select(F.col("topic").alias("channel"))
    listeners = exact.unionByName(matched).groupBy("channel").agg(F.count(F.lit(1)).alias("_n"))
    sent = publishes.groupBy("channel").agg(F.count(F.lit(1)).alias("publishes"))
    return sent.join(listeners, "channel", "left").select("channel", "publishes", (F.col("publishes") * F.coalesce("_n", F.lit(0))).cast("bigint").alias("deliveries"))


def mailboxes(deliveries: DataFrame, size: int = MAILBOX) -> DataFrame:
    """The messages a mailbox keeps, with seq from 1; those that come when it is full are dropped."""
    order = Window.partitionBy("sub_id").orderBy("idx", "kind", "channel", "pattern")
    numbered = deliveries.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= size)  # a limit per mailbox before the shuffle
    return numbered.withColumn("seq", F.col("_row").cast("bigint")).drop("_row")


def dropped(deliveries: DataFrame, size: int = MAILBOX) -> DataFrame:
    """sub_id, kept, dropped."""
    counted = deliveries.groupBy("sub_id").agg(F.count(F.lit(1)).alias("_n"))
    return counted.select("sub_id", F.least("_n", F.lit(size)).cast("bigint").alias("kept"), F.greatest(F.col("_n") - size, F.lit(0)).cast("bigint").alias("dropped"))


def poll(mailbox: DataFrame, after: int = 0, most: int = 64) -> DataFrame:
    """The next messages of each mailbox behind a seq."""
    return mailbox.where((F.col("seq") > after) & (F.col("seq") <= after + most))


MAIL = "sub_id STRING, idx BIGINT, event STRING, copy STRING, seq BIGINT, delivered BIGINT, dropped BIGINT"


def drained(deliveries: DataFrame, polls: DataFrame, size: int = MAILBOX) -> DataFrame:
    """What becomes of each copy and each poll of a mailbox that polls empty.

    ``deliveries`` as ``fan_out`` gives them, ``polls`` (idx, sub_id, most).  A row with event 'copy' has the number
    ``seq`` (from 1) under which the mailbox took the copy, null if it was full; a row with event 'poll' has how many
    messages it ``delivered``, the oldest first, and how many were ``dropped`` since the poll before.  A copy comes
    before a poll of the same idx.  The mailbox of a subscriber is a fold with two numbers of state.
    """
    sent = deliveries.select("sub_id", "idx", F.lit("copy").alias("event"), F.concat_ws("|", "kind", "channel", "pattern").alias("copy"), F.lit(0).cast("bigint").alias("most"))
    asked = polls.select("sub_id", "idx", F.lit("poll").alias("event"), F.lit("").alias("copy"), F.col("most").cast("bigint").alias("most"))
    rows = sent.unionByName(asked).dropna(subset=["sub_id", "idx", "most"])

    def fold(batches):
        at, taken, read, dropped = None, 0, 0, 0
        for batch in batches:
            out = []
            for sub_id, idx, event, copy, most in batch[["sub_id", "idx", "event", "copy", "most"]].itertuples(index=False, name=None):
                if sub_id != at:
                    at, taken, read, dropped = sub_id, 0, 0, 0
                if event == "copy":
                    if full := taken - read >= size:
                        dropped += 1
                    else:
                        taken += 1
                    out.append((sub_id, idx, event, copy, None if full else taken, None, None))
                else:
                    delivered = min(max(most, 0), taken - read)
                    read += delivered
                    out.append((sub_id, idx, event, copy, None, delivered, dropped))
                    dropped = 0
            yield pd.DataFrame(out, columns=["sub_id", "idx", "event", "copy", "seq", "delivered", "dropped"]).astype({"seq": "Int64", "delivered": "Int64", "dropped": "Int64"})

    return rows.repartition("sub_id").sortWithinPartitions("sub_id", "idx", "event", "copy").mapInPandas(fold, MAIL)


def channels(subscriptions: DataFrame) -> DataFrame:
    """kind, topic, subscribers: the channels and patterns with a subscription."""
    return subscriptions.dropna(subset=["sub_id", "topic"]).groupBy("kind", "topic").agg(F.countDistinct("sub_id").alias("subscribers"))


def reap(seen: DataFrame, now_ms: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """The subscribers (sub_id, last_seen_ms) that have been heard of within the idle time."""
    return seen.groupBy("sub_id").agg(F.max("last_seen_ms").alias("last_seen_ms")).where(F.lit(now_ms) - F.col("last_seen_ms") < idle_ms)
