"""What can be told from replicated logs: commit indexes, quorums, where copies part, and checks of safety."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quorum(n: int) -> int:
    return n // 2 + 1


def commit_index(progress: DataFrame, log: DataFrame) -> DataFrame:
    """shard, commit_index: the highest index that a majority of voters holds and whose entry is of the current term.

    ``progress``: shard, node, is_voter, match_index, current_term.  A shard without such an entry has none.
    """
    voters = progress.where("is_voter AND match_index IS NOT NULL")
    held = voters.groupBy("shard").agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("held"), F.max("current_term").alias("term"))  # an element per voter
    held = held.select("shard", "term", F.expr("held[cast(size(held) div 2 as int)]").alias("most"))
    entries = log.join(held, "shard").where("idx <= most AND log_term = term") if "log_term" in log.columns else log.withColumnRenamed("term", "log_term").join(held, "shard").where("idx <= most AND log_term = term")
    return entries.groupBy("shard").agg(F.max("idx").alias("commit_index"))


def lease_held(progress: DataFrame, now: str, timeout_ms: int) -> DataFrame:
    """shard, held: whether acknowledgements fresher than the timeout, the leader's own included, make a quorum."""
    fresh = F.count_if((F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis("last_ack")) < timeout_ms)
    return progress.where("is_voter").groupBy("shard").agg((fresh + 1 >= F.expr("(count(1) + 1) div 2 + 1")).alias("held"))


def first_divergence(left: DataFrame, right: DataFrame) -> DataFrame:
    """shard, idx: the first index at which two logs hold entries of different terms, or only one holds an entry below the end of the other."""
    a = left.groupBy("shard", "idx").agg(F.max("term").alias("a"))
    b = right.groupBy("shard", "idx").agg(F.max("term").alias("b"))
    differs = a.join(b, ["shard", "idx"], "full").where("NOT a <=> b")
    return differs.groupBy("shard").agg(F.min("idx").alias("idx"))


def merge_entries(log: DataFrame, offered: DataFrame, previous: DataFrame) -> DataFrame:
    """The logs after each shard's ``offered`` entries have been appended behind ``previous`` (shard, prev_idx, prev_term).

    An append is refused, and the log stays as it is, if the log has no entry at prev_idx or one of another term.
    Entries that both hold, by idx and term, stay; from the first offered one that the log lacks or holds with
    another term on, the log's own entries are dropped and the offered ones take their place.  A prev_idx below 0
    fits every log.  Both logs hold each (shard, idx) once; columns are those of ``log``.
    """
    at = log.select("shard", F.col("idx").alias("prev_idx"), F.col("term").alias("_term"))
    fits = previous.join(at, ["shard", "prev_idx"], "left").where((F.col("prev_idx") < 0) | (F.col("_term") == F.col("prev_term"))).select("shard", "prev_idx")
    new = offered.join(fits, "shard").where("idx > prev_idx").drop("prev_idx")
    held = log.select("shard", "idx", F.col("term").alias("_held"))
    cut = new.join(held, ["shard", "idx"], "left").where("_held IS NULL OR _held <> term").groupBy("shard").agg(F.min("idx").alias("_cut"))
    kept = log.join(cut, "shard", "left").where("_cut IS NULL OR idx < _cut").drop("_cut")
    return kept.unionByName(new.join(cut, "shard").where("idx >= _cut").select(*log.columns))


def up_to_date(left: DataFrame, right: DataFrame) -> DataFrame:
    """shard, left_wins: whether the left log ends with a higher term, or the same term and an index at least as high."""
    end = lambda df, name: df.groupBy("shard").agg(F.max(F.struct("term", "idx")).alias(name))
    return end(left, "a").join(end(right, "b"), "shard").select("shard", (F.col("a") >= F.col("b")).alias("left_wins"))


def terms_with_two_leaders(status: DataFrame) -> DataFrame:
    """shard, term, leaders: terms for which more than one leader was reported; empty if all is well."""
    rows = status.where("role = 'leader' AND node_id IS NOT NULL")
    return rows.groupBy(F.col("shard_id").alias("shard"), "term").agg(F.countDistinct("node_id").alias("leaders")).where("leaders > 1")


def replication_lag(status: DataFrame) -> DataFrame:
    """shard, node, lag: how far each node's highest commit index is behind the shard's highest."""
    own = status.where("commit_index IS NOT NULL AND node_id IS NOT NULL").groupBy(F.col("shard_id").alias("shard"), F.col("node_id").alias("node")).agg(F.max("commit_index").alias("at"))
    return own.select("shard", "node", (F.max("at").over(Window.partitionBy("shard")) - F.col("at")).alias("lag"))


def read_at(log: DataFrame, index: int) -> DataFrame:
    """The entries up to a read index."""
    return log.where(F.col("idx") <= index)


def entries(log: DataFrame, low: int, high: int) -> DataFrame:
    """The entries low..high, each (shard, idx) once: that with the highest term."""
    rest = [c for c in log.columns if c not in ("shard", "idx")]
    rows = log.where(F.col("idx").between(low, high))
    return rows.groupBy("shard", "idx").agg(F.max_by(F.struct(*rest), "term").alias("_e")).select("shard", "idx", "_e.*")


def last_entry(log: DataFrame) -> DataFrame:
    """shard, idx, term of the last entry."""
    return log.groupBy("shard").agg(F.max(F.struct("idx", "term")).alias("e")).select("shard", "e.idx", "e.term")


def latest_configuration(log: DataFrame) -> DataFrame:
    """shard, idx, voters, learners: the last configuration entry of each log, whatever later entries do."""
    rows = log.where("cmd = '__raft_conf__' AND data IS NOT NULL")
    parsed = rows.select("shard", "idx", "term", F.from_json(F.col("data").cast("string"), "voters MAP<STRING,STRING>, learners MAP<STRING,STRING>").alias("c")).where("c.voters IS NOT NULL")
    last = parsed.groupBy("shard").agg(F.max_by(F.struct("idx", "c"), F.struct("idx", "term")).alias("l"))
    keys = lambda m: F.sort_array(F.map_keys(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return last.select("shard", "l.idx", keys(F.col("l.c.voters")).alias("voters"), keys(F.col("l.c.learners")).alias("learners"))


def unsafe_steps(log: DataFrame) -> DataFrame:
    """shard, idx, changed: configuration entries that add or remove more than one voter at once."""
    rows = log.where("cmd = '__raft_conf__' AND data IS NOT NULL")
    parsed = rows.select("shard", "idx", F.map_keys(F.from_json(F.col("data").cast("string"), "voters MAP<STRING,STRING>")["voters"]).alias("voters")).where("voters IS NOT NULL").dropDuplicates(["shard", "idx"])
    before = F.lag("voters").over(Window.partitionBy("shard").orderBy("idx"))  # configuration entries only
    changed = F.size(F.array_except("voters", "before")) + F.size(F.array_except("before", "voters"))
    return parsed.withColumn("before", before).where("before IS NOT NULL").select("shard", "idx", changed.cast("bigint").alias("changed")).where("changed > 1")
