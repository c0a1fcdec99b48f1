"""What the shards of a cluster look like from the probes of its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_probes(probes: DataFrame) -> DataFrame:
    """The last reachable probe of each node; a probe received again counts once."""
    rows = probes.where("reachable AND node_id IS NOT NULL AND probed_at IS NOT NULL")
    return rows.groupBy("node_id").agg(F.max_by(F.struct("probed_at", "local", "error", "shards"), F.struct("probed_at", "probe_id")).alias("p")).select("node_id", "p.*")


def reported_shards(latest: DataFrame) -> DataFrame:
    """node_id and the fields of each shard that the node reports; null elements are none."""
    return latest.select("node_id", "probed_at", F.explode("shards").alias("s")).where("s IS NOT NULL AND s.shard_id IS NOT NULL").select("node_id", "probed_at", "s.*")


def shard_views(members: DataFrame, slots: DataFrame, reported: DataFrame, slot_count: int) -> DataFrame:
    """shard, slots, share, members, healthy, term, leader for ``members`` (shard, node) of a topology.

    A member is healthy if it reports the shard; the term is the highest reported, and the leader that of the last
    member in order that names one.
    """
    counted = slots.groupBy("shard").agg(F.count(F.lit(1)).alias("slots"))
    seen = reported.select(F.col("shard_id").alias("shard"), F.col("node_id").alias("node"), "term", "leader_id", F.lit(1).alias("_seen")).dropDuplicates(["shard", "node"])
    joined = members.select("shard", "node").join(seen, ["shard", "node"], "left")
    leader = F.max_by("leader_id", F.when(F.col("leader_id") != "", F.col("node")))
    views = joined.groupBy("shard").agg(F.count(F.lit(1)).alias("members"), F.count("_seen").alias("healthy"), F.coalesce(F.max("term"), F.lit(0)).alias("term"), leader.alias("leader"))
    return views.join(counted, "shard", "left").withColumn("slots", F.coalesce("slots", F.lit(0)).cast("bigint")).withColumn("share", F.col("slots") / F.lit(float(slot_count)))


def roll_up(views: DataFrame) -> DataFrame:
    """One row over all shards: with a leader, with a quorum, healthy members, and the spread of slots."""
    return views.agg(
        F.count(F.lit(1)).alias("shards"),
        F.count_if(F.coalesce(F.col("leader"), F.lit("")) != "").alias("with_leader"),
        F.count_if(F.col("healthy") > F.expr("members div 2")).alias("with_quorum"),
        F.sum("healthy").alias("healthy"),
        (F.max("slots") - F.min("slots")).alias("spread"),
    )


def node_addresses(sources: DataFrame) -> DataFrame:
    """node, address from rows (node, address, ord): of several addresses the last counts."""
    return sources.where("node IS NOT NULL").groupBy("node").agg(F.max_by("address", "ord").alias("address"))


def shards_for_node(members: DataFrame, node: str) -> DataFrame:
    return members.where(F.col("node") == node).select("shard").distinct()


def next_step(current: DataFrame, desired: DataFrame) -> DataFrame:
    """shard, step, node: the one membership change that brings each shard nearer to what is desired, if any is due.

    ``current`` (shard, node, voter) and ``desired`` (shard, node).  First a missing node is added as a learner; then
    all wait until every desired node votes; then learners that are not desired are dropped, and at last voters
    removed one by one, never the last.
    """
    want = desired.select("shard", "node").distinct().withColumn("want", F.lit(True))
    have = current.groupBy("shard", "node").agg(F.max("voter").alias("voter"))
    rows = have.join(want, ["shard", "node"], "full")
    missing = F.col("want") & F.col("voter").isNull()
    waiting = F.col("want") & ~F.coalesce("voter", F.lit(False))
    extra = F.col("want").isNull()
    step = rows.groupBy("shard").agg(
        F.min(F.when(missing, F.col("node"))).alias("add"),
        F.count_if(waiting).alias("waiting"),
        F.min(F.when(extra & ~F.col("voter"), F.col("node"))).alias("drop"),
        F.min(F.when(extra & F.col("voter"), F.col("node"))).alias("remove"),
        F.count_if(F.coalesce("voter", F.lit(False))).alias("voters"),
    )
    name = F.when(F.col("add").isNotNull(), "add learner").when(F.col("waiting") > 0, None).when(F.col("drop").isNotNull(), "drop learner").when(F.col("remove").isNotNull() & (F.col("voters") > 1), "remove voter")
    node = F.when(F.col("add").isNotNull(), F.col("add")).when(F.col("drop").isNotNull(), F.col("drop")).otherwise(F.col("remove"))
    return step.select("shard", name.alias("step"), node.alias("node")).where("step IS NOT NULL")


def reconcile(desired: DataFrame, running: DataFrame) -> DataFrame:
    """shard, action: groups to start and groups to retire."""
    start = desired.select("shard").distinct().join(running.select("shard"), "shard", "left_anti").withColumn("action", F.lit("start"))
    return start.unionByName(running.select("shard").distinct().join(desired.select("shard"), "shard", "left_anti").withColumn("action", F.lit("retire")))
