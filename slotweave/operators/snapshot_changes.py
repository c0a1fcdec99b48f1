"""What changed between consecutive full snapshots.

Identical rows are removed by EXCEPT ALL in both directions; the few rows left over on either side are joined by
key with a full join, which labels them added, removed or changed.

Both directions come from one aggregate: a row of the old side counts +1 and one of the new side -1, and the sum
over equal rows says how often the row is left over, and where.  ``DataFrame.exceptAll`` is rewritten to the same
sum, once for each direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.operators.neighbours import with_neighbours
from slotweave.workspace import materialize

BLOCK = 16  # neighbouring slots that are compared as one row before single slots are


def residues(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """old EXCEPT ALL new, and new EXCEPT ALL old: rows without an equal row on the other side, repeated rows too.

    Null equals null.  The residues are written to the shared folder, so that both sides are computed once.
    """
    signed = old.withColumn("_copies", F.lit(1)).union(new.select(*old.columns).withColumn("_copies", F.lit(-1)))
    left = materialize(signed.groupBy(*old.columns).agg(F.sum("_copies").alias("_copies")).where("_copies <> 0"), "residues")

    def side(sign: int) -> DataFrame:
        rows = left.where(F.col("_copies") * sign > 0)
        return rows.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_copies")))).drop("_copies")

    return side(1), side(-1)


def label_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` and ``change`` ('added', 'removed', 'changed') of each record that differs.

    ``old`` and ``new`` hold the columns ``keys`` and ``value``, each key once.  Null equals null in a value.
    A row with a null in its key pairs with the row that has the same nulls.  Two empty tables give no row.
    """
    gone, came = residues(old.select(*keys, value), new.select(*keys, value))
    gone, came = gone.withColumn("_old", F.lit(True)).drop(value), came.withColumn("_new", F.lit(True)).drop(value)
    a, b = gone.alias("a"), came.alias("b")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return a.join(b, same, "full").select(*(F.coalesce(f"a.{key}", f"b.{key}").alias(key) for key in keys), change.alias("change"))


def _digest(*columns) -> list:
    """Two independent 64-bit hashes, which stand for the columns in comparisons."""
    return [F.xxhash64(F.lit(seed), *columns).alias(f"hash{seed}") for seed in (1, 2)]


def _signed(rows: DataFrame) -> DataFrame:
    """Each row as part of the older (+1) and of the newer (-1) snapshot of a pair, from one scan."""
    older = F.struct(F.when(F.col("newer").isNotNull(), F.col("own")).alias("pair"), F.lit(1).alias("sign"))
    newer = F.struct(F.col("older").alias("pair"), F.lit(-1).alias("sign"))
    kept = [c for c in rows.columns if c not in ("own", "older", "newer")]
    return rows.select(*kept, F.inline(F.array(older, newer))).where("pair IS NOT NULL")


def _left_over(signed: DataFrame, keys: list[str]) -> DataFrame:
    """The residues of EXCEPT ALL in both directions, as one signed sum over equal rows."""
    return signed.groupBy(*keys).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def _labels(residues: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``change`` by a full join of the two residues; a key occurs at most once on a side."""
    gone = residues.where("sign > 0").select(*keys, F.lit(True).alias("_old"))
    came = residues.where("sign < 0").select(*keys, F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return gone.join(came, keys, "full").select(*keys, change.alias("change"))


def topology_changes(deliveries: DataFrame) -> DataFrame:
    """cluster_id, from_version, to_version, record, item, change between neighbouring versions of each cluster.

    A delivery counts as a snapshot if ``slots`` has exactly ``slot_count`` elements; deliveries with null slots,
    cluster, version or id do not.  Of several snapshots of one version the one with the lowest delivery_id counts.
    An empty or null owner means that the slot's record is absent; a shard's value is its set of members and
    addresses, and null members are an empty set.  Rows of one delivery that repeat count once.

    A pair of snapshots goes by the number of its older one.  Slots are first compared in blocks of 16 by 128-bit
    hashes: EXCEPT ALL drops equal blocks, so that only the slots of unequal blocks become rows of their own.  Values
    are hashes, too, so that every row that is shuffled and grouped is a few integers; names come back at the end.
    """
    whole = deliveries.where((F.size("slots") == F.col("slot_count")) & F.col("cluster_id").isNotNull() & F.col("version").isNotNull() & F.col("delivery_id").isNotNull())
    key = ["cluster_id", "version", "delivery_id"]
    chosen = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).groupBy("cluster_id", "version").agg(F.min("delivery_id").alias("delivery_id"), F.min_by("copies", "delivery_id").alias("copies"))
    chosen = materialize(chosen.withColumn("own", F.monotonically_increasing_id()), "snapshot-ids")
    at = lambda side, id_: chosen.select("cluster_id", F.col("version").alias(side), F.col("own").alias(id_))
    pairs = chosen.join(with_neighbours(chosen, ["cluster_id"], "version"), ["cluster_id", "version"])
    pairs = materialize(pairs.join(at("previous", "older"), ["cluster_id", "previous"], "left").join(at("next", "newer"), ["cluster_id", "next"], "left"), "snapshot-pairs")

    owners = F.transform("slots", lambda owner: F.coalesce(owner, F.lit(""))).alias("owners")
    used = pairs.where("older IS NOT NULL OR newer IS NOT NULL").select(*key, "own", "older", "newer")
    snapshots = whole.select(*key, owners, "shards").join(used, key).drop(*key)
    if not pairs.where("copies > 1").isEmpty():  # rows of one delivery
        snapshots = snapshots.dropDuplicates(["own"])
    snapshots = materialize(snapshots, "snapshots")

    starts = F.sequence(F.lit(0), F.greatest(F.size("owners") - 1, F.lit(0)).cast("int"), F.lit(BLOCK))
    blocks = snapshots.select("own", "older", "newer", "owners", F.explode(starts).alias("start"))
    blocks = blocks.select("own", "older", "newer", "start", *_digest(F.slice("owners", F.col("start") + 1, BLOCK)))
    unequal = _left_over(_signed(blocks), ["pair", "start", "hash1", "hash2"]).select("pair", "start", F.signum("sign").cast("int").alias("sign"))
    # the blocks of a side that are left over, as one row for each of its snapshots
    ids = unequal.join(pairs.select(F.col("own").alias("pair"), "newer"), "pair")
    lists = ids.groupBy(F.when(F.col("sign") > 0, F.col("pair")).otherwise(F.col("newer")).alias("own")).agg(F.collect_list(F.struct("pair", "sign", "start")).alias("blocks"))
    # never broadcast: a list may grow to a sixteenth of its snapshot
    slots = snapshots.select("own", "owners").join(lists.hint("shuffle_hash"), "own").select("owners", F.inline("blocks"))
    slots = slots.select("pair", "sign", "start", F.posexplode(F.slice("owners", F.col("start") + 1, BLOCK)).alias("at", "owner")).where("owner <> ''")
    slots = slots.select("pair", "sign", (F.col("start") + F.col("at")).alias("item"), *_digest(F.col("owner")))
    slot_residues = materialize(_left_over(slots, ["pair", "item", "hash1", "hash2"]), "slot-residues")
    changed_slots = _labels(slot_residues, ["pair", "item"]).select("pair", F.lit("slot").alias("record"), F.col("item").cast("string").alias("item"), "change")

    entries = snapshots.select("own", "older", "newer", F.explode("shards").alias("item", "shard"))
    entries = entries.select("own", "older", "newer", "item", *_digest(F.coalesce(F.to_json(F.array_sort(F.map_entries("shard.members"))), F.lit("[]"))))
    shard_residues = materialize(_left_over(_signed(entries), ["pair", "item", "hash1", "hash2"]), "shard-residues")
    changed_shards = _labels(shard_residues, ["pair", "item"]).select("pair", F.lit("shard").alias("record"), "item", "change")

    names = pairs.select(F.col("own").alias("pair"), "cluster_id", F.col("version").alias("from_version"), F.col("next").alias("to_version"))
    return changed_slots.unionByName(changed_shards).join(names, "pair").select("cluster_id", "from_version", "to_version", "record", "item", "change")
