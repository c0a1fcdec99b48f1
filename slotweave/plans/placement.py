"""Which shard owns which slot: the ring, bounded assignment, plans of moves, topology changes and routing.

The ring and the assignment are of the size of the slot table, 16,384 rows, whatever the data, and are made on the
driver; everything that touches keys is a DataFrame expression.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotweave.functions.hashing import fnv1a64
from slotweave.functions.keyspace import SLOTS, hash_slot
from slotweave.workspace import materialize

VNODES, EPSILON, BATCH = 160, 0.05, 512


class Ring:
    """Points of each shard on a circle of 64-bit hashes."""

    def __init__(self, shards: list[str], vnodes: int = VNODES, epsilon: float = EPSILON):
        self.shards, self.epsilon = sorted(set(shards)), epsilon
        self.points = sorted((fnv1a64(f"{shard}#{i}".encode()), shard) for shard in self.shards for i in range(vnodes))
        self._hashes = [h for h, _ in self.points]

    def _start(self, slot: int) -> int:
        return bisect_left(self._hashes, fnv1a64(slot.to_bytes(8, "little"))) % len(self.points)

    def lookup(self, slot: int) -> str:
        """The shard of the first point at or behind the slot's hash; '' on an empty ring."""
        return self.points[self._start(slot)][1] if self.points else ""

    def assign(self, slots: int = SLOTS) -> list[str]:
        """An owner for each slot: in the order of their hashes, the next shard on the ring that is not full."""
        if not self.points:
            return [""] * slots
        most = max(1, math.ceil(slots / len(self.shards) * (1 + self.epsilon)))
        owners, load = [""] * slots, dict.fromkeys(self.shards, 0)
        for _, slot in sorted((fnv1a64(s.to_bytes(8, "little")), s) for s in range(slots)):
            start = self._start(slot)
            turn = (self.points[(start + i) % len(self.points)][1] for i in range(len(self.points)))
            owner = next((s for s in turn if load[s] < most), self.points[start][1])
            owners[slot] = owner
            load[owner] += 1
        return owners


def owners_frame(spark: SparkSession, owners: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(owners)), "slot INT, shard STRING")


def small(slots: DataFrame, slot_count: int) -> DataFrame:
    """A slot table to be broadcast: an error if it has more rows than there are slots."""
    rows = materialize(slots, "slot-table")
    if (n := rows.count()) > slot_count:
        raise ValueError(f"a table of {slot_count} slots has {n} rows")
    return F.broadcast(rows)


def ring_lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS, vnodes: int = VNODES) -> DataFrame:
    ring = Ring(shards, vnodes)
    return owners_frame(spark, [ring.lookup(s) for s in range(slots)])


def slot_counts(shards: DataFrame, slots: DataFrame) -> DataFrame:
    """shard, slots: how many slots each shard owns, 0 too."""
    counted = slots.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    return shards.select("shard").distinct().join(counted, "shard", "left").select("shard", F.coalesce("_n", F.lit(0)).cast("bigint").alias("slots"))


def settled(migrations: DataFrame) -> None:
    """Refuse to plan while slots are still migrating."""
    if n := migrations.select("slot").distinct().count():
        raise ValueError(f"{n} slots are still migrating; plan again once they have settled")


def plan_moves(old: DataFrame, new: DataFrame, migrations: DataFrame | None = None) -> DataFrame:
    """slot, from, to for each slot whose owner changes; an error if ``migrations`` holds a marker."""
    if migrations is not None:
        settled(migrations)
    pairs = old.select("slot", F.col("shard").alias("from")).join(new.select("slot", F.col("shard").alias("to")), "slot")
    return pairs.where(~F.col("from").eqNullSafe(F.col("to")))


def batch_moves(moves: DataFrame, size: int = BATCH) -> DataFrame:
    """from, to, batch, slots: the moves of each pair of shards in lists of at most ``size`` slots."""
    order = Window.partitionBy("from", "to").orderBy("slot")
    rows = moves.withColumn("batch", F.expr(f"(row_number() over (partition by `from`, `to` order by slot) - 1) div {size}")) if size > 0 else moves.withColumn("batch", F.row_number().over(order))
    return rows.groupBy("from", "to", "batch").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def add_shard(shards: DataFrame, new: DataFrame) -> DataFrame:
    """The shards (shard, node, address) with those of ``new`` that have a member and are not there yet."""
    valid = new.where("shard <> '' AND node IS NOT NULL").join(shards.select("shard").distinct(), "shard", "left_anti")
    return shards.unionByName(valid.select(*shards.columns))


def remove_shard(shards: DataFrame, gone: DataFrame) -> DataFrame:
    return shards.join(gone.select("shard").distinct(), "shard", "left_anti")


def retire_shards(shards: DataFrame, slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shards without those that are neither wanted nor own a slot."""
    kept = wanted.select("shard").union(slots.where("shard <> ''").select("shard")).distinct()
    return shards.join(kept, "shard", "left_semi")


def with_owners(slots: DataFrame, changes: DataFrame) -> DataFrame:
    """The slot table with the owners of ``changes``, one row per slot."""
    new = changes.groupBy("slot").agg(F.max("shard").alias("_new"))
    return slots.join(new, "slot", "full").select("slot", F.coalesce("_new", "shard").alias("shard"))


def with_migrations(migrations: DataFrame, changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Markers (slot, from, to, state) with those of ``changes`` put in or replaced; ``keys`` names a slot, 'slot' alone by default."""
    keys = keys or ["slot"]
    return migrations.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.select(*migrations.columns))


def validate(slots: DataFrame, shards: DataFrame) -> DataFrame:
    """slot, problem: slots without an owner, or with one that is no shard with a member; empty if all is well."""
    known = shards.where("node IS NOT NULL").select("shard").distinct().withColumn("_known", F.lit(True))
    problem = F.when(F.coalesce(F.col("shard"), F.lit("")) == "", "no owner").when(F.col("_known").isNull(), "unknown owner")
    return slots.join(known, "shard", "left").select("slot", problem.alias("problem")).where("problem IS NOT NULL")


def install(current: DataFrame, offered: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The newest document of each key; an offered one must be newer to replace the current one."""
    rows = current.withColumn("_mine", F.lit(1)).unionByName(offered.withColumn("_mine", F.lit(0)))
    columns = F.struct(*current.columns)
    return rows.groupBy(key).agg(F.max_by(columns, F.struct(version, "_mine")).alias("_doc")).select("_doc.*")


def update(current: DataFrame, offered: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The current documents with those of ``offered`` in place, each newer than the one it replaces.

    An offered document that isn't newer gets the current version plus one, so that every change is seen as one.
    Of several offered documents of one key the newest counts.
    """
    newest = offered.groupBy(key).agg(F.max_by(F.struct(*current.columns), version).alias("_doc")).select("_doc.*")
    held = current.select(F.col(key).alias("_key"), F.col(version).alias("_held"))
    bumped = newest.join(held, F.col(key) == F.col("_key"), "left").withColumn(version, F.greatest(F.col(version), F.col("_held") + 1)).select(*current.columns)
    return current.join(newest.select(key), key, "left_anti").unionByName(bumped)


def routing_key(args: Column) -> Column:
    """The first argument of key, channel, pattern, member and id that is not empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(args, F.lit(name)), F.lit("")) for name in ("key", "channel", "pattern", "member", "id")))


def route(commands: DataFrame, slots: DataFrame, migrations: DataFrame, writes: list[str], slot_count: int = SLOTS) -> DataFrame:
    """The commands (cmd, args) with slot, shard and decision.

    A command without a key goes to the lowest shard, with slot -1; a write to a slot that is migrating is refused
    until later.  The slot table is joined by slot, not by key, so it has at most ``slot_count`` rows.
    """
    lowest = slots.agg(F.min("shard").alias("_lowest"))
    marked = slots.join(migrations.select("slot", F.lit(True).alias("_moving")).distinct(), "slot", "left")
    rows = commands.withColumn("_key", routing_key(F.col("args")))
    rows = rows.withColumn("slot", F.when(F.col("_key").isNull(), -1).otherwise(hash_slot(F.col("_key"), slot_count)).cast("int"))
    rows = rows.join(small(marked, slot_count), "slot", "left").join(F.broadcast(lowest))  # and one row
    decision = F.when((F.col("slot") >= 0) & F.col("_moving") & F.col("cmd").isin(writes), "retry").when(F.col("shard").isNull() & (F.col("slot") >= 0), "no owner").otherwise("serve")
    return rows.withColumn("decision", decision).withColumn("shard", F.when(F.col("slot") < 0, F.col("_lowest")).otherwise(F.col("shard"))).drop("_key", "_moving", "_lowest")


def order_candidates(members: DataFrame, preferred: str, own: str) -> DataFrame:
    """shard, candidates: the other members of each shard in the order to try them, the preferred one first."""
    rank = F.when(F.col("node") == preferred, 0).otherwise(1)
    return members.where(F.col("node") != own).groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "node"))), lambda x: x["node"]).alias("candidates"))


def parse_shards(text: str) -> list[tuple[str, str, str]]:
    """(shard, node, address) of a description 'id:node=url,node=url;id:...'."""
    rows = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        shard, colon, members = part.partition(":")
        if not colon or not shard.strip():
            raise ValueError(f"bad shard {part!r}")
        for member in filter(None, (m.strip() for m in members.split(","))):
            node, equals, address = member.partition("=")
            if not equals or not node.strip():
                raise ValueError(f"bad member {member!r}")
            rows.append((shard.strip(), node.strip(), address.strip()))
    return rows


def rebalance_report(old: DataFrame, new: DataFrame, keys: DataFrame, dry_run: bool = True, max_slots: int | None = None) -> DataFrame:
    """One row: planned moves, slots moved, keys (rows with slot) that move, owners before and after."""
    moves = plan_moves(old, new)
    if max_slots is not None:
        moves = moves.orderBy("from", "slot").limit(max_slots)
    counts = lambda df: df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("shard", "n")))).alias("m"))
    after = old if dry_run else with_owners(old, moves.select("slot", F.col("to").alias("shard")))
    moved = keys.select(F.col("slot").cast("int").alias("slot")).join(moves.select("slot"), "slot", "left_semi").agg(F.count(F.lit(1)).alias("keys_moved"))
    planned = moves.agg(F.count(F.lit(1)).alias("planned_moves"))
    return planned.join(moved).join(counts(old).withColumnRenamed("m", "slots_before")).join(counts(after).withColumnRenamed("m", "slots_after")).withColumn("dry_run", F.lit(dry_run))
