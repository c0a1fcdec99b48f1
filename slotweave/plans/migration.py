"""Moving a batch of slots from one shard to another: mark, dump, restore, flip, delete; or give up."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions.keyspace import SLOTS
from slotweave.operators import slots as slot_state
from slotweave.plans.placement import with_migrations, with_owners
from slotweave.workspace import materialize

STEPS = ("mark", "dump", "restore", "flip", "delete")


@dataclass(frozen=True)
class Cluster:
    """A topology's version, its slot table (slot, shard) and markers (slot, from, to, state), and each shard's stores."""

    version: int
    owners: DataFrame
    migrations: DataFrame
    states: dict[str, dict[str, DataFrame]]


@dataclass(frozen=True)
class Moved:
    slots: list[int]
    source: str
    target: str
    keys: int
    skipped: list[str]
    error: str = ""


def _frame(cluster: Cluster, slots: list[int], **columns: str) -> DataFrame:
    rows = cluster.owners.sparkSession.createDataFrame([(s,) for s in slots], "slot INT")
    return rows.select("slot", *(F.lit(value).alias(name) for name, value in columns.items()))


def abandon(cluster: Cluster, slots: list[int]) -> Cluster:
    """Give up: the slots keep their owners and lose their markers; the version rises, so that all hear of it."""
    gone = _frame(cluster, slots)
    return replace(cluster, version=cluster.version + 1, migrations=cluster.migrations.join(gone, "slot", "left_anti"))


def migrate(cluster: Cluster, source: str, target: str, slots: list[int], now_ms: int, slot_count: int = SLOTS, fail: str = "") -> tuple[Cluster, Moved]:
    """The cluster after the batch has moved, and a report of it.

    Each step that changes the topology raises its version.  ``fail`` names a step that goes wrong: before the flip
    the migration is abandoned and the source keeps its keys; a failed delete leaves the slots moved and the keys
    on both sides.  Keys of stores that can't be dumped are named in the report and stay behind until the delete.
    """
    if fail and fail not in STEPS:
        raise ValueError(f"unknown step {fail!r}")
    report = Moved(slots, source, target, 0, [])
    if fail == "mark":
        return cluster, replace(report, error="mark failed")
    marked = replace(cluster, version=cluster.version + 1, migrations=with_migrations(cluster.migrations, _frame(cluster, slots, **{"from": source, "to": target, "state": "copying"})))
    if fail == "dump":
        return abandon(marked, slots), replace(report, error="dump failed")
    dumped = materialize(slot_state.dump(cluster.states[source], slots, now_ms, slot_count), "migration-dump")
    keys = dumped.where("store <> 'skipped'").select("store", "key").distinct().count()
    named = [f"{r['key']} ({r['type']})" for r in dumped.where("store = 'skipped'").select("key", F.get_json_object("entry", "$.type").alias("type")).orderBy("key", "type").collect()]  # sketches and limiters of the slots
    report = replace(report, keys=keys, skipped=named)
    if fail == "restore":
        return abandon(marked, slots), replace(report, error="restore failed")
    states = {**marked.states, target: slot_state.restore(marked.states[target], dumped, now_ms)}
    if fail == "flip":
        return replace(marked, states=states), replace(report, error="flip failed")
    owners = with_owners(marked.owners, _frame(cluster, slots, shard=target))
    flipped = replace(marked, version=marked.version + 1, owners=owners, migrations=marked.migrations.join(_frame(cluster, slots), "slot", "left_anti"), states=states)
    if fail == "delete":
        return flipped, replace(report, error="slots moved, but the source was not cleaned up")
    cleaned = {**states, source: slot_state.delete_slots(states[source], slots, slot_count)}
    return replace(flipped, states=cleaned), report
