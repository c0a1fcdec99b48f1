"""Flat tables from deeply nested records, in one pass.

A depth-first visitor walks each record once and emits, for every node it meets, a row (tag, root, pk, parent,
payload): the table the node belongs to, the record's id, the positions that lead to the node from the root, those
that lead to its parent, and the node's own fields as JSON.  The rows are written partitioned by tag; reading a
tag back applies that table's schema to the payload.

For typed columns the visitor is compiled from a description of the nesting into one array expression, so that the
rows never leave the JVM.  Text records whose shape drifts are walked by a Python visitor over Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions.jsontext import parse, text_of
from slotweave.workspace import fresh_path

EMITTED = "tag STRING, root BIGINT, pk ARRAY<INT>, parent ARRAY<INT>, payload STRING"
_ARROW = pa.schema([("tag", pa.string()), ("root", pa.int64()), ("pk", pa.list_(pa.int32())), ("parent", pa.list_(pa.int32())), ("payload", pa.string())])


@dataclass(frozen=True)
class Node:
    """An array in a record: its table, where it lies in its parent, the fields to keep, and the arrays in it.

    ``fields`` maps names in the payload to fields of the element; None keeps the element itself as 'value'.
    With ``emit`` false the node is only walked through.
    """

    tag: str
    source: str
    fields: tuple[tuple[str, str], ...] | None = None
    children: tuple["Node", ...] = field(default=())
    emit: bool = True


def _visit(node: Node, array: Column, above: Column) -> Column:
    def element(x: Column, i: Column) -> Column:
        here = F.concat(above, F.array(i.cast("int")))
        if node.fields is None:
            payload = F.struct(x.alias("value"))
        else:
            payload = F.struct(*(x[source].alias(name) for name, source in node.fields))
        rows = []
        if node.emit:
            rows.append(F.array(F.struct(F.lit(node.tag).alias("tag"), here.alias("pk"), above.alias("parent"), F.to_json(payload).alias("payload"))))
        rows += [_visit(child, x[child.source], here) for child in node.children]
        return F.when(x.isNotNull(), rows[0] if len(rows) == 1 else F.concat(*rows))

    nothing = F.array().cast("array<struct<tag:string,pk:array<int>,parent:array<int>,payload:string>>")
    return F.coalesce(F.flatten(F.filter(F.transform(array, element), lambda rows: rows.isNotNull())), nothing)


def emit_typed(df: DataFrame, root: str, nodes: list[Node]) -> DataFrame:
    """The tagged rows of typed nested columns.

    Null arrays and null elements give no row, but a null element keeps its position.  Records with a null root id
    are left out, as their rows could not point to a parent.  Records delivered again are emitted again.
    """
    top = F.array().cast("array<int>")
    visits = [_visit(node, F.col(node.source), top) for node in nodes]
    rows = visits[0] if len(visits) == 1 else F.concat(*visits)
    return df.where(F.col(root).isNotNull()).select(F.col(root).cast("bigint").alias("root"), F.inline(rows)).select("tag", "root", "pk", "parent", "payload")


Visitor = Callable[[str], Iterator[tuple[str, tuple[int, ...], object]]]


def emit_text(df: DataFrame, root: str, body: str, visitor: Visitor) -> DataFrame:
    """The tagged rows of text records; ``visitor`` yields (tag, positions, fields) in depth-first order.

    Null bodies and null root ids give no row.
    """

    def run(batches):
        for batch in batches:
            tags, roots, keys, parents, payloads = [], [], [], [], []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at is None or text is None:
                    continue
                for tag, pk, fields in visitor(text):
                    tags.append(tag)
                    roots.append(at)
                    keys.append(pk)
                    parents.append(pk[:-1])
                    payloads.append(json.dumps(fields, ensure_ascii=False))
            if tags:
                yield pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), pa.array(roots, pa.int64()), pa.array(keys, _ARROW.field("pk").type), pa.array(parents, _ARROW.field("parent").type), pa.array(payloads, pa.string())], schema=_ARROW)

    return df.select(F.col(root).cast("bigint").alias("root"), F.col(body).alias("body")).mapInArrow(run, EMITTED)


@dataclass(frozen=True)
class Emission:
    """Tagged rows that were written once; each table is a scan of its own partition."""

    path: str
    df: DataFrame

    def table(self, tag: str, schema: str) -> DataFrame:
        """root, pk, parent and the payload's fields; a payload that does not fit the schema gives nulls."""
        rows = self.df.where(F.col("tag") == tag)
        return rows.select("root", "pk", "parent", F.from_json("payload", schema).alias("_fields")).select("root", "pk", "parent", "_fields.*")


def write_tagged(*emitted: DataFrame) -> Emission:
    """Write the rows of one or more emissions, partitioned by tag, to the shared folder."""
    rows, *more = emitted
    for df in more:
        rows = rows.unionByName(df)
    spark = rows.sparkSession
    path = fresh_path(spark, "tagged")
    rows.write.option("compression", "zstd").partitionBy("tag").parquet(path)
    return Emission(path, spark.read.schema("root BIGINT, pk ARRAY<INT>, parent ARRAY<INT>, payload STRING, tag STRING").parquet(path))


# ---------------------------------------------------------------- rebalance reports


def _report(body: str) -> dict | None:
    """The report within its wrappers: JSON written as a JSON string, and the fields 'report' and 'result'.

    Wrappers may be nested to any depth; the first object with 'batches' counts, in depth-first order, else the
    outermost object.  ValueError if the body itself is no complete JSON.
    """
    outermost, todo = None, [parse(body)]
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            try:
                todo.append(parse(value))
            except ValueError:
                pass
        elif isinstance(value, dict):
            if "batches" in value:
                return value
            outermost = value if outermost is None else outermost
            todo += [value.get("result"), value.get("report")]
    return outermost


def _slots(value) -> list:
    """The slots of a batch: an array, or a comma-separated text; an element that holds nothing is None."""
    if isinstance(value, str):
        return [part.strip() or None for part in value.split(",")] if value.strip() else []
    if isinstance(value, list):
        return value
    return [] if value is None else [value]


def _array(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _leaf(value) -> str:
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return value.strip() if isinstance(value, str) else text_of(value)


def visit_report(body: str):
    """Batches and their slots, skipped keys and attempts in one rebalance report, as nodes of any release wrote it.

    'batches' may be an array or a lone object, wrapped or not, or JSON within a string; 'slots' may hold numbers,
    texts, nulls or be one comma-separated text.  A body that is not complete JSON yields nothing.
    """
    try:
        report = _report(body)
    except ValueError:
        return
    batches = (report or {}).get("batches")
    for i, batch in enumerate(batches if isinstance(batches, list) else [batches]):
        if batch is None:
            continue
        own = batch if isinstance(batch, dict) else {}
        leaves = [(j, _leaf(slot)) for j, slot in enumerate(_slots(own.get("slots"))) if slot is not None]
        text = {name: None if own.get(name) is None else str(own[name]) for name in ("from", "to", "keys_moved", "error")}
        yield "batch", (i,), {"leaves": len(leaves), **text}
        for j, slot in leaves:
            yield "batch_slot", (i, j), {"value": slot}
        for j, key in enumerate(_array(own.get("skipped_keys"))):
            if key is not None:
                yield "batch_skipped_key", (i, j), {"value": _leaf(key)}
        for j, attempt in enumerate(_array(own.get("attempts"))):
            if attempt is not None:
                fields = attempt if isinstance(attempt, dict) else {}
                yield "batch_attempt", (i, j), {name: None if fields.get(name) is None else str(fields[name]) for name in ("no", "took")}


PROBE_NODES = Node("shard", "shards", tuple((n, n) for n in ("shard_id", "role", "leader_id", "term", "commit_index", "slots")), (Node("member", "members"), Node("learner", "learners")))
DUMP_NODES = Node("zset", "zsets", (("key", "key"),), (Node("zset_member", "members", (("member", "member"), ("score", "score"))),))


# The flat tables: the names of the positions in pk, and the fields.
TABLES = {
    "batch": (("position",), "from STRING, to STRING, keys_moved STRING, error STRING"),
    "batch_slot": (("position", "slot_no"), "value STRING"),
    "batch_skipped_key": (("position", "key_no"), "value STRING"),
    "batch_attempt": (("position", "attempt_no"), "no STRING, took STRING"),
    "zset": (("position",), "key STRING"),
    "zset_member": (("position", "member_no"), "member STRING, score DOUBLE"),
    "shard": (("position",), "shard_id STRING, role STRING, leader_id STRING, term BIGINT, commit_index BIGINT, slots INT"),
    "member": (("position", "member_no"), "value STRING"),
    "learner": (("position", "learner_no"), "value STRING"),
}


def report_rows(reports: DataFrame) -> DataFrame:
    return emit_text(reports, "report_id", "body", visit_report)


def dump_rows(dumps: DataFrame) -> DataFrame:
    return emit_typed(dumps, "dump_id", [DUMP_NODES])


def probe_rows(probes: DataFrame) -> DataFrame:
    return emit_typed(probes, "probe_id", [PROBE_NODES])


def flat_table(written: Emission, tag: str, root: str) -> DataFrame:
    """The flat table of a tag: the id of the record, the positions that lead to the row, its fields.  Rows that deliveries repeat come once."""
    positions, schema = TABLES[tag]
    rows = written.table(tag, schema).distinct()
    return rows.select(F.col("root").alias(root), *(F.get("pk", F.lit(i)).alias(name) for i, name in enumerate(positions)), *rows.columns[3:])


def nested_elements(reports: DataFrame, dumps: DataFrame, probes: DataFrame) -> DataFrame:
    """kind, parent_id, child_no, leaf_no, item: the slots of batches, the members of sorted sets, the learners of shard states.

    A batch or sorted set without any leaf that is not null gives one row with leaf_no -1 and an empty item.  Rows
    that deliveries repeat come once.  All tables of ``TABLES`` are written in the same pass.
    """
    written = write_tagged(report_rows(reports), dump_rows(dumps), probe_rows(probes))
    at = lambda i: F.get("pk", F.lit(i))
    slots = written.table("batch_slot", "value STRING").select(F.lit("batch_slot").alias("kind"), F.col("root").alias("parent_id"), at(0).alias("child_no"), at(1).alias("leaf_no"), F.col("value").alias("item"))
    bare = written.table("batch", "leaves INT").where("leaves = 0").select(F.lit("batch_slot"), "root", at(0), F.lit(-1), F.lit(""))
    members = written.table("zset_member", "member STRING").where("member IS NOT NULL").select(F.lit("zset_member").alias("kind"), F.col("root").alias("parent_id"), at(0).alias("child_no"), at(1).alias("leaf_no"), F.col("member").alias("item"))
    sets = written.table("zset", "key STRING").select(F.lit("zset_member").alias("kind"), F.col("root").alias("parent_id"), at(0).alias("child_no")).distinct()
    empty = sets.join(members.select("parent_id", "child_no").distinct(), ["parent_id", "child_no"], "left_anti").select("kind", "parent_id", "child_no", F.lit(-1), F.lit(""))
    nodes = written.table("learner", "value STRING").where("value IS NOT NULL").select(F.lit("learner"), "root", at(0), at(1), "value")
    return slots.union(bare).union(members).union(empty).union(nodes).distinct()
