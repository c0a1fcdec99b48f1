"""The stores rebuilt from one log of mixed commands.

Every command changes a record in a way that depends on what the record was: it sets it, sets it only if there is
one or none, adds to it, or ends it.  Such changes can be put together without knowing the record: two changes in a
row are one change of the same kind.  So the changes of a record are first put together in blocks of the log, and
then the few blocks; a record that is written all the time is folded by many tasks.

A log has the columns shard, idx, term and data, the JSON of a command; see ``change_feed.in_force`` for the entries
that count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions import geo
from slotweave.operators.change_feed import in_force
from slotweave.workspace import materialize

BLOCK = 1 << 20  # neighbouring log indexes that one task folds
CHANGES = "shard STRING, key STRING, member STRING, op STRING, n DOUBLE, data STRING"
RECORD = ["shard", "key", "member"]
_NONE = (None, "add", 0.0, None)  # (what a missing record becomes, what happens to one that is there, by how much, its data)


def commands(log: DataFrame) -> DataFrame:
    """shard, idx, cmd, args of the entries in force; entries whose data is no JSON command are left out."""
    entries = in_force(log.select("shard", "idx", "term", "data")).where("data IS NOT NULL")
    once = entries.groupBy("shard", "idx").agg(F.max_by("data", "term").alias("data"))
    parsed = once.select("shard", "idx", F.from_json(F.col("data").cast("string"), "cmd STRING, args MAP<STRING, STRING>").alias("c"))
    parsed = parsed.where("c.cmd IS NOT NULL").select("shard", "idx", "c.cmd", F.coalesce("c.args", F.create_map().cast("map<string,string>")).alias("args"))
    return materialize(parsed, "commands")  # parsed once, whatever is made of them


def single_change(op: str, n: float, data: str | None = None) -> tuple:
    """The change that one command makes."""
    return {
        "put": (n, "put", n, data),
        "put_new": (n, "add", 0.0, data),
        "put_old": (None, "put", n, data),
        "add": (n, "add", n, data),
        "end": (None, "end", 0.0, None),
    }[op]


def applied(change: tuple, value: float | None) -> float | None:
    """What a record becomes; None is a missing one."""
    missing, mode, n, _ = change
    return missing if value is None else value + n if mode == "add" else n if mode == "put" else None


def together(first: tuple, then: tuple) -> tuple:
    """One change that does what two do in a row.  The data of the later one counts, if it has any and writes."""
    missing = applied(then, first[0])
    if first[1] == "add" and then[1] == "add":
        mode, n = "add", first[2] + then[2]
    elif first[1] == "add":
        mode, n = then[1], then[2]
    else:
        after = applied(then, first[2] if first[1] == "put" else None)
        mode, n = ("end", 0.0) if after is None else ("put", after)
    return missing, mode, n, None if then[1] == "end" else then[3] if then[3] is not None else first[3]


def _folded(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """One change for each group, by a pass over sorted partitions that holds one group's change."""
    keys = [*RECORD, *by]
    whole = [*keys, "missing", "mode", "n", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, change = None, _NONE
        for batch in batches:
            out = []
            for row in batch[[*keys, "missing", "mode", "n", "data"]].itertuples(index=False, name=None):
                own, (missing, mode, n, data) = row[: len(keys)], row[len(keys) :]
                if own != at:
                    if at is not None:
                        out.append((*at, *change))
                    at, change = own, _NONE
                change = together(change, (None if missing != missing else missing, mode, n, data))
            yield pd.DataFrame(out, columns=whole)
        if at is not None:
            yield pd.DataFrame([(*at, *change)], columns=whole)

    schema = "shard STRING, key STRING, member STRING, " + "".join(f"{c} BIGINT, " for c in by) + "missing DOUBLE, mode STRING, n DOUBLE, data STRING"
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def fold_changes(changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """shard, key, member, value, data of the records that are there after all ``changes`` (CHANGES and idx).

    ``op`` is 'put', 'put_new' (only if the record is missing), 'put_old' (only if it is there), 'add' or 'end'.
    Rows with a null in shard, key, member, idx or op, and numbers that are null where one is needed, have no effect.
    """
    rows = changes.dropna(subset=[*RECORD, "idx", "op"]).where("op = 'end' OR (n IS NOT NULL AND NOT isnan(n))")
    n = F.coalesce("n", F.lit(0.0))
    one = rows.select(
        *RECORD,
        F.floor(F.col("idx") / block).cast("bigint").alias("block"),
        "idx",
        F.when(F.col("op").isin("put", "put_new", "add"), n).alias("missing"),
        F.when(F.col("op").isin("put", "put_old"), "put").when(F.col("op") == "end", "end").otherwise("add").alias("mode"),
        F.when(F.col("op") == "put_new", 0.0).otherwise(n).alias("n"),
        "data",
    )
    blocks = _folded(one, ["block"], "idx")
    return _folded(blocks, [], "block").where("missing IS NOT NULL").select(*RECORD, F.col("missing").alias("value"), "data")


def _numbers(name: str) -> Column:
    return F.col("args")[name].try_cast("double")


def _members_but_key() -> Column:
    return F.map_values(F.map_filter("args", lambda name, value: (name != "key") & value.isNotNull()))


def zsets(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """shard, key, member, score after ZADD (nx, xx), ZINCRBY, ZREM and GEOADD in one log."""
    c = commands(log).withColumn("key", F.col("args")["key"])
    flag = lambda name: F.lower(F.coalesce(F.col("args")[name], F.lit(""))) == "true"
    put = F.when(flag("nx") & flag("xx"), None).when(flag("nx"), "put_new").when(flag("xx"), "put_old").otherwise("put")
    member = F.col("args")["member"].alias("member")
    added = F.col("cmd") == "ZADD"
    one = c.where("cmd IN ('ZADD', 'ZINCRBY')").select("shard", "key", member, "idx", F.when(added, put).otherwise("add").alias("op"), F.when(added, _numbers("score")).otherwise(_numbers("increment")).alias("n"))
    placed = c.where("cmd = 'GEOADD'").select("shard", "key", member, "idx", F.lit("put").alias("op"), _numbers("longitude").alias("lon"), _numbers("latitude").alias("lat"))
    one = one.unionByName(placed.withColumn("n", geo.encode(F.col("lon"), F.col("lat")).cast("double")).drop("lon", "lat"))
    ended = c.where("cmd = 'ZREM'").select("shard", "key", F.explode(_members_but_key()).alias("member"), "idx", F.lit("end").alias("op"), F.lit(None).cast("double").alias("n"))
    changes = one.unionByName(ended).withColumn("data", F.lit(None).cast("string"))
    return fold_changes(changes, block).select(*RECORD, F.col("value").alias("score"))


def boards(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """shard, key, member, score, data after SL_ADD and SL_DELETE; scores add up, the newest data counts."""
    c = commands(log).where("cmd IN ('SL_ADD', 'SL_DELETE')")
    changes = c.select("shard", F.col("args")["key"].alias("key"), F.col("args")["member"].alias("member"), "idx", F.when(F.col("cmd") == "SL_ADD", "add").otherwise("end").alias("op"), _numbers("score").alias("n"), F.col("args")["data"].alias("data"))
    return fold_changes(changes, block).select(*RECORD, F.col("value").cast("bigint").alias("score"), "data")


def sets(log: DataFrame) -> DataFrame:
    """shard, key, member after SADD and SREM: the last command of each member counts, so no order has to be kept."""
    c = commands(log).where("cmd IN ('SADD', 'SREM')").select("shard", F.col("args")["key"].alias("key"), F.col("args")["value"].alias("member"), "idx", "cmd")
    last = c.dropna(subset=["key", "member"]).groupBy(*RECORD).agg(F.max_by("cmd", "idx").alias("cmd"))
    return last.where("cmd = 'SADD'").select(*RECORD)


def strings(log: DataFrame) -> DataFrame:
    """shard, key, value after SET, INCR and DEL: what the last SET or DEL left, and the increments behind it.

    An INCR of a text that is no integer has no effect.  A null value is kept as ''.
    """
    c = commands(log).where("cmd IN ('SET', 'INCR', 'DEL')")
    key = F.col("args")["key"]
    # the arguments '1', '2', ... up to the first missing number
    numbered = F.transform(F.sequence(F.lit(1), F.greatest(F.size("args"), F.lit(1))), lambda i: F.col("args")[i.cast("string")])
    first_gap = F.array_position(F.transform(numbered, lambda x: x.isNull()), True)
    more = F.slice(numbered, F.lit(1), F.when(first_gap > 0, first_gap - 1).otherwise(F.size(numbered)).cast("int"))
    one = c.where("cmd <> 'DEL'").select("shard", key.alias("key"), "idx", "cmd", F.coalesce(F.col("args")["value"], F.lit("")).alias("value"))
    gone = c.where("cmd = 'DEL'").where(key.isNotNull()).select("shard", F.explode(F.concat(F.array(key), more)).alias("key"), "idx", "cmd", F.lit(None).cast("string").alias("value"))
    rows = one.unionByName(gone).where("key IS NOT NULL")
    last = rows.where("cmd <> 'INCR'").groupBy("shard", "key").agg(F.max("idx").alias("_at"), F.max_by("cmd", "idx").alias("_cmd"), F.max_by("value", "idx").alias("_value"))
    # increments are counted in blocks of the log, so that only the block of the last SET or DEL is looked at row by row
    counts = rows.where("cmd = 'INCR'").withColumn("_block", F.floor(F.col("idx") / BLOCK).cast("bigint"))
    ends = last.select("shard", "key", "_at", F.floor(F.col("_at") / BLOCK).cast("bigint").alias("_end"))
    sums = counts.groupBy("shard", "key", "_block").agg(F.count(F.lit(1)).alias("_n")).join(ends, ["shard", "key"], "left")
    later = sums.where("_end IS NULL OR _block > _end").groupBy("shard", "key").agg(F.sum("_n").alias("_later"))
    within = counts.join(ends.withColumnRenamed("_end", "_block"), ["shard", "key", "_block"]).where("idx > _at").groupBy("shard", "key").agg(F.count(F.lit(1)).alias("_within"))
    state = last.join(later, ["shard", "key"], "full").join(within, ["shard", "key"], "full")
    n = F.coalesce("_later", F.lit(0)) + F.coalesce("_within", F.lit(0))
    number = F.when(F.col("_value").rlike("^[+-]?[0-9]+$"), F.col("_value").try_cast("bigint"))
    value = F.when(F.col("_cmd") == "SET", F.when((n > 0) & number.isNotNull(), (number + n).cast("string")).otherwise(F.col("_value"))).when(n > 0, n.cast("string"))
    return state.select("shard", "key", value.alias("value")).where("value IS NOT NULL")
