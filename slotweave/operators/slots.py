"""Moving the state of key slots: dump, restore and delete.

A state is a dict of DataFrames: 'strings' (key, value, expire_at_ms), 'sets' (key, member), 'zsets' (key, member,
score) and 'boards' (key, member, score, data); other stores are only reported as skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions.keyspace import SLOTS, hash_slot
from slotweave.operators.neighbours import spread_rank

CHUNK = 4096  # members in one entry of a dump
MEMBERS = {"sets": ["member"], "zsets": ["member", "score"], "boards": ["member", "score", "data"]}


def parse_slots(text: str, slots: int = SLOTS) -> list[int]:
    """The slots of a comma-separated list, each once, in order; none, or one out of range, is an error."""
    if slots <= 0:
        raise ValueError("slot count must be positive")
    found = dict.fromkeys(int(part) for part in text.split(",") if part.strip())
    if not found:
        raise ValueError("no slots")
    if bad := [s for s in found if not 0 <= s < slots]:
        raise ValueError(f"slot {bad[0]} out of range")
    return list(found)


def with_slot(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    return df.withColumn("slot", hash_slot(F.col("key"), slots))


def _inside(df: DataFrame, wanted: list[int], slots: int, how: str = "left_semi") -> DataFrame:
    """The rows whose slot is wanted, with the column slot; the wanted slots are at most ``slots`` rows."""
    chosen = df.sparkSession.createDataFrame([(s,) for s in wanted], "slot BIGINT")
    return with_slot(df, slots).join(F.broadcast(chosen), "slot", how)


SKIPPED = ("bloom", "cms", "ratelimit")  # stores whose keys a dump only names


def dump(state: dict[str, DataFrame], wanted: list[int], now_ms: int, slots: int = SLOTS, chunk: int = CHUNK) -> DataFrame:
    """slot, store, key, chunk, entry: the content of the keys in the slots as JSON; expired strings are left out.

    Members come in rank order, at most ``chunk`` of them in one entry, so that no key has to fit into one value.
    Keys of other stores give one row each with store 'skipped' and the kind of the store.
    """
    parts = []
    for store in SKIPPED:
        if store in state:
            keys = _inside(state[store].select("key").dropna().distinct(), wanted, slots)
            parts.append(keys.select("slot", F.lit("skipped").alias("store"), "key", F.lit(0).cast("bigint").alias("chunk"), F.lit(f'{{"type":"{store}"}}').alias("entry")))
    if "strings" in state:
        alive = state["strings"].where(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms))
        parts.append(_inside(alive, wanted, slots).select("slot", F.lit("strings").alias("store"), "key", F.lit(0).cast("bigint").alias("chunk"), F.to_json(F.struct("value", "expire_at_ms")).alias("entry")))
    order = {"sets": [F.col("member")], "zsets": [F.col("score"), F.col("member")], "boards": [F.desc("score"), F.col("member")]}
    for store, columns in MEMBERS.items():
        if store in state:
            rows = spread_rank(_inside(state[store], wanted, slots).select("slot", "key", *columns), ["slot", "key"], order[store], "_rank")
            members = F.transform(F.sort_array(F.collect_list(F.struct("_rank", *columns))), lambda m: F.struct(*(m[c].alias(c) for c in columns)))
            chunked = rows.groupBy("slot", "key", F.expr(f"_rank div {chunk}").alias("chunk")).agg(F.to_json(members).alias("entry"))
            parts.append(chunked.select("slot", F.lit(store).alias("store"), "key", "chunk", "entry"))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def restore(state: dict[str, DataFrame], dumped: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """The state with the dumped keys in place of its own; strings that have expired meanwhile are not restored."""
    schemas = {"sets": "array<struct<member:string>>", "zsets": "array<struct<member:string,score:double>>", "boards": "array<struct<member:string,score:bigint,data:string>>"}
    out = dict(state)
    for store, df in state.items():
        if store in SKIPPED:
            continue
        rows = dumped.where(F.col("store") == store)
        if store == "strings":
            new = rows.select("key", F.from_json("entry", "value STRING, expire_at_ms BIGINT").alias("e")).select("key", "e.*")
            new = new.where(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms))
        else:
            new = rows.select("key", F.inline(F.from_json("entry", schemas[store])))
        kept = df.join(new.select("key").distinct(), "key", "left_anti")
        out[store] = kept.unionByName(new.select(*kept.columns))
    return out


def restored_keys(dumped: DataFrame, now_ms: int) -> DataFrame:
    """store, key of what ``restore`` puts into a state: skipped keys and expired strings are not."""
    expiry = F.from_json("entry", "expire_at_ms BIGINT")["expire_at_ms"]
    return dumped.where("store <> 'skipped'").where((F.col("store") != "strings") | expiry.isNull() | (expiry > now_ms)).select("store", "key").distinct()


def delete_slots(state: dict[str, DataFrame], wanted: list[int], slots: int = SLOTS) -> dict[str, DataFrame]:
    """The state without the keys in the slots; stores of other kinds stay as they are."""
    return {store: _inside(df, wanted, slots, "left_anti").select(*df.columns) if store == "strings" or store in MEMBERS else df for store, df in state.items()}
