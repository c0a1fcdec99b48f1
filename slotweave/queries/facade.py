"""Queries on single commands, parsers and documents, and on hash functions with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.engine import CommandError, Engine
from slotweave.functions.hashing import murmur3_32
from slotweave.operators import bloom, cms, slots
from slotweave.plans import status
from slotweave.queries import Registry, table
from slotweave.queries.cluster import _LATEST, SHARDS
from slotweave.sources import topology
from slotweave.workspace import fresh_path

registry = Registry()
query = registry.add

# ---------------------------------------------------------------- hash functions in SQL

_M32 = "4294967295"


def _rotl32(x: str, r: int) -> str:
    return f"((({x} << {r}) | ({x} >> {32 - r})) & {_M32})"


def murmur32_sql(source: str, keep: str, text: str, seeds: str) -> str:
    """A chain of tables that ends in mm (``keep``, seed, h): MurmurHash3 x86-32 of an ASCII text under each of ``seeds``."""
    number = lambda x: f"CAST({x} AS UBIGINT)"
    block = " + ".join(f"(b[4 * i + {k + 1}] << {8 * k})" for k in range(4))
    tail = " + ".join(f"coalesce(b[4 * (n // 4) + {k + 1}] << {8 * k}, {number(0)})" for k in range(3))
    mixed = lambda x: f"({_rotl32(x, 15)} * {number(0x1B873593)}) & {_M32}"
    return f"""mb AS (SELECT {keep}, len(x) AS n, list_transform(string_split(x, ''), lambda c: {number("ord(c)")}) AS b FROM (SELECT *, {text} AS x FROM {source})),
mk AS (SELECT {keep}, n, list_transform(list_transform(range(0, n // 4), lambda i: (({block}) * {number(0xCC9E2D51)}) & {_M32}), lambda k: {mixed("k")}) AS ks, (({tail}) * {number(0xCC9E2D51)}) & {_M32} AS t FROM mb),
mh AS (SELECT {keep}, n, seed, xor(xor(list_reduce(list_prepend({number("seed")}, ks), lambda a, k: ({_rotl32("xor(a, k)", 13)} * 5 + {number(0xE6546B64)}) & {_M32}), {mixed("t")}), {number("n")}) AS h FROM mk, (SELECT unnest(range({seeds})) AS seed)),
mf AS (SELECT {keep}, seed, (xor(h, h >> 16) * {number(0x85EBCA6B)}) & {_M32} AS h FROM mh),
mg AS (SELECT {keep}, seed, (xor(h, h >> 13) * {number(0xC2B2AE35)}) & {_M32} AS h FROM mf),
mm AS (SELECT {keep}, seed, CAST(xor(h, h >> 16) AS BIGINT) AS h FROM mg)"""


def _u(x) -> str:
    return f"CAST({x} AS UHUGEINT)"


_M64 = _u((1 << 64) - 1)


def _fmix64_sql(x: str, stage: int) -> str:
    return f"(xor({x}, {x} >> 33) * {_u((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)[stage])}) & {_M64}"


def murmur128_sql(source: str, keep: str, text: str, seed: int) -> str:
    """A chain of tables that ends in nn (``keep``, h1, h2): MurmurHash3 x64-128 of an ASCII text of up to 8 signs."""
    word = " + ".join(f"coalesce(b[{k + 1}] << {8 * k}, {_u(0)})" for k in range(8))
    rotated = f"(((k << 31) | (k >> 33)) & {_M64})"
    tables = [
        f"nb AS (SELECT {keep}, len(x) AS n, list_transform(string_split(x, ''), lambda c: {_u('ord(c)')}) AS b FROM (SELECT *, {text} AS x FROM {source}))",
        f"nk AS (SELECT {keep}, n, (({word}) * {_u(0x87C37B91114253D5)}) & {_M64} AS k FROM nb)",
        f"n0 AS (SELECT {keep}, xor(xor({_u(seed)}, ({rotated} * {_u(0x4CF5AD432745937F)}) & {_M64}), {_u('n')}) AS p, xor({_u(seed)}, {_u('n')}) AS q FROM nk)",
        f"n1 AS (SELECT {keep}, (p + q) & {_M64} AS p, (p + q + q) & {_M64} AS q FROM n0)",
        f"n2 AS (SELECT {keep}, {_fmix64_sql('p', 0)} AS p, {_fmix64_sql('q', 0)} AS q FROM n1)",
        f"n3 AS (SELECT {keep}, {_fmix64_sql('p', 1)} AS p, {_fmix64_sql('q', 1)} AS q FROM n2)",
        f"n4 AS (SELECT {keep}, xor(p, p >> 33) AS p, xor(q, q >> 33) AS q FROM n3)",
        f"nn AS (SELECT {keep}, (p + q) & {_M64} AS h1, (p + q + q) & {_M64} AS h2 FROM n4)",
    ]
    return ",\n".join(tables)


@query("WITH " + murmur32_sql("customer", "c_custkey", "c_name", "3") + " SELECT c_custkey, seed, h AS hash FROM mm")
def murmur_hashes(spark, folder):
    """MurmurHash3 x86-32 of every customer's name under three seeds."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(names):
        import numpy as np
        import pandas as pd

        return pd.Series(list(murmur3_32([x.encode() for x in names], np.arange(3)).astype(np.int64)), dtype=object)

    rows = table(spark, folder, "customer").where("c_name IS NOT NULL")
    return rows.select("c_custkey", F.posexplode(hashes("c_name")).alias("seed", "hash")).select("c_custkey", F.col("seed").cast("bigint").alias("seed"), "hash")


_CMS = "WITH adds AS (SELECT 'u' || user_id AS item, count(*) AS n FROM events GROUP BY ALL),\n" + murmur32_sql("adds", "item", "item", "4")


@query(_CMS + ",\ncells AS (SELECT seed, h % 100 AS col, sum(n) AS n FROM mm JOIN adds USING (item) GROUP BY ALL) SELECT 'all' AS key, item, CAST(min(cells.n) AS BIGINT) AS estimate FROM mm JOIN cells ON cells.seed = mm.seed AND cells.col = mm.h % 100 GROUP BY item")
def cms_query(spark, folder):
    """Counts of the events of each user in a sketch so narrow that users share cells."""
    adds = table(spark, folder, "events").select(F.lit("all").alias("key"), F.concat(F.lit("u"), "user_id").alias("item"), F.lit(1).cast("bigint").alias("n"))
    return cms.query(cms.incrby(adds, 100, 4), adds, 100, 4)


_BITS, _HASHES = bloom.sizing(400, 0.05)
_BLOOM = "WITH asked AS (SELECT DISTINCT CAST(user_id % 8 AS VARCHAR) AS key, 'u' || event_id % 5000 AS item, bool_or(event_type = 'view') AS added FROM events GROUP BY ALL),\n" + murmur128_sql("asked", "key, item, added", "item", bloom.SEED)


@query(
    _BLOOM
    + f""",
pos AS (SELECT key, item, added, CAST(((h1 + h2 * {_u("i")}) & {_M64}) % {_u(_BITS)} AS BIGINT) AS place FROM nn, (SELECT unnest(range({_HASHES})) AS i)),
bits AS (SELECT DISTINCT key, place FROM pos WHERE added)
SELECT pos.key, item, CAST(bool_and(bits.place IS NOT NULL) AS BIGINT) AS present FROM pos LEFT JOIN bits ON bits.key = pos.key AND bits.place = pos.place GROUP BY pos.key, item"""
)
def bf_exists(spark, folder):
    """Filters hold what was viewed, and are asked for everything: false positives are those of the hash function."""
    e = table(spark, folder, "events").select((F.col("user_id") % 8).cast("string").alias("key"), F.concat(F.lit("u"), F.col("event_id") % 5000).alias("item"), "event_type")
    return bloom.exists(bloom.madd(e.where("event_type = 'view'"), 400, 0.05), e, 400, 0.05)


# ---------------------------------------------------------------- single commands


@query("SELECT * FROM (VALUES ('BF_RESERVE', 'OK'), ('BF_MADD', '2'), ('BF_MEXISTS a', '1'), ('BF_MEXISTS b', '1'), ('CMS_INITBYDIM', 'OK'), ('CMS_INCRBY', '5'), ('CMS_QUERY', '5'), ('RATELIMIT_INIT', 'OK'), ('RATELIMIT_CHECK', 'true'), ('RATELIMIT_CHECK again', 'false'), ('NOPE', 'unknown command: NOPE'), ('SMISMEMBER x', '1'), ('SMISMEMBER y', '0')) t(command, reply)")
def engine_commands(spark, folder):
    """Commands one at a time, the unknown one too."""
    engine, replies = Engine(spark), []

    def run(cmd, args, name=None, column=None):
        for row in engine.execute(cmd, args).collect():
            value = row[column or "result"]
            replies.append((f"{name or cmd} {row['item' if 'item' in row else 'member']}" if "item" in row or "member" in row else name or cmd, str(value).lower() if isinstance(value, bool) else str(value)))

    run("BF_RESERVE", {"key": "f", "capacity": "100", "errRate": "0.01"})
    run("BF_MADD", {"key": "f", "1": "a", "2": "b"})
    run("BF_MEXISTS", {"key": "f", "1": "a", "2": "b"})
    run("CMS_INITBYDIM", {"key": "c", "width": "50", "height": "3"})
    run("CMS_INCRBY", {"key": "c", "item": "x", "value": "5"})
    run("CMS_QUERY", {"key": "c", "item": "x"})
    limit = {"key": "r", "limit": "1", "window_ms": "1000"}
    run("RATELIMIT_INIT", limit)
    run("RATELIMIT_CHECK", limit, column="allowed")
    run("RATELIMIT_CHECK", limit, "RATELIMIT_CHECK again", "allowed")
    engine.execute("SADD", {"key": "s", "value": "x"}).collect()
    run("SMISMEMBER", {"key": "s", "value": "x", "1": "y"})
    try:
        engine.execute("NOPE")
    except CommandError as error:
        replies.append(("NOPE", str(error)))
    return spark.createDataFrame(replies, "command STRING, reply STRING")


@query(_LATEST + "SELECT * FROM views")
def engine_status(spark, folder):
    probes = table(spark, folder, "node_probes")
    reported = status.reported_shards(status.latest_probes(probes))
    members = reported.select(F.col("shard_id").alias("shard"), F.explode("members").alias("node")).where("node IS NOT NULL").distinct()
    t = table(spark, folder, "topology_snapshots")
    last = t.groupBy("cluster_id").agg(F.max("delivery_id").alias("delivery_id")).select("delivery_id")
    return Engine(spark).status(members, t.join(last, "delivery_id", "left_semi").select(F.posexplode("slots").alias("slot", "shard")), probes)


@query("SELECT * FROM (VALUES ('shard-1', 'shard-2', CAST(3177 AS BIGINT)), ('shard-0', 'shard-2', 2558), ('shard-0', 'shard-1', 309)) t(\"from\", \"to\", moves)")
def engine_plan(spark, folder):
    return Engine(spark).plan(SHARDS[:2], SHARDS).groupBy("from", "to").agg(F.count(F.lit(1)).alias("moves"))


# ---------------------------------------------------------------- parsers and documents


@query("SELECT CAST(pos AS INT) AS pos, CAST(slot AS INT) AS slot FROM (VALUES (0, 3), (1, 1), (2, 16383)) t(pos, slot)")
def parse_slots(spark, folder):
    return spark.createDataFrame(list(enumerate(slots.parse_slots("3, 1,3,,16383"))), "pos INT, slot INT")


@query("SELECT * FROM (VALUES ('s1', 'a', 'http://a:1'), ('s1', 'b', 'http://b:1'), ('s2', 'c', '')) t(shard, node, address)")
def parse_shards(spark, folder):
    return topology.from_text(spark, "s1:a=http://a:1, b=http://b:1; s2:c=;")


@query(
    """WITH d AS (SELECT * FROM topology_snapshots WHERE len(slots) = slot_count ORDER BY slot_count DESC, delivery_id LIMIT 1)
SELECT version, CAST(i - 1 AS INT) AS slot, coalesce(s, '') AS shard FROM (SELECT version, unnest(slots) AS s, generate_subscripts(slots, 1) AS i FROM d)"""
)
def topology_document(spark, folder):
    """The largest topology saved as a document, twice, and loaded again."""
    t = table(spark, folder, "topology_snapshots").where(F.size("slots") == F.col("slot_count"))
    one = t.orderBy(F.desc("slot_count"), "delivery_id").limit(1)  # one document
    path = f"{fresh_path(spark, 'topology')}/topology.json"
    for version in (one.withColumn("version", F.lit(0).cast("bigint")), one):
        topology.write(version.select("version", "slot_count", "vnodes", "epsilon", "shards", "slots", "migrations"), path)
    return topology.slot_table(topology.read(spark, path))
