"""Queries on geographic members, sketches, limiters, channels, slots, topologies and replicated logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.engine import Engine
from slotweave.functions import geo
from slotweave.functions.keyspace import hash_slot, hash_tag
from slotweave.operators import bloom, cms, geosearch, pubsub, slots, strings
from slotweave.plans import consensus, placement, status
from slotweave.queries import Registry, table
from slotweave.queries.stores import _KV, NOW, _z, kv_log

registry = Registry()
query = registry.add

# ---------------------------------------------------------------- geographic members


def _points(spark, folder, name, key):
    k = F.col(key)
    return table(spark, folder, name).select(k.alias("id"), ((k * 7919) % 36000 / 100.0 - 180).alias("lon"), ((k * 6101) % 17000 / 100.0 - 85).alias("lat"))


_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _sql_spread(x: str) -> str:
    for shift, mask in _SPREAD:
        x = f"(({x}) | (({x}) << {shift})) & {mask}" if len(x) < 40 else f"(SELECT (w{shift} | (w{shift} << {shift})) & {mask} FROM (SELECT {x} AS w{shift}))"
    return x


_GEO = f"""WITH p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 36000 / 100.0 - 180 AS lon, (c_custkey * 6101) % 17000 / 100.0 - 85 AS lat FROM customer),
cell AS (SELECT id, lon, lat, CAST(floor((lon + 180.0) / 360.0 * 67108864.0) AS BIGINT) AS x, CAST(floor((lat + 85.05112878) / 170.10225756 * 67108864.0) AS BIGINT) AS y FROM p),
std AS (SELECT *, CAST(floor(((85.05112878 * -1 + (y + 0.5) / 67108864.0 * 170.10225756) + 90.0) / 180.0 * 67108864.0) AS BIGINT) AS ys FROM cell),
bits AS (SELECT *, {_sql_spread("y")} | ({_sql_spread("x")} << 1) AS score, {_sql_spread("ys")} | ({_sql_spread("x")} << 1) AS standard FROM std) """
_DIST = "CASE WHEN {0}lon = {1}lon THEN 6372797.560856 * abs(radians({1}lat) - radians({0}lat)) ELSE 2 * 6372797.560856 * asin(sqrt(least(1.0, pow(sin((radians({1}lat) - radians({0}lat)) / 2), 2) + cos(radians({0}lat)) * cos(radians({1}lat)) * pow(sin((radians({1}lon) - radians({0}lon)) / 2), 2)))) END"


@query(_GEO + "SELECT CAST(id AS VARCHAR) AS member, CAST(score AS BIGINT) AS score FROM bits")
def geo_add(spark, folder):
    return _points(spark, folder, "customer", "c_custkey").select(F.col("id").cast("string").alias("member"), geo.encode(F.col("lon"), F.col("lat")).alias("score"))


@query(
    _GEO
    + f""", ten AS (SELECT CAST(id AS VARCHAR) AS member, x >> 16 AS a, y >> 16 AS b, ((x >> 16) + 1) % 1024 AS e, ((x >> 16) + 1023) % 1024 AS w, ((y >> 16) + 1) % 1024 AS n FROM bits)
SELECT member, CAST({_sql_spread("b")} | ({_sql_spread("a")} << 1) AS BIGINT) AS cell, CAST(({_sql_spread("b")} | ({_sql_spread("a")} << 1)) << 32 AS BIGINT) AS low, CAST((({_sql_spread("b")} | ({_sql_spread("a")} << 1)) + 1) << 32 AS BIGINT) AS high,
  CAST({_sql_spread("b")} | ({_sql_spread("e")} << 1) AS BIGINT) AS east, CAST({_sql_spread("n")} | ({_sql_spread("w")} << 1) AS BIGINT) AS northwest FROM ten"""
)
def geo_cells(spark, folder):
    """The cell of each member at ten steps, its limits and two of its neighbours."""
    own = geo_add(spark, folder).select("member", geo.cell(F.col("score"), 10).alias("cell"))
    low, high = geo.score_limits(F.col("cell"), 10)
    around = geo.neighbours(F.col("cell"), 10)
    return own.select("member", "cell", low.alias("low"), high.alias("high"), around[2].alias("east"), around[7].alias("northwest"))


@query(_GEO + "SELECT CAST(id AS VARCHAR) AS member, round(-180.0 + (x + 0.5) / 67108864.0 * 360.0, 6) AS lon, round(-85.05112878 + (y + 0.5) / 67108864.0 * 170.10225756, 6) AS lat FROM bits")
def geo_pos(spark, folder):
    lon, lat = geo.decode(F.col("score"))
    return geo_add(spark, folder).select("member", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(_GEO + f"SELECT a.id, round(({_DIST.format('a.', 'b.')}) / 1000, 4) AS km FROM p a JOIN p b ON b.id = a.id + 1")
def geo_dist(spark, folder):
    p = _points(spark, folder, "customer", "c_custkey")
    q = p.select((F.col("id") - 1).alias("id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return p.join(q, "id").select("id", F.round(geo.distance(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"), "km"), 4).alias("km"))


@query(_GEO + "SELECT CAST(id AS VARCHAR) AS member, " + " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(((standard >> {47 - 5 * i}) & 31) + 1 AS INT), 1)" for i in range(10)) + " || '0' AS hash FROM bits")
def geo_hash(spark, folder):
    return geo_add(spark, folder).select("member", geo.geohash(F.col("score")).alias("hash"))


@query(
    _GEO
    + f""", s AS (SELECT s_suppkey AS id, (s_suppkey * 7919) % 36000 / 100.0 - 180 AS lon, (s_suppkey * 6101) % 17000 / 100.0 - 85 AS lat FROM supplier)
SELECT s.id AS centre, p.id AS member, round({_DIST.format("s.", "p.")}, 3) AS distance FROM s JOIN p ON {_DIST.format("s.", "p.")} <= 1500000.0"""
)
def geo_search(spark, folder):
    centres = _points(spark, folder, "supplier", "s_suppkey").withColumnRenamed("id", "centre")
    found = geosearch.members_within(centres, _points(spark, folder, "customer", "c_custkey").withColumnRenamed("id", "member"), 1_500_000.0)
    return found.withColumn("distance", F.floor(F.col("distance") * 1000 + 0.5) / 1000)  # rounded without the decimals that F.round makes of each


# ---------------------------------------------------------------- sketches


def _bloom_items(spark, folder):
    e = table(spark, folder, "events")
    return e.select((F.col("event_id") % 8).cast("string").alias("key"), F.concat(F.lit("u"), "user_id").alias("item"))


@query("SELECT CAST(event_id % 8 AS VARCHAR) AS key, count(DISTINCT event_id * 7 + 100000000) AS asked, true AS some_absent, true AS within_rate FROM events GROUP BY ALL")
def bf_false_positives(spark, folder):
    """Items that were never added: whether filters filled up to their capacity say so, but for the rate they were made for."""
    e = table(spark, folder, "events").select((F.col("event_id") % 8).cast("string").alias("key"), "event_id")
    capacity = max(e.groupBy("key").count().agg(F.max("count")).first()[0] or 1, 1)
    filters = bloom.madd(e.select("key", F.concat(F.lit("u"), "event_id").alias("item")), capacity, 0.01)
    asked = bloom.exists(filters, e.select("key", F.concat(F.lit("u"), F.col("event_id") * 7 + 100_000_000).alias("item")), capacity, 0.01)
    n, present = F.count(F.lit(1)), F.sum("present")
    return asked.groupBy("key").agg(n.alias("asked"), (present < n).alias("some_absent"), (present <= 0.01 * n + 4 * F.sqrt(0.01 * n) + 3).alias("within_rate"))


@query("SELECT CAST(event_id % 8 AS VARCHAR) AS key, CAST(10000 AS BIGINT) AS capacity, CAST(11984 AS BIGINT) AS size_bytes, CAST(7 AS BIGINT) AS hashes, CAST(0.01 AS DOUBLE) AS error_rate, count(*) AS inserted FROM events GROUP BY ALL")
def bf_info(spark, folder):
    return bloom.info(_bloom_items(spark, folder), 10_000, 0.01)


@query("SELECT count(DISTINCT user_id) AS items, CAST(0 AS BIGINT) AS too_low, true AS some_too_high, true AS within_error FROM events")
def cms_collisions(spark, folder):
    """A narrow sketch: no estimate is too low, some collide, and only a part that the depth allows is off by more than the width says."""
    adds = table(spark, folder, "events").select(F.lit("all").alias("key"), F.concat(F.lit("u"), "user_id").alias("item"), F.lit(1).cast("bigint").alias("n"))
    width, depth = cms.dimensions(0.02, 0.1)
    true = adds.groupBy("item").agg(F.count(F.lit(1)).alias("true"))
    total = adds.agg(F.count(F.lit(1)).alias("total"))
    rows = cms.query(cms.incrby(adds, width, depth), adds, width, depth).join(true, "item").withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")  # one row
    over = F.count_if(F.col("estimate") > F.col("true") + F.lit(0.02) * F.col("total"))
    return rows.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("estimate") < F.col("true")).alias("too_low"), (F.count_if(F.col("estimate") > F.col("true")) > 0).alias("some_too_high"), (over <= 0.1 * F.count(F.lit(1))).alias("within_error"))


@query("SELECT CAST(2000 AS BIGINT) AS width, CAST(7 AS BIGINT) AS depth")
def cms_initbyprob(spark, folder):
    width, depth = cms.dimensions(0.001, 0.01)
    return spark.range(1).select(F.lit(width).cast("bigint").alias("width"), F.lit(depth).cast("bigint").alias("depth"))


# ---------------------------------------------------------------- rate limiters


def _calls(spark, folder, kind, limit, window):
    e = table(spark, folder, "events")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("idx"), millis.alias("ts_ms"), F.col("user_id").cast("string").alias("key"), F.lit(limit).cast("bigint").alias("limit"), F.lit(window).cast("bigint").alias("window_ms"), F.lit(kind).alias("type"))


# ---------------------------------------------------------------- channels


def _publishes(spark, folder):
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("idx"), F.concat("event_type", F.lit("."), F.col("user_id") % 10).alias("channel"), F.col("event_id").cast("string").alias("message"))


def _subscriptions(spark, folder):
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("n"))
    types = ["click", "view", "purchase", "signup", "error"]
    kind = lambda i: F.element_at(F.array(*map(F.lit, types)), (i % 5 + 1).cast("int"))
    direct = n.select(F.concat(F.lit("sub-"), F.col("n")).alias("sub_id"), F.lit("channel").alias("kind"), F.concat(kind(F.col("n")), F.lit("."), F.col("n") % 10).alias("topic"))
    pattern = F.when(F.col("n") % 3 == 0, F.concat(kind(F.col("n")), F.lit(".*"))).when(F.col("n") % 3 == 1, F.lit("*.[1-3]")).otherwise(F.lit("p?rchase.?"))
    return direct.unionByName(n.select(F.concat(F.lit("sub-"), F.col("n")).alias("sub_id"), F.lit("pattern").alias("kind"), pattern.alias("topic")))


_PS = """WITH pub AS (SELECT event_id AS idx, event_type || '.' || (user_id % 10) AS channel, CAST(event_id AS VARCHAR) AS payload FROM events),
n AS (SELECT n_nationkey AS n, list_extract(['click', 'view', 'purchase', 'signup', 'error'], CAST(n_nationkey % 5 + 1 AS INT)) AS k FROM nation),
sub AS (SELECT 'sub-' || n AS sub_id, 'channel' AS kind, k || '.' || (n % 10) AS topic FROM n
  UNION ALL SELECT 'sub-' || n, 'pattern', CASE n % 3 WHEN 0 THEN k || '.*' WHEN 1 THEN '*.[1-3]' ELSE 'p?rchase.?' END FROM n),
out AS (SELECT idx, sub_id, 'message' AS kind, channel, CAST(NULL AS VARCHAR) AS pattern, payload FROM pub JOIN sub ON sub.kind = 'channel' AND topic = channel
  UNION ALL SELECT idx, sub_id, 'pmessage', channel, topic, payload FROM pub JOIN sub ON sub.kind = 'pattern' AND channel GLOB topic),
box AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY idx, kind, channel, pattern) AS seq FROM out) """


def _delivered(spark, folder):
    return pubsub.fan_out(_publishes(spark, folder), _subscriptions(spark, folder))


@query(_PS + "SELECT * FROM out")
def pubsub_fanout(spark, folder):
    return _delivered(spark, folder)


@query(_PS + "SELECT channel, count(DISTINCT idx) AS publishes, CAST(sum(n) AS BIGINT) AS deliveries FROM (SELECT pub.idx, pub.channel, count(out.idx) AS n FROM pub LEFT JOIN out ON out.idx = pub.idx GROUP BY ALL) GROUP BY channel")
def pubsub_publish(spark, folder):
    return pubsub.deliveries_per_publish(_publishes(spark, folder), _subscriptions(spark, folder))


@query(_PS + "SELECT sub_id, seq, idx, kind, channel, payload FROM box WHERE seq BETWEEN 65 AND 128")
def pubsub_poll(spark, folder):
    return pubsub.poll(pubsub.mailboxes(_delivered(spark, folder)), after=64).select("sub_id", "seq", "idx", "kind", "channel", "payload")


@query(_PS + "SELECT sub_id, least(count(*), 128) AS kept, greatest(count(*) - 128, 0) AS dropped FROM out GROUP BY sub_id")
def pubsub_dropped(spark, folder):
    return pubsub.dropped(_delivered(spark, folder))


@query(_PS + "SELECT kind, topic, count(DISTINCT sub_id) AS subscribers FROM sub GROUP BY ALL")
def pubsub_channels(spark, folder):
    return pubsub.channels(_subscriptions(spark, folder))


_SUBLOG = "SELECT event_id AS idx, 'sub-' || (user_id % 30) AS sub_id, CASE WHEN event_type IN ('error', 'signup') THEN 'unsubscribe' ELSE 'subscribe' END AS cmd, CASE WHEN event_type <> 'error' THEN event_type || '.' || (event_id % 7) END AS topic FROM events"


@query(f"""WITH log AS ({_SUBLOG}), gone AS (SELECT sub_id, max(idx) AS idx FROM log WHERE topic IS NULL GROUP BY sub_id),
last AS (SELECT sub_id, topic, max(idx) AS idx, arg_max(cmd, idx) AS cmd FROM log WHERE topic IS NOT NULL GROUP BY ALL)
SELECT last.sub_id, 'channel' AS kind, topic FROM last LEFT JOIN gone ON gone.sub_id = last.sub_id WHERE cmd = 'subscribe' AND (gone.idx IS NULL OR last.idx > gone.idx)""")
def pubsub_unsubscribe(spark, folder):
    e = table(spark, folder, "events")
    topic = F.when(F.col("event_type") != "error", F.concat("event_type", F.lit("."), F.col("event_id") % 7))
    cmd = F.when(F.col("event_type").isin("error", "signup"), "unsubscribe").otherwise("subscribe")
    log = e.select(F.col("event_id").alias("idx"), F.concat(F.lit("sub-"), F.col("user_id") % 30).alias("sub_id"), cmd.alias("cmd"), F.lit("channel").alias("kind"), topic.alias("topic"))
    return pubsub.replay_subscriptions(log)


@query("SELECT CAST(user_id AS VARCHAR) AS sub_id, max(epoch_us(ts) // 1000) AS last_seen_ms FROM events GROUP BY user_id HAVING 1706659200000 - max(epoch_us(ts) // 1000) < 36000000")
def pubsub_reap(spark, folder):
    seen = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("sub_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("last_seen_ms"))
    return pubsub.reap(seen, NOW, 36_000_000)


# ---------------------------------------------------------------- slots and placement


def _crc_table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return str(out)


def _crc(text: str) -> str:
    chars = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {chars}), lambda a, b: xor(a >> 8, CAST(list_extract({_crc_table()}, CAST((xor(a, b) & 255) + 1 AS INT)) AS BIGINT))), 4294967295)"


_FNV = "list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), {}), lambda a, b: (xor(a, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT))"
_RING = f"""pts AS (SELECT shard, {_FNV.format("list_transform(string_split(shard || '#' || i, ''), lambda c: CAST(ord(c) AS UHUGEINT))")} AS h FROM (SELECT unnest(['shard-0', 'shard-1', 'shard-2']) AS shard), range(160) t(i)),
sl AS (SELECT slot, {_FNV.format("list_transform(range(8), lambda k: CAST((slot >> (8 * k)) & 255 AS UHUGEINT))")} AS h FROM (SELECT range AS slot FROM range(16384))),
own AS (SELECT CAST(sl.slot AS INT) AS slot, coalesce(pts.shard, (SELECT arg_min(shard, h) FROM pts)) AS shard FROM sl ASOF LEFT JOIN pts ON sl.h <= pts.h) """
SHARDS = ["shard-0", "shard-1", "shard-2"]


def _customer_keys(spark, folder):
    return table(spark, folder, "customer").select(F.concat(F.lit("{user:"), "c_custkey", F.lit("}:profile")).alias("key"))


@query(f"SELECT '{{user:' || c_custkey || '}}:profile' AS key, CAST({_crc("'user:' || c_custkey")} % 16384 AS BIGINT) AS slot FROM customer")
def slot_of_key(spark, folder):
    return _customer_keys(spark, folder).select("key", hash_slot(F.col("key")).alias("slot"))


@query("SELECT c_name AS name, c_name AS tag FROM customer")
def hash_tags(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_name").alias("name"), hash_tag(F.concat(F.lit("a{"), "c_name", F.lit("}b{c}"))).alias("tag"))


@query(f"WITH {_RING} SELECT * FROM own")
def ring_lookup(spark, folder):
    return placement.ring_lookup(spark, SHARDS)


@query(f"WITH {_RING} SELECT shard, count(*) AS slots FROM own GROUP BY shard UNION ALL SELECT 'shard-9', 0")
def slot_counts(spark, folder):
    shards = spark.createDataFrame([(s,) for s in [*SHARDS, "shard-9"]], "shard STRING")
    return placement.slot_counts(shards, placement.ring_lookup(spark, SHARDS))


def _owners(spark, n):
    return placement.owners_frame(spark, placement.Ring(SHARDS[:n]).assign())


@query("SELECT * FROM (VALUES ('shard-0', CAST(5735 AS BIGINT)), ('shard-1', 4914), ('shard-2', 5735)) t(shard, slots)")
def assign_slots(spark, folder):
    return placement.slot_counts(spark.createDataFrame([(s,) for s in SHARDS], "shard STRING"), _owners(spark, 3))


@query("SELECT * FROM (VALUES ('shard-1', 'shard-2', CAST(3177 AS BIGINT)), ('shard-0', 'shard-2', 2558), ('shard-0', 'shard-1', 309)) t(\"from\", \"to\", moves)")
def plan_moves(spark, folder):
    return placement.plan_moves(_owners(spark, 2), _owners(spark, 3)).groupBy("from", "to").agg(F.count(F.lit(1)).alias("moves"))


@query("SELECT * FROM (VALUES ('shard-1', 'shard-2', CAST(7 AS BIGINT), CAST(3177 AS BIGINT)), ('shard-0', 'shard-2', 5, 2558), ('shard-0', 'shard-1', 1, 309)) t(\"from\", \"to\", batches, slots)")
def batch_moves(spark, folder):
    batches = placement.batch_moves(placement.plan_moves(_owners(spark, 2), _owners(spark, 3)))
    return batches.groupBy("from", "to").agg(F.count(F.lit(1)).alias("batches"), F.sum(F.size("slots")).alias("slots"))


@query("SELECT CAST(6044 AS BIGINT) AS planned_moves, CAST(8602 AS BIGINT) AS before_0, CAST(7782 AS BIGINT) AS before_1, CAST(4914 AS BIGINT) AS after_1")
def rebalance_report(spark, folder):
    keys = _customer_keys(spark, folder).select(hash_slot(F.col("key")).alias("slot"))
    report = placement.rebalance_report(_owners(spark, 2), _owners(spark, 3), keys, dry_run=False)
    return report.select("planned_moves", F.col("slots_before")["shard-0"].alias("before_0"), F.col("slots_before")["shard-1"].alias("before_1"), F.col("slots_after")["shard-1"].alias("after_1"))


@query(
    f"""WITH {_RING}, cmds AS (SELECT event_id AS idx, CASE WHEN event_type = 'view' THEN 'GET' WHEN event_type = 'error' THEN 'PING' ELSE 'SET' END AS cmd, CASE WHEN event_type <> 'error' THEN 'user:' || user_id END AS k FROM events),
s AS (SELECT *, CASE WHEN k IS NULL THEN -1 ELSE {_crc("k")} % 16384 END AS slot FROM cmds)
SELECT s.idx, CAST(s.slot AS INT) AS slot, coalesce(own.shard, 'shard-0') AS shard, CASE WHEN s.slot >= 0 AND s.slot % 8 = 0 AND cmd = 'SET' THEN 'retry' ELSE 'serve' END AS decision FROM s LEFT JOIN own ON own.slot = s.slot"""
)
def route_decision(spark, folder):
    e = table(spark, folder, "events")
    cmd = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "error", "PING").otherwise("SET")
    args = F.when(F.col("event_type") != "error", F.create_map(F.lit("key"), F.concat(F.lit("user:"), "user_id"))).otherwise(F.create_map().cast("map<string,string>"))
    commands = e.select(F.col("event_id").alias("idx"), cmd.alias("cmd"), args.alias("args"))
    owners = placement.ring_lookup(spark, SHARDS)
    moving = owners.where("slot % 8 = 0").select("slot")
    return placement.route(commands, owners, moving, ["SET", "DEL"]).select("idx", "slot", "shard", "decision")


_MEMBERS = "SELECT 'region-' || n_regionkey AS shard, n_name AS node FROM nation"


def _members(spark, folder):
    return table(spark, folder, "nation").select(F.concat(F.lit("region-"), "n_regionkey").alias("shard"), F.col("n_name").alias("node"))


@query(f"WITH m AS ({_MEMBERS}), f AS (SELECT min(node) AS lo, max(node) AS hi FROM m) SELECT shard, string_agg(node, ',' ORDER BY CASE WHEN node = hi THEN 0 ELSE 1 END, node) AS candidates FROM m, f WHERE node <> lo GROUP BY shard")
def order_candidates(spark, folder):
    members = _members(spark, folder)
    low, high = members.agg(F.min("node"), F.max("node")).first()
    return placement.order_candidates(members, high, low).withColumn("candidates", F.array_join("candidates", ","))


@query(f"WITH {_RING} SELECT slot, CASE WHEN slot % 100 = 7 THEN 'no owner' ELSE 'unknown owner' END AS problem FROM own WHERE slot % 100 = 7 OR shard = 'shard-2'")
def validate_topology(spark, folder):
    owners = placement.ring_lookup(spark, SHARDS)
    owners = placement.with_owners(owners.where("slot % 100 <> 7"), owners.where("slot % 100 = 7").withColumn("shard", F.lit("")))
    shards = spark.createDataFrame([(s, f"{s}-a") for s in SHARDS[:2]], "shard STRING, node STRING")
    return placement.validate(owners, placement.remove_shard(shards, shards.where("shard = 'none'")))


@query("SELECT 'PONG' AS result")
def ping(spark, folder):
    return Engine(spark).execute("PING")


@query(f"WITH {_RING} SELECT '{{user:' || c_custkey || '}}:profile' AS key, 'user:' || c_custkey AS tag, own.slot AS slot, own.shard AS shard FROM customer JOIN own ON own.slot = {_crc("'user:' || c_custkey")} % 16384")
def locate_keys(spark, folder):
    return Engine(spark).locate(_customer_keys(spark, folder), placement.ring_lookup(spark, SHARDS))


@query(f"{_MEMBERS} UNION ALL SELECT 'region-9', 'new'")
def add_shard(spark, folder):
    new = spark.createDataFrame([("region-9", "new"), ("region-0", "other"), ("", "x"), ("region-8", None)], "shard STRING, node STRING")
    return placement.add_shard(_members(spark, folder), new)


@query(f"SELECT * FROM ({_MEMBERS}) WHERE shard <> 'region-3'")
def remove_shard(spark, folder):
    members = _members(spark, folder)
    return placement.remove_shard(members, members.where("shard = 'region-3'"))


@query(f"SELECT * FROM ({_MEMBERS}) WHERE shard IN ('region-0', 'region-2')")
def retire_shards(spark, folder):
    owners = spark.createDataFrame([(0, "region-0"), (1, "")], "slot INT, shard STRING")
    return placement.retire_shards(_members(spark, folder), owners, spark.createDataFrame([("region-2",)], "shard STRING"))


@query(f"SELECT DISTINCT shard FROM ({_MEMBERS}) WHERE node = (SELECT min(n_name) FROM nation)")
def shards_for_node(spark, folder):
    members = _members(spark, folder)
    return status.shards_for_node(members, members.agg(F.min("node")).first()[0])


_MOVES = "SELECT cluster_id, delivery_id, m.slot AS slot, m.\"from\" AS \"from\", m.\"to\" AS \"to\", m.state AS state FROM (SELECT cluster_id, delivery_id, unnest(migrations) AS m FROM topology_snapshots WHERE delivery_id IN (SELECT max(delivery_id) FROM topology_snapshots GROUP BY cluster_id))"


@query(f"SELECT DISTINCT cluster_id, slot, CASE WHEN slot % 2 = 0 THEN \"to\" ELSE \"from\" END AS \"from\", \"to\", CASE WHEN slot % 2 = 0 THEN 'cleanup' ELSE state END AS state FROM ({_MOVES}) WHERE slot IS NOT NULL")
def with_migrations(spark, folder):
    """The markers of every cluster's last delivery, those of even slots replaced."""
    t = table(spark, folder, "topology_snapshots")
    last = t.join(t.groupBy("cluster_id").agg(F.max("delivery_id").alias("delivery_id")).select("delivery_id"), "delivery_id", "left_semi")
    markers = last.select("cluster_id", F.explode("migrations").alias("m")).select("cluster_id", "m.*").where("slot IS NOT NULL").distinct()
    changes = markers.where("slot % 2 = 0").withColumn("from", F.col("to")).withColumn("state", F.lit("cleanup")).distinct()
    return placement.with_migrations(markers, changes, ["cluster_id", "slot"])


@query(_GEO + "SELECT CAST(id AS VARCHAR) AS member, CAST((standard >> 2) << 2 AS BIGINT) AS bits FROM bits")
def geo_hash_decode(spark, folder):
    return geo_hash(spark, folder).select("member", geo.geohash_bits(F.col("hash")).alias("bits"))


@query(
    """WITH v AS (SELECT cluster_id, max(version) AS version FROM topology_snapshots GROUP BY cluster_id), d AS (SELECT v.cluster_id, v.version, min(delivery_id) AS delivery_id FROM v JOIN topology_snapshots t ON t.cluster_id = v.cluster_id AND t.version = v.version GROUP BY ALL)
SELECT d.cluster_id, d.version, d.delivery_id, t.slot_count, t.vnodes, t.epsilon, array_to_string(list_transform(t.slots, lambda s: coalesce(s, '')), ',') AS slots, array_to_string(list_sort(map_keys(t.shards)), ',') AS shards FROM d JOIN topology_snapshots t ON t.delivery_id = d.delivery_id"""
)
def install_topology(spark, folder):
    """The whole newest document of each cluster; of several deliveries of one version the first is installed."""
    t = table(spark, folder, "topology_snapshots").select("cluster_id", "version", "delivery_id", "slot_count", "vnodes", "epsilon", F.array_join("slots", ",", "").alias("slots"), F.array_join(F.sort_array(F.map_keys("shards")), ",").alias("shards"))
    first = t.groupBy("cluster_id", "version").agg(F.min("delivery_id").alias("delivery_id"))
    t = t.join(first.select("delivery_id"), "delivery_id", "left_semi").select(*t.columns)
    return placement.install(t.where("version % 2 = 0"), t.where("version % 2 = 1"), "cluster_id")


@query(
    _KV
    + f""", live AS (SELECT *, CAST({_crc("key")} % 16384 AS BIGINT) AS slot FROM state WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW})
SELECT slot, 'strings' AS store, key, CAST(0 AS BIGINT) AS chunk, '{{"value":"' || value || '"' || CASE WHEN expire_at_ms IS NULL THEN '' ELSE ',"expire_at_ms":' || expire_at_ms END || '}}' AS entry FROM live WHERE slot < 8192"""
)
def dump_slot(spark, folder):
    return slots.dump({"strings": strings.replay(kv_log(spark, folder))}, list(range(8192)), NOW)


@query("SELECT o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS member, arg_max(round(o_totalprice, 0), o_orderkey) AS score FROM orders GROUP BY ALL")
def restore_zsets(spark, folder):
    state = {"zsets": _z(spark, folder)}
    dumped = slots.dump(state, list(range(16_384)), NOW, chunk=100)
    return slots.restore({"zsets": state["zsets"].where("score < 50000")}, dumped, NOW)["zsets"]


@query(_KV + f"SELECT key, value, expire_at_ms FROM state WHERE NOT (expire_at_ms IS NOT NULL AND expire_at_ms <= {NOW} AND {_crc('key')} % 16384 < 8192)")
def restore_slot(spark, folder):
    state = {"strings": strings.replay(kv_log(spark, folder))}
    wanted = list(range(8192))
    return slots.restore(slots.delete_slots(state, wanted), slots.dump(state, wanted, NOW), NOW)["strings"]


@query(_KV + f"SELECT key, value, expire_at_ms FROM state WHERE {_crc('key')} % 16384 >= 8192")
def delete_slot(spark, folder):
    return slots.delete_slots({"strings": strings.replay(kv_log(spark, folder))}, list(range(8192)))["strings"]


# ---------------------------------------------------------------- status

_LATEST = """WITH latest AS (SELECT node_id, arg_max({'probed_at': probed_at, 'shards': shards}, (probed_at, probe_id)) AS p FROM node_probes WHERE reachable AND node_id IS NOT NULL GROUP BY node_id),
rep AS (SELECT node_id, p.probed_at AS probed_at, s FROM (SELECT node_id, p, unnest(p.shards) AS s FROM latest) WHERE s IS NOT NULL AND s.shard_id IS NOT NULL),
mem AS (SELECT shard, node FROM (SELECT s.shard_id AS shard, unnest(s.members) AS node FROM rep) WHERE node IS NOT NULL GROUP BY ALL),
own AS (SELECT s AS shard, count(*) AS n FROM (SELECT unnest(slots) AS s FROM topology_snapshots WHERE delivery_id IN (SELECT max(delivery_id) FROM topology_snapshots GROUP BY cluster_id)) GROUP BY s),
seen AS (SELECT mem.shard, count(*) AS members, count(rep.node_id) AS healthy, coalesce(max(rep.s.term), 0) AS term, arg_max(rep.s.leader_id, mem.node) FILTER (rep.s.leader_id <> '') AS leader
  FROM mem LEFT JOIN rep ON rep.node_id = mem.node AND rep.s.shard_id = mem.shard GROUP BY mem.shard),
views AS (SELECT seen.*, CAST(coalesce(own.n, 0) AS BIGINT) AS slots, coalesce(own.n, 0) / 16384.0::DOUBLE AS share FROM seen LEFT JOIN own ON own.shard = seen.shard) """


def _views(spark, folder):
    reported = status.reported_shards(status.latest_probes(table(spark, folder, "node_probes")))
    members = reported.select(F.col("shard_id").alias("shard"), F.explode("members").alias("node")).where("node IS NOT NULL").distinct()
    t = table(spark, folder, "topology_snapshots")
    last = t.groupBy("cluster_id").agg(F.max("delivery_id").alias("delivery_id")).select("delivery_id")
    owned = t.join(last, "delivery_id", "left_semi").select(F.posexplode("slots").alias("slot", "shard"))
    return status.shard_views(members, owned, reported, 16_384)


@query(_LATEST + "SELECT * FROM views")
def shard_views(spark, folder):
    return _views(spark, folder)


@query(_LATEST + "SELECT count(*) AS shards, count(*) FILTER (coalesce(leader, '') <> '') AS with_leader, count(*) FILTER (healthy > members // 2) AS with_quorum, CAST(sum(healthy) AS BIGINT) AS healthy, max(slots) - min(slots) AS spread FROM views")
def status_roll_up(spark, folder):
    return status.roll_up(_views(spark, folder))


@query("SELECT node_id AS node, arg_max(address, (probed_at, probe_id)) AS address FROM node_probes WHERE node_id IS NOT NULL GROUP BY node_id")
def node_addresses(spark, folder):
    p = table(spark, folder, "node_probes")
    return status.node_addresses(p.select(F.col("node_id").alias("node"), "address", F.struct("probed_at", "probe_id").alias("ord")))


@query(
    """WITH m AS (SELECT 'region-' || n_regionkey AS shard, n_name AS node, n_nationkey AS k FROM nation),
cur AS (SELECT shard, node, k % 3 <> 1 OR k % 2 = 0 AS voter FROM m WHERE k % 4 <> 3), des AS (SELECT shard, node FROM m WHERE k % 3 <> 1),
r AS (SELECT coalesce(c.shard, d.shard) AS shard, coalesce(c.node, d.node) AS node, c.voter, d.node IS NOT NULL AS want FROM cur c FULL JOIN des d ON c.shard = d.shard AND c.node = d.node),
g AS (SELECT shard, min(node) FILTER (want AND voter IS NULL) AS a, count(*) FILTER (want AND NOT coalesce(voter, false)) AS w, min(node) FILTER (NOT want AND NOT voter) AS l, min(node) FILTER (NOT want AND voter) AS v, count(*) FILTER (voter) AS n FROM r GROUP BY shard)
SELECT shard, CASE WHEN a IS NOT NULL THEN 'add learner' WHEN l IS NOT NULL THEN 'drop learner' ELSE 'remove voter' END AS step, coalesce(a, l, v) AS node FROM g WHERE a IS NOT NULL OR (w = 0 AND (l IS NOT NULL OR (v IS NOT NULL AND n > 1)))"""
)
def next_membership_step(spark, folder):
    members = table(spark, folder, "nation").select(F.concat(F.lit("region-"), "n_regionkey").alias("shard"), F.col("n_name").alias("node"), F.col("n_nationkey").alias("k"))
    current = members.where("k % 4 <> 3").withColumn("voter", F.expr("k % 3 <> 1 OR k % 2 = 0"))
    return status.next_step(current, members.where("k % 3 <> 1"))


@query("SELECT 'c' || n_nationkey AS shard, CASE WHEN n_nationkey % 3 = 0 THEN 'start' ELSE 'retire' END AS action FROM nation WHERE (n_nationkey % 3 = 0) <> (n_nationkey % 2 = 0)")
def reconcile_groups(spark, folder):
    n = table(spark, folder, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("shard"), F.col("n_nationkey").alias("n"))
    return status.reconcile(n.where("n % 3 = 0").select("shard"), n.where("n % 2 = 0").select("shard"))


# ---------------------------------------------------------------- replicated logs


def _progress(spark, folder):
    s = table(spark, folder, "shard_status").where("shard_id IS NOT NULL AND node_id IS NOT NULL AND commit_index IS NOT NULL")
    return s.groupBy(F.col("shard_id").alias("shard"), F.col("node_id").alias("node")).agg(F.max("commit_index").alias("match_index"), F.max("reported_at").alias("last_ack")).withColumn("is_voter", F.lit(True))


@query("""WITH p AS (SELECT shard_id AS shard, node_id AS node, max(commit_index) AS m FROM shard_status WHERE commit_index IS NOT NULL AND shard_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL),
q AS (SELECT shard, list_reverse_sort(list(m))[count(*) // 2 + 1] AS most FROM p GROUP BY shard), t AS (SELECT shard, max(term) AS term FROM wal_leader GROUP BY shard)
SELECT w.shard, max(w.idx) AS commit_index FROM wal_leader w JOIN q ON q.shard = w.shard JOIN t ON t.shard = w.shard AND t.term = w.term WHERE w.idx <= q.most GROUP BY w.shard""")
def quorum_commit(spark, folder):
    log = table(spark, folder, "wal_leader").select("shard", "idx", "term")
    terms = log.groupBy("shard").agg(F.max("term").alias("current_term"))
    return consensus.commit_index(_progress(spark, folder).join(terms, "shard"), log)


@query("""WITH p AS (SELECT shard_id AS shard, node_id AS node, max(reported_at) AS a FROM shard_status WHERE commit_index IS NOT NULL AND shard_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL)
SELECT shard, count(*) FILTER (epoch_us(TIMESTAMP '2017-01-03') // 1000 - epoch_us(a) // 1000 < 86400000) + 1 >= (count(*) + 1) // 2 + 1 AS held FROM p GROUP BY shard""")
def leader_lease(spark, folder):
    progress = _progress(spark, folder).withColumn("last_ack", F.col("last_ack").cast("timestamp"))
    return consensus.lease_held(progress, "2017-01-03", 86_400_000)


@query("""WITH a AS (SELECT shard, idx, max(term) AS t FROM wal_leader GROUP BY ALL), b AS (SELECT shard, idx, max(term) AS t FROM wal_follower GROUP BY ALL)
SELECT coalesce(a.shard, b.shard) AS shard, min(coalesce(a.idx, b.idx)) AS idx FROM a FULL JOIN b ON a.shard = b.shard AND a.idx = b.idx WHERE a.t IS DISTINCT FROM b.t GROUP BY 1""")
def log_divergence(spark, folder):
    return consensus.first_divergence(table(spark, folder, "wal_leader"), table(spark, folder, "wal_follower"))


@query("""WITH a AS (SELECT shard, max((term, idx)) AS e FROM wal_leader GROUP BY shard), b AS (SELECT shard, max((term, idx)) AS e FROM wal_follower GROUP BY shard)
SELECT shard, a.e >= b.e AS left_wins FROM a JOIN b USING (shard)""")
def log_up_to_date(spark, folder):
    return consensus.up_to_date(table(spark, folder, "wal_leader"), table(spark, folder, "wal_follower"))


@query("SELECT shard_id AS shard, term, count(DISTINCT node_id) AS leaders FROM shard_status WHERE role = 'leader' AND node_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT node_id) > 1")
def terms_with_two_leaders(spark, folder):
    return consensus.terms_with_two_leaders(table(spark, folder, "shard_status"))


@query("WITH o AS (SELECT shard_id AS shard, node_id AS node, max(commit_index) AS m FROM shard_status WHERE commit_index IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL) SELECT shard, node, max(m) OVER (PARTITION BY shard) - m AS lag FROM o")
def replication_lag(spark, folder):
    return consensus.replication_lag(table(spark, folder, "shard_status"))


@query("SELECT shard, idx, max(term) AS term FROM wal_leader WHERE idx BETWEEN 10 AND 40 GROUP BY ALL")
def log_entries(spark, folder):
    return consensus.entries(consensus.read_at(table(spark, folder, "wal_leader").select("shard", "idx", "term"), 1000), 10, 40)


@query("SELECT shard, max(idx) AS idx, arg_max(term, (idx, term)) AS term FROM command_log GROUP BY shard")
def last_entry(spark, folder):
    return consensus.last_entry(table(spark, folder, "command_log"))




@query("WITH raw AS (SELECT shard, idx, term, decode(data) AS d FROM command_log WHERE cmd = '__raft_conf__' AND data IS NOT NULL), c AS (SELECT shard, idx, term, json_keys(d, '$.voters') AS v, json_keys(d, '$.learners') AS l FROM raw WHERE json_valid(d)) SELECT shard, max(idx) AS idx, array_to_string(list_sort(arg_max(v, (idx, term))), ',') AS voters, array_to_string(list_sort(arg_max(l, (idx, term))), ',') AS learners FROM c GROUP BY shard")
def latest_configuration(spark, folder):
    c = consensus.latest_configuration(table(spark, folder, "command_log"))
    return c.select("shard", "idx", F.array_join("voters", ",").alias("voters"), F.array_join("learners", ",").alias("learners"))


@query("""WITH c AS (SELECT shard, idx, min(decode(data)) AS d FROM command_log WHERE cmd = '__raft_conf__' AND data IS NOT NULL GROUP BY shard, idx), v AS (SELECT shard, idx, json_keys(d, '$.voters') AS v FROM c WHERE json_valid(d) AND json_type(d, '$.voters') = 'OBJECT'),
b AS (SELECT *, lag(v) OVER (PARTITION BY shard ORDER BY idx) AS p FROM v)
SELECT shard, idx, changed FROM (SELECT shard, idx, CAST(len(list_filter(v, lambda x: NOT list_contains(p, x))) + len(list_filter(p, lambda x: NOT list_contains(v, x))) AS BIGINT) AS changed FROM b WHERE p IS NOT NULL) WHERE changed > 1""")
def unsafe_configuration_steps(spark, folder):
    log = table(spark, folder, "command_log").where("cmd = '__raft_conf__' AND data IS NOT NULL")
    return consensus.unsafe_steps(log.groupBy("shard", "idx").agg(F.lit("__raft_conf__").alias("cmd"), F.min(F.decode("data", "UTF-8")).alias("data")))
