"""Queries that replay mixed logs: commands of all stores, use counters, limiters, drained mailboxes, migrations and log merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.operators import pubsub, ratelimit, replay, slots, strings
from slotweave.plans import consensus, migration, placement
from slotweave.queries import Registry, table
from slotweave.queries.cluster import _PS, SHARDS, _calls, _crc, _delivered
from slotweave.queries.stores import _KV, NOW, _set_state, _z, kv_log

registry = Registry()
query = registry.add

# ---------------------------------------------------------------- one log of mixed commands


def _log(spark, folder):
    """Every event as a command in the JSON that shards write."""
    e = table(spark, folder, "events")
    t, n, u = F.col("event_type"), F.col("event_id"), F.col("user_id")
    text = lambda x: x.cast("string")
    key = lambda sign, x: F.concat(F.lit(sign), x)
    none = F.lit(None).cast("string")
    member, other = key("m", n % 40), key("m", (n + 7) % 40)
    each = {
        "z": (
            F.when(t == "error", "ZREM").when(t.isin("click", "signup"), "ZINCRBY").otherwise("ZADD"),
            {
                "key": key("z", u % 50), "member": member, "1": F.when(t == "error", other),
                "score": F.when(t.isin("view", "purchase"), text(n % 1000)), "increment": F.when(t == "click", text(n % 100)).when(t == "signup", text(-(n % 50))),
                "nx": F.when((t == "view") & (n % 4 == 0), "true"), "xx": F.when((t == "view") & (n % 4 == 1), "true"),
            },
        ),
        "s": (F.when(t == "error", "SREM").otherwise("SADD"), {"key": key("k", u % 40), "value": key("v", n % 997)}),
        "b": (F.when(t == "error", "SL_DELETE").otherwise("SL_ADD"), {"key": key("b", u % 30), "member": member, "score": F.when(t != "error", text(n % 100)), "data": F.when(t != "error", t)}),
        "k": (
            F.when(t == "error", "DEL").when(t.isin("view", "signup"), "SET").otherwise("INCR"),
            {"key": key("u", u % 30), "value": F.when(t == "view", text(n)).when(t == "signup", F.concat(F.lit("x"), n % 3)), "1": F.when(t == "error", key("u", (u + 3) % 30)), "2": none},
        ),
    }
    log = None
    for i, (cmd, args) in enumerate(each.values()):
        named = F.map_filter(F.create_map(*(x for name, value in args.items() for x in (F.lit(name), value))), lambda _, v: v.isNotNull())
        rows = e.select(F.concat(F.lit("s"), u % 4).alias("shard"), (n * 4 + i).alias("idx"), F.lit(1).cast("bigint").alias("term"), F.encode(F.to_json(F.struct(cmd.alias("cmd"), named.alias("args"))), "UTF-8").alias("data"))
        log = rows if log is None else log.unionByName(rows)
    return log


_E = "SELECT event_id AS e, 's' || (user_id % 4) AS shard, user_id AS u, event_type AS t FROM events"


@query(
    f"""WITH ch AS (SELECT shard, 'z' || (u % 50) AS key, 'm' || (e % 40) AS member, e AS idx, CASE t WHEN 'click' THEN 'add' WHEN 'signup' THEN 'add' WHEN 'error' THEN 'end' WHEN 'purchase' THEN 'put'
  ELSE CASE e % 4 WHEN 0 THEN 'put_new' WHEN 1 THEN 'put_old' ELSE 'put' END END AS op, CAST(CASE t WHEN 'click' THEN e % 100 WHEN 'signup' THEN -(e % 50) ELSE e % 1000 END AS DOUBLE) AS n FROM ({_E})
  UNION ALL SELECT shard, 'z' || (u % 50), 'm' || ((e + 7) % 40), e, 'end', CAST(0 AS DOUBLE) FROM ({_E}) WHERE t = 'error'),
f AS (SELECT shard, key, member, list_reduce(list_prepend({{'op': 'none', 'n': CAST(0 AS DOUBLE)}}, list({{'op': op, 'n': n}} ORDER BY idx)), lambda a, b: CASE
  WHEN b.op = 'put' OR (b.op = 'put_new' AND a.op <> 'live') OR (b.op = 'put_old' AND a.op = 'live') THEN {{'op': 'live', 'n': b.n}} WHEN b.op = 'put_new' OR b.op = 'put_old' THEN a
  WHEN b.op = 'add' THEN {{'op': 'live', 'n': CASE WHEN a.op = 'live' THEN a.n ELSE CAST(0 AS DOUBLE) END + b.n}} ELSE {{'op': 'none', 'n': CAST(0 AS DOUBLE)}} END) AS r FROM ch GROUP BY ALL)
SELECT shard, key, member, r.n AS score FROM f WHERE r.op = 'live'"""
)
def replay_zsets_mixed(spark, folder):
    return replay.zsets(_log(spark, folder), block=4096)


@query(f"SELECT shard, 'k' || (u % 40) AS key, 'v' || (e % 997) AS member FROM ({_E}) GROUP BY ALL HAVING arg_max(t <> 'error', e)")
def replay_sets(spark, folder):
    return replay.sets(_log(spark, folder))


@query(
    f"""WITH ch AS (SELECT shard, 'b' || (u % 30) AS key, 'm' || (e % 40) AS member, e, t, CAST(e % 100 AS BIGINT) AS n FROM ({_E})),
f AS (SELECT shard, key, member, list_reduce(list_prepend({{'t': 'none', 'n': CAST(0 AS BIGINT)}}, list({{'t': t, 'n': n}} ORDER BY e)), lambda a, b: CASE WHEN b.t = 'error' THEN {{'t': 'none', 'n': CAST(0 AS BIGINT)}} ELSE {{'t': b.t, 'n': a.n + b.n}} END) AS r FROM ch GROUP BY ALL)
SELECT shard, key, member, r.n AS score, r.t AS data FROM f WHERE r.t <> 'none'"""
)
def replay_boards(spark, folder):
    return replay.boards(_log(spark, folder), block=4096)


@query(
    f"""WITH ch AS (SELECT shard, 'u' || (u % 30) AS key, e, CASE t WHEN 'error' THEN 'del' WHEN 'view' THEN 'set' WHEN 'signup' THEN 'set' ELSE 'incr' END AS op, CASE t WHEN 'view' THEN CAST(e AS VARCHAR) WHEN 'signup' THEN 'x' || (e % 3) ELSE '' END AS v FROM ({_E})
  UNION ALL SELECT shard, 'u' || ((u + 3) % 30), e, 'del', '' FROM ({_E}) WHERE t = 'error'),
f AS (SELECT shard, key, list_reduce(list_prepend({{'op': 'none', 'v': ''}}, list({{'op': op, 'v': v}} ORDER BY e)), lambda a, b: CASE b.op WHEN 'set' THEN {{'op': 'live', 'v': b.v}} WHEN 'del' THEN {{'op': 'none', 'v': ''}}
  ELSE CASE WHEN a.op = 'none' THEN {{'op': 'live', 'v': '1'}} WHEN TRY_CAST(a.v AS BIGINT) IS NULL THEN a ELSE {{'op': 'live', 'v': CAST(TRY_CAST(a.v AS BIGINT) + 1 AS VARCHAR)}} END END) AS r FROM ch GROUP BY ALL)
SELECT shard, key, r.v AS value FROM f WHERE r.op = 'live'"""
)
def replay_strings(spark, folder):
    return replay.strings(_log(spark, folder))


# ---------------------------------------------------------------- use counters


@query(
    """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS idx, epoch_us(ts) // 1000 AS ts, CAST(CAST('0x' || substr(md5('7|' || user_id || '|' || event_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS p FROM events),
f AS (SELECT key, list_reduce(list_prepend({'ts': CAST(-1 AS BIGINT), 'f': CAST(0 AS BIGINT), 'p': CAST(0 AS DOUBLE)}, list({'ts': ts, 'f': CAST(0 AS BIGINT), 'p': p} ORDER BY idx)), lambda x, y: CASE WHEN x.ts < 0 THEN {'ts': y.ts, 'f': CAST(5 AS BIGINT), 'p': y.p}
  ELSE {'ts': y.ts, 'f': greatest(x.f - greatest((y.ts - x.ts) // 60000, 0), 0) + CASE WHEN greatest(x.f - greatest((y.ts - x.ts) // 60000, 0), 0) < 255 AND y.p < 1 / (greatest(x.f - greatest((y.ts - x.ts) // 60000, 0), 0) * 10 + 1) THEN 1 ELSE 0 END, 'p': y.p} END) AS r FROM a GROUP BY key)
SELECT key, r.ts AS last_access_ms, CAST(r.f AS BIGINT) AS frequency FROM f"""
)
def kv_lfu_touch(spark, folder):
    e = table(spark, folder, "events")
    return strings.use_counters(e.select(F.col("event_id").alias("idx"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("user_id").cast("string").alias("key")), seed=7)


# ---------------------------------------------------------------- rate limiters


def limiter_sql(kind: str, limit: int, window: int) -> str:
    """Each call's reply by a fold over the calls up to it."""
    started = {
        "fixed": f"CASE WHEN a.n >= {limit} AND b.t - a.s >= {window} THEN b.t ELSE a.s END",
        "sliding": f"CASE WHEN a.n > 0 AND b.t - a.s > {window} THEN b.t ELSE a.s END",
    }.get(kind)
    if kind == "token":
        filled = f"CASE WHEN b.t > a.s THEN least(CAST({limit} AS DOUBLE), a.n + (b.t - a.s) / 1000 * {limit} / {window // 1000}) ELSE a.n END"
        step = f"{{'t': b.t, 's': greatest(a.s, b.t), 'n': {filled} - CASE WHEN {filled} >= 1 THEN 1 ELSE 0 END, 'ok': {filled} >= 1}}"
        first, left, wait = f"CAST({limit} AS DOUBLE)", "CAST(trunc(r.n) AS BIGINT)", "CASE WHEN r.ok THEN 0 ELSE CAST(trunc((1 - r.n) * 1000) AS BIGINT) END"
    else:
        count = f"CASE WHEN {started} <> a.s THEN 0 ELSE a.n END"
        step = f"{{'t': b.t, 's': {started}, 'n': {count} + CASE WHEN {count} < {limit} THEN 1 ELSE 0 END, 'ok': {count} < {limit}}}"
        first, left, wait = "CAST(0 AS DOUBLE)", f"CAST({limit} - r.n AS BIGINT)", f"CASE WHEN r.ok THEN 0 ELSE {window} - (r.t - r.s) END"
    return f"""WITH c AS (SELECT event_id AS idx, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS t FROM events),
l AS (SELECT key, list(idx ORDER BY idx) AS ids, list({{'t': t, 's': t, 'n': {first}, 'ok': true}} ORDER BY idx) AS l FROM c GROUP BY key),
f AS (SELECT key, ids[i] AS idx, list_reduce(list_prepend(l[1], l[1:i]), lambda a, b: {step}) AS r FROM (SELECT key, ids, l, unnest(range(1, len(l) + 1)) AS i FROM l))
SELECT idx, key, r.ok AS allowed, {left} AS remaining, CAST({wait} AS BIGINT) AS retry_after_ms, '{kind}' AS type FROM f"""


@query(limiter_sql("fixed", 3, 86_400_000))
def ratelimit_fixed(spark, folder):
    return ratelimit.check(_calls(spark, folder, "fixed", 3, 86_400_000))


@query(limiter_sql("sliding", 3, 86_400_000))
def ratelimit_sliding(spark, folder):
    return ratelimit.check(_calls(spark, folder, "sliding", 3, 86_400_000))


@query(limiter_sql("token", 2, 86_400_000))
def ratelimit_token(spark, folder):
    return ratelimit.check(_calls(spark, folder, "token", 2, 86_400_000))


@query(limiter_sql("fixed", 3, 86_400_000).replace("list_prepend(l[1], l[1:i])", "list_prepend({'t': l[1].t, 's': l[1].t - 3600000, 'n': CAST(0 AS DOUBLE), 'ok': true}, l[1:i])"))
def ratelimit_init(spark, folder):
    """Every limiter is started an hour before its first call."""
    calls = _calls(spark, folder, "fixed", 3, 86_400_000)
    first = calls.groupBy("key").agg(F.min("idx").alias("idx"), F.min_by("ts_ms", "idx").alias("ts_ms"))
    starts = first.select((F.col("idx") - 1).alias("idx"), (F.col("ts_ms") - 3_600_000).alias("ts_ms"), "key", F.lit(3).cast("bigint").alias("limit"), F.lit(86_400_000).cast("bigint").alias("window_ms"), F.lit("fixed").alias("type"), F.lit("INIT").alias("cmd"))
    return ratelimit.check(calls.withColumn("cmd", F.lit("CHECK")).unionByName(starts))


# ---------------------------------------------------------------- mailboxes that are polled


@query(
    _PS.replace("WITH pub", "WITH RECURSIVE pub", 1)
    + """, ev AS (SELECT sub_id, idx, 'copy' AS event, concat_ws('|', kind, channel, pattern) AS copy, CAST(0 AS BIGINT) AS most FROM out
  UNION ALL SELECT 'sub-' || (user_id % 25), event_id, 'poll', '', 5 + event_id % 20 FROM events WHERE event_type = 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY idx, event, copy) AS r FROM ev),
st AS (SELECT DISTINCT sub_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS idx, '' AS event, '' AS copy, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS read, CAST(0 AS BIGINT) AS lost, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS delivered, CAST(NULL AS BIGINT) AS dropped FROM ev
  UNION ALL SELECT r.sub_id, r.r, r.idx, r.event, r.copy, CASE WHEN r.event = 'copy' AND taken - read < 128 THEN taken + 1 ELSE taken END, CASE WHEN r.event = 'poll' THEN read + least(r.most, taken - read) ELSE read END,
    CASE WHEN r.event = 'poll' THEN 0 WHEN taken - read >= 128 THEN lost + 1 ELSE lost END, CASE WHEN r.event = 'copy' AND taken - read < 128 THEN taken + 1 END, CASE WHEN r.event = 'poll' THEN least(r.most, taken - read) END, CASE WHEN r.event = 'poll' THEN lost END
  FROM st JOIN r ON r.sub_id = st.sub_id AND r.r = st.r + 1)
SELECT sub_id, idx, event, copy, seq, delivered, dropped FROM st WHERE r > 0"""
)
def pubsub_drained(spark, folder):
    e = table(spark, folder, "events").where("event_type = 'error'")
    polls = e.select(F.col("event_id").alias("idx"), F.concat(F.lit("sub-"), F.col("user_id") % 25).alias("sub_id"), (F.col("event_id") % 20 + 5).alias("most"))
    return pubsub.drained(_delivered(spark, folder), polls)


# ---------------------------------------------------------------- migrations and topologies


def _cluster(spark, folder):
    state = {"strings": strings.replay(kv_log(spark, folder)), "sets": _set_state(spark, folder), "zsets": _z(spark, folder)}
    old = state["strings"].where("CAST(key AS BIGINT) % 3 = 0").select("key", F.lit("old").alias("value"), F.lit(None).cast("bigint").alias("expire_at_ms"))
    there = {"strings": old, "sets": state["sets"].where("key = '1'"), "zsets": state["zsets"].where("key = 'none'")}
    none = spark.createDataFrame([], "slot INT, from STRING, to STRING, state STRING")
    return migration.Cluster(7, placement.ring_lookup(spark, SHARDS), none, {"shard-0": state, "shard-1": there})


def _items(cluster):
    found = None
    for shard, state in cluster.states.items():
        items = {"strings": F.col("value"), "sets": F.col("member"), "zsets": F.concat("member", F.lit(":"), F.col("score").cast("bigint"))}
        for store, item in items.items():
            rows = state[store].select(F.lit(shard).alias("shard"), F.lit(store).alias("store"), "key", item.alias("item"))
            found = rows if found is None else found.unionByName(rows)
    return found


_STATES = (
    _KV
    + f""", kv AS (SELECT key, value, coalesce(expire_at_ms > {NOW}, true) AS alive FROM state),
st AS (SELECT CAST(user_id % 40 AS VARCHAR) AS key, CAST(event_id // 97 AS VARCHAR) AS member FROM events GROUP BY ALL HAVING arg_max(event_type <> 'error', event_id)),
zt AS (SELECT o_orderpriority AS key, CAST(o_custkey AS VARCHAR) || ':' || CAST(CAST(arg_max(round(o_totalprice, 0), o_orderkey) AS BIGINT) AS VARCHAR) AS item FROM orders GROUP BY o_orderpriority, o_custkey),
src AS (SELECT 'strings' AS store, key, value AS item, alive FROM kv UNION ALL SELECT 'sets', key, member, true FROM st UNION ALL SELECT 'zsets', key, item, true FROM zt),
dst AS (SELECT 'strings' AS store, key, 'old' AS item FROM kv WHERE CAST(key AS BIGINT) % 3 = 0 UNION ALL SELECT 'sets', key, member FROM st WHERE key = '1'),
hashed AS (SELECT *, {_crc("key")} % 16384 < 8192 AS moves FROM src)
"""
)


@query(
    _STATES
    + """SELECT 'shard-0' AS shard, store, key, item FROM hashed WHERE NOT moves UNION ALL SELECT 'shard-1', store, key, item FROM hashed WHERE moves AND alive
UNION ALL SELECT 'shard-1', store, key, item FROM dst WHERE (store, key) NOT IN (SELECT (store, key) FROM hashed WHERE moves AND alive)"""
)
def migrate_batch(spark, folder):
    """Half of the slots move from one shard to another: strings, sets and sorted sets of both afterwards."""
    return _items(migration.migrate(_cluster(spark, folder), "shard-0", "shard-1", list(range(8192)), NOW)[0])


@query(_STATES + "SELECT 'shard-0' AS shard, store, key, item FROM src UNION ALL SELECT 'shard-1', store, key, item FROM dst")
def migrate_abandoned(spark, folder):
    """The same move, given up after the dump: nothing has changed."""
    return _items(migration.migrate(_cluster(spark, folder), "shard-0", "shard-1", list(range(8192)), NOW, fail="restore")[0])


@query(
    """WITH c AS (SELECT cluster_id, max(version) AS version FROM topology_snapshots WHERE version % 2 = 0 GROUP BY cluster_id), o AS (SELECT cluster_id, max(version) AS version FROM topology_snapshots WHERE version % 2 = 1 GROUP BY cluster_id)
SELECT coalesce(c.cluster_id, o.cluster_id) AS cluster_id, CASE WHEN o.version IS NULL THEN c.version ELSE greatest(o.version, coalesce(c.version + 1, o.version)) END AS version FROM c FULL JOIN o ON c.cluster_id = o.cluster_id"""
)
def update_topology(spark, folder):
    t = table(spark, folder, "topology_snapshots").select("cluster_id", "version", "slot_count")
    current = placement.install(t.where("version % 2 = 0"), t.where("version IS NULL"), "cluster_id")
    return placement.update(current, t.where("version % 2 = 1"), "cluster_id").select("cluster_id", "version")


@query(
    """WITH f AS (SELECT shard, idx, max(term) AS term FROM wal_follower GROUP BY ALL), l AS (SELECT shard, idx, max(term) AS term FROM wal_leader GROUP BY ALL),
fits AS (SELECT l.shard FROM l JOIN f ON f.shard = l.shard AND f.idx = 5 AND f.term = l.term WHERE l.idx = 5),
new AS (SELECT l.* FROM l JOIN fits ON fits.shard = l.shard WHERE idx > 5),
cut AS (SELECT new.shard, min(new.idx) AS c FROM new LEFT JOIN f ON f.shard = new.shard AND f.idx = new.idx WHERE f.term IS NULL OR f.term <> new.term GROUP BY new.shard)
SELECT f.shard, f.idx, f.term FROM f LEFT JOIN cut ON cut.shard = f.shard WHERE c IS NULL OR f.idx < c UNION ALL SELECT new.shard, new.idx, new.term FROM new JOIN cut ON cut.shard = new.shard WHERE new.idx >= c"""
)
def log_merge(spark, folder):
    """What the followers' logs hold after the leaders' entries behind index 5 have been appended."""
    once = lambda name: table(spark, folder, name).groupBy("shard", "idx").agg(F.max("term").alias("term"))
    leader, follower = once("wal_leader"), once("wal_follower")
    previous = leader.where("idx = 5").select("shard", F.col("idx").alias("prev_idx"), F.col("term").alias("prev_term"))
    return consensus.merge_entries(follower, leader.where("idx > 5"), previous)


@query(
    _KV
    + f"""SELECT CAST({_crc("key")} % 16384 AS BIGINT) AS slot, 'skipped' AS store, key, CAST(0 AS BIGINT) AS chunk, '{{"type":"' || kind || '"}}' AS entry FROM ids, (SELECT unnest(['bloom', 'cms', 'ratelimit']) AS kind)
  WHERE {_crc("key")} % 16384 < 4096"""
)
def dump_skipped(spark, folder):
    """The keys of stores that a dump can only name."""
    keys = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"))
    return slots.dump({store: keys for store in slots.SKIPPED}, list(range(4096)), NOW)

