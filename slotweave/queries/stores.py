"""Queries on the string, set, sorted-set and leaderboard stores, with logs made of the events and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.operators import boards, sets, strings, zsets
from slotweave.queries import Registry, table

registry = Registry()
query = registry.add
NOW = 1_706_659_200_000  # 2024-01-31 00:00 UTC

# ---------------------------------------------------------------- strings


def kv_log(spark, folder):
    e = table(spark, folder, "events")
    cmd = F.when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "signup", "EXPIRE").otherwise("SET")
    ttl = F.when(F.col("event_type") == "signup", (F.col("event_id") % 480) * 3600).when(F.col("event_type") == "purchase", 864_000)
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("idx"), millis.alias("ts_ms"), cmd.alias("cmd"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), ttl.alias("ttl_s"))


_KV = """WITH log AS (SELECT event_id AS idx, epoch_us(ts) // 1000 AS ts_ms, CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS value,
  CASE event_type WHEN 'error' THEN 'DEL' WHEN 'signup' THEN 'EXPIRE' ELSE 'SET' END AS cmd,
  CASE event_type WHEN 'signup' THEN (event_id % 480) * 3600 WHEN 'purchase' THEN 864000 END AS ttl_s FROM events),
w AS (SELECT key, max(idx) AS idx FROM log WHERE cmd IN ('SET', 'DEL') GROUP BY key),
x AS (SELECT key, max(idx) AS idx FROM log WHERE cmd = 'EXPIRE' GROUP BY key),
state AS (SELECT l.key, l.value, CASE WHEN x.idx > l.idx THEN e.ts_ms + e.ttl_s * 1000 WHEN l.ttl_s > 0 THEN l.ts_ms + l.ttl_s * 1000 END AS expire_at_ms
  FROM w JOIN log l ON l.idx = w.idx LEFT JOIN x ON x.key = w.key LEFT JOIN log e ON e.idx = x.idx WHERE l.cmd = 'SET'),
ids AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events)
"""
_LIVE = f"(expire_at_ms IS NULL OR expire_at_ms > {NOW})"


def _keys(spark, folder):
    return table(spark, folder, "events").select(F.col("user_id").cast("string").alias("key")).distinct()


@query(_KV + "SELECT * FROM state")
def kv_set(spark, folder):
    return strings.replay(kv_log(spark, folder))


@query(_KV + f"SELECT ids.key, s.value FROM ids LEFT JOIN (SELECT * FROM state WHERE {_LIVE}) s ON s.key = ids.key")
def kv_get(spark, folder):
    return strings.get(strings.replay(kv_log(spark, folder)), _keys(spark, folder), NOW)


@query(_KV + f"""SELECT ids.key, CAST(CASE WHEN s.key IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 WHEN expire_at_ms <= {NOW} THEN -2
  ELSE (expire_at_ms - {NOW}) // 1000 END AS BIGINT) AS ttl FROM ids LEFT JOIN state s ON s.key = ids.key""")
def kv_ttl(spark, folder):
    return strings.ttl(strings.replay(kv_log(spark, folder)), _keys(spark, folder), NOW)


@query(_KV + "SELECT count(*) AS deleted FROM state WHERE CAST(key AS BIGINT) % 7 = 3")
def kv_del(spark, folder):
    return strings.delete(strings.replay(kv_log(spark, folder)), _keys(spark, folder).where("CAST(key AS BIGINT) % 7 = 3"))[1]


@query(_KV + f"""SELECT key, value, CASE WHEN CAST(key AS BIGINT) % 5 = 2 AND {_LIVE} THEN {NOW} + 60000 ELSE expire_at_ms END AS expire_at_ms FROM state""")
def kv_expire(spark, folder):
    changes = _keys(spark, folder).where("CAST(key AS BIGINT) % 5 = 2").withColumn("ttl_s", F.lit(60).cast("bigint"))
    return strings.expire(strings.replay(kv_log(spark, folder)), changes, NOW)


def _counters(spark, folder):
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("idx"), F.when(F.col("event_type") == "error", "DEL").otherwise("INCR").alias("cmd"), F.col("user_id").cast("string").alias("key"), F.lit(None).cast("string").alias("value"))


_INCR = """WITH log AS (SELECT event_id AS idx, CAST(user_id AS VARCHAR) AS key, event_type = 'error' AS gone FROM events),
seg AS (SELECT *, sum(gone::INT) OVER (PARTITION BY key ORDER BY idx) AS s, max(CASE WHEN gone THEN idx END) OVER (PARTITION BY key) AS last FROM log) """


@query(_INCR + "SELECT key, count(*) AS value FROM seg WHERE NOT gone AND (last IS NULL OR idx > last) GROUP BY key")
def kv_incr(spark, folder):
    return strings.incr(_counters(spark, folder))


@query(_INCR + "SELECT key, idx, CAST(row_number() OVER (PARTITION BY key, s ORDER BY idx) AS BIGINT) AS value FROM seg WHERE NOT gone")
def kv_incr_replies(spark, folder):
    return strings.increments(_counters(spark, folder))


def _used(spark, folder):
    e = table(spark, folder, "events")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max(millis).alias("last_access_ms"), F.count(F.lit(1)).alias("frequency"))


_USED = "WITH used AS (SELECT CAST(user_id AS VARCHAR) AS key, max(epoch_us(ts) // 1000) AS last_access_ms, count(*) AS frequency FROM events GROUP BY user_id) "


@query(_USED + "SELECT * FROM used ORDER BY last_access_ms DESC, key LIMIT 50")
def kv_evict_lru(spark, folder):
    return strings.evict(_used(spark, folder), 50, "lru")


@query(_USED + f"SELECT * FROM used ORDER BY greatest(frequency - ({NOW} - last_access_ms) // 60000, 0) DESC, key LIMIT 50")
def kv_evict_lfu(spark, folder):
    return strings.evict(_used(spark, folder), 50, "lfu", NOW)


@query("SELECT CAST(50 AS BIGINT) AS kept, CAST(50 AS BIGINT) AS different, CAST(50 AS BIGINT) AS unchanged, true AS seeded")
def kv_evict_arbitrary(spark, folder):
    """What must hold for any choice: as many keys as asked for, each once and as it was, and another choice by another seed."""
    used = _used(spark, folder)
    kept = strings.evict(used, 50, "arbitrary", seed=3)
    other = strings.evict(used, 50, "arbitrary", seed=4).select(F.col("key").alias("again"))
    same = kept.join(used, ["key", "last_access_ms", "frequency"]).agg(F.count(F.lit(1)).alias("unchanged"))
    both = kept.join(other, F.col("key") == F.col("again"), "left").agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("key").alias("different"), (F.count("again") < 50).alias("seeded"))
    k = lambda df: df.withColumn("_k", F.lit(0))
    return k(both).join(k(same), "_k").select("kept", "different", "unchanged", "seeded")  # one row each


@query(_USED + f"SELECT key, CAST(greatest(frequency - ({NOW} - last_access_ms) // 60000, 0) AS BIGINT) AS frequency FROM used")
def kv_lfu_counter(spark, folder):
    return _used(spark, folder).select("key", strings.decayed_frequency(F.col("frequency"), F.col("last_access_ms"), NOW).alias("frequency"))


# ---------------------------------------------------------------- sets


def _member(n):
    """A member for every 97 events, so that the sets grow with the table and members come more than once."""
    return F.floor(n / 97).cast("string")


def _set_log(spark, folder):
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("idx"), F.when(F.col("event_type") == "error", "SREM").otherwise("SADD").alias("cmd"), (F.col("user_id") % 40).cast("string").alias("key"), _member(F.col("event_id")).alias("member"))


_SET = """WITH log AS (SELECT event_id AS idx, CAST(user_id % 40 AS VARCHAR) AS key, CAST(event_id // 97 AS VARCHAR) AS member, event_type <> 'error' AS put FROM events),
state AS (SELECT key, member FROM log GROUP BY key, member HAVING arg_max(put, idx)),
asked AS (SELECT DISTINCT CAST(user_id % 45 AS VARCHAR) AS key, CAST(event_id // 97 AS VARCHAR) AS member FROM events WHERE event_type = 'signup') """


def _set_state(spark, folder):
    return sets.replay(_set_log(spark, folder))


def _set_asked(spark, folder):
    return table(spark, folder, "events").where("event_type = 'signup'").select((F.col("user_id") % 45).cast("string").alias("key"), _member(F.col("event_id")).alias("member")).distinct()


@query("SELECT DISTINCT CAST(user_id % 40 AS VARCHAR) AS key, CAST(event_id // 97 AS VARCHAR) AS member FROM events")
def set_sadd(spark, folder):
    return sets.sadd(_set_log(spark, folder))


@query(_SET + "SELECT key, member, idx, CAST(row_number() OVER (PARTITION BY key, member ORDER BY idx) = 1 AS BIGINT) AS added FROM log")
def set_sadd_replies(spark, folder):
    return sets.sadd_replies(_set_log(spark, folder))


@query(_SET + "SELECT * FROM state")
def set_srem(spark, folder):
    return _set_state(spark, folder)


@query(_SET + "SELECT key, count(*) AS size FROM state GROUP BY key")
def set_scard(spark, folder):
    return sets.scard(_set_state(spark, folder))


@query(_SET + "SELECT key, member FROM state WHERE key = '7'")
def set_smembers(spark, folder):
    return sets.smembers(_set_state(spark, folder), "7")


@query(_SET + "SELECT key, member, CAST(EXISTS (SELECT 1 FROM state s WHERE s.key = a.key AND s.member = a.member) AS BIGINT) AS is_member FROM asked a")
def set_sismember(spark, folder):
    return sets.sismember(_set_state(spark, folder), _set_asked(spark, folder))


@query(_SET + """SELECT key, string_agg(flag, ',' ORDER BY member) AS flags FROM (SELECT a.key, a.member, CASE WHEN s.key IS NULL THEN '0' ELSE '1' END AS flag
  FROM asked a LEFT JOIN state s ON s.key = a.key AND s.member = a.member) GROUP BY key""")
def set_smismember(spark, folder):
    asked = _set_asked(spark, folder).groupBy("key").agg(F.sort_array(F.collect_list("member")).alias("members"))
    return sets.smismember(_set_state(spark, folder), asked).withColumn("flags", F.array_join(F.col("flags").cast("array<string>"), ","))


@query(_SET + "SELECT key, least(count(*), 3) AS drawn, least(count(*), 3) AS members FROM state GROUP BY key")
def set_srand(spark, folder):
    """What must hold for any draw: up to three different members of each set."""
    state = _set_state(spark, folder)
    drawn = sets.srand(state, 3, seed=5)
    inside = state.withColumn("_there", F.lit(1))
    return drawn.join(inside, ["key", "member"], "left").groupBy("key").agg(F.count_distinct("member").alias("drawn"), F.count("_there").alias("members"))


@query(_SET + "SELECT key, greatest(count(*) - 3, 0) AS rest, least(count(*), 3) AS popped, CAST(0 AS BIGINT) AS in_both FROM state GROUP BY key")
def set_spop_rest(spark, folder):
    """What must hold for any pop: the members are split into those popped and the rest."""
    state = _set_state(spark, folder)
    popped, rest = sets.spop(state, 3, seed=5)
    marked = state.join(popped.select("key", "member", F.lit(1).alias("_popped")), ["key", "member"], "left").join(rest.select("key", "member", F.lit(1).alias("_rest")), ["key", "member"], "left")
    return marked.groupBy("key").agg(F.count("_rest").alias("rest"), F.count("_popped").alias("popped"), F.count_if((F.col("_rest") == 1) & (F.col("_popped") == 1)).alias("in_both"))


@query(_SET + "SELECT * FROM state INTERSECT SELECT * FROM asked")
def set_intersect(spark, folder):
    return sets.combine(_set_state(spark, folder), _set_asked(spark, folder), "intersect")


@query(_SET + "SELECT * FROM state EXCEPT SELECT * FROM asked")
def set_subtract(spark, folder):
    return sets.combine(_set_state(spark, folder), _set_asked(spark, folder), "subtract")


# ---------------------------------------------------------------- sorted sets


def _zlog(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("member"), F.round("o_totalprice", 0).alias("score"))


_Z = """WITH log AS (SELECT o_orderkey AS idx, o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS member, round(o_totalprice, 0) AS score FROM orders),
state AS (SELECT key, member, arg_max(score, idx) AS score FROM log GROUP BY key, member),
up AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM state),
down AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM state) """


def _z(spark, folder):
    return zsets.zadd(_zlog(spark, folder))


@query(_Z + "SELECT * FROM state")
def zset_zadd(spark, folder):
    return _z(spark, folder)


@query(_Z + "SELECT key, member, arg_min(score, idx) AS score FROM log GROUP BY key, member")
def zset_zadd_nx(spark, folder):
    return zsets.zadd(_zlog(spark, folder), "nx")


@query(_Z + """, late AS (SELECT key, member, arg_max(score, idx) AS score FROM log WHERE idx % 3 = 0 GROUP BY key, member),
early AS (SELECT key, member, arg_max(score, idx) AS score FROM log WHERE idx % 3 <> 0 GROUP BY key, member)
SELECT key, member, coalesce(late.score, early.score) AS score FROM early LEFT JOIN late USING (key, member)""")
def zset_zadd_xx(spark, folder):
    log = _zlog(spark, folder)
    return zsets.zadd_xx(zsets.zadd(log.where("idx % 3 <> 0")), log.where("idx % 3 = 0"))


@query(_Z + "SELECT key, member, sum(score) AS score FROM log GROUP BY key, member")
def zset_zincrby(spark, folder):
    return zsets.zincrby(_zlog(spark, folder))


@query(_Z + "SELECT * FROM state WHERE CAST(member AS BIGINT) % 5 <> 0")
def zset_zrem(spark, folder):
    state = _z(spark, folder)
    return zsets.zrem(state, state.where("CAST(member AS BIGINT) % 5 = 0"))


@query(_Z + "SELECT a.key, a.member, s.score FROM (SELECT DISTINCT o_orderpriority AS key, CAST(o_custkey + 1 AS VARCHAR) AS member FROM orders) a LEFT JOIN state s USING (key, member)")
def zset_zscore(spark, folder):
    asked = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("key"), (F.col("o_custkey") + 1).cast("string").alias("member")).distinct()
    return zsets.zscore(_z(spark, folder), asked)


@query(_Z + "SELECT key, count(*) AS size FROM state GROUP BY key")
def zset_zcard(spark, folder):
    return zsets.zcard(_z(spark, folder))


@query(_Z + "SELECT key, member, score, rank FROM up")
def zset_zrank(spark, folder):
    return zsets.zrank(_z(spark, folder))


@query(_Z + "SELECT key, member, score, rank FROM down")
def zset_zrevrank(spark, folder):
    return zsets.zrevrank(_z(spark, folder))


@query(_Z + "SELECT coalesce(max(rank), -1) AS rank FROM up WHERE key = '1-URGENT' AND member = '7'")
def zset_rank_of(spark, folder):
    return zsets.rank_of(_z(spark, folder), "1-URGENT", "7")


@query(_Z + "SELECT key, member, score, rank FROM up WHERE rank BETWEEN n - 12 AND n - 3")
def zset_zrange(spark, folder):
    return zsets.zrange(_z(spark, folder), -12, -3)


@query(_Z + "SELECT key, member, score, rank FROM down WHERE rank BETWEEN 0 AND 9")
def zset_zrevrange(spark, folder):
    return zsets.zrevrange(_z(spark, folder), 0, 9)


@query(_Z + """SELECT key, member, score, p AS position FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS p FROM state
  WHERE score > 100000 AND score <= 300000) WHERE p >= 5 AND p < 25""")
def zset_zrangebyscore(spark, folder):
    return zsets.zrangebyscore(_z(spark, folder), "(100000", "300000", offset=5, count=20)


@query(_Z + """SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS position FROM state WHERE score >= 250000""")
def zset_zrevrangebyscore(spark, folder):
    return zsets.zrangebyscore(_z(spark, folder), "250000", "+inf", rev=True)


@query(_Z + "SELECT key, count(*) FILTER (score >= 50000 AND score < 200000) AS n FROM state GROUP BY key")
def zset_zcount(spark, folder):
    return zsets.zcount(_z(spark, folder), "50000", "(200000")


@query(_Z + "SELECT key, member, score, rank FROM down WHERE rank < 5")
def zset_zpopmax(spark, folder):
    return zsets.zpop(_z(spark, folder), 5)[0]


@query(_Z + "SELECT key, member, score, rank FROM up WHERE rank < 5")
def zset_zpopmin(spark, folder):
    return zsets.zpop(_z(spark, folder), 5, highest=False)[0]


@query(_Z + "SELECT key, member, score FROM up WHERE rank >= 5")
def zset_zpopmin_rest(spark, folder):
    return zsets.zpop(_z(spark, folder), 5, highest=False)[1].select("key", "member", "score")


# ---------------------------------------------------------------- leaderboards


def _blog(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("member"), F.floor("o_totalprice").cast("bigint").alias("score"), F.col("o_orderstatus").alias("data"))


_B = """WITH log AS (SELECT o_orderkey AS idx, o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS member, CAST(floor(o_totalprice) AS BIGINT) AS score, o_orderstatus AS data FROM orders),
board AS (SELECT key, member, CAST(sum(score) AS BIGINT) AS score, arg_max(data, idx) AS data FROM log GROUP BY key, member),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member) AS rank FROM board) """


@query(_B + "SELECT * FROM board")
def board_add(spark, folder):
    return boards.add(_blog(spark, folder))


@query(_B + "SELECT key, member, arg_max(score, idx) AS score, arg_max(data, idx) AS data FROM log GROUP BY key, member")
def board_insert(spark, folder):
    return boards.insert(_blog(spark, folder))


@query(_B + ", new AS (SELECT key, member, arg_max(score, idx) AS score FROM log WHERE data = 'F' GROUP BY key, member), old AS (SELECT key, member, arg_max(score, idx) AS score, arg_max(data, idx) AS data FROM log WHERE data <> 'F' GROUP BY key, member) SELECT key, member, coalesce(new.score, old.score) AS score, data FROM old LEFT JOIN new USING (key, member)")
def board_update_score(spark, folder):
    log = _blog(spark, folder)
    return boards.update_score(boards.insert(log.where("data <> 'F'")), log.where("data = 'F'"))


@query(_B + "SELECT * FROM board WHERE CAST(member AS BIGINT) % 4 <> 1")
def board_delete(spark, folder):
    board = boards.add(_blog(spark, folder))
    return boards.delete(board, board.where("CAST(member AS BIGINT) % 4 = 1"))


@query(_B + "SELECT * FROM ranked")
def board_rank(spark, folder):
    return boards.ranks(boards.add(_blog(spark, folder)))


@query(_B + "SELECT * FROM ranked WHERE rank = 3")
def board_by_rank(spark, folder):
    return boards.by_rank(boards.add(_blog(spark, folder)), 3)


@query(_B + "SELECT * FROM ranked WHERE rank BETWEEN 1 AND 20")
def board_rank_range(spark, folder):
    return boards.rank_range(boards.add(_blog(spark, folder)), -4, 20)


@query(_B + "SELECT * FROM ranked WHERE score BETWEEN 200000 AND 600000")
def board_score_range(spark, folder):
    return boards.score_range(boards.add(_blog(spark, folder)), 200_000, 600_000)


@query(_B + "SELECT key, count(*) AS size FROM board GROUP BY key")
def board_len(spark, folder):
    return boards.length(boards.add(_blog(spark, folder)))


def _periods(spark, folder):
    o = table(spark, folder, "orders")
    return boards.period_scores(o, F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderdate"), ["day", "week", "month", "year"])


_P = """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS member, CAST(o_totalprice AS DECIMAL(18,2)) AS score, o_orderdate AS d FROM orders),
k AS (SELECT 'lb:day:' || strftime(d, '%Y%m%d') AS key, member, score FROM o UNION ALL SELECT 'lb:week:' || CAST(isoyear(d) AS VARCHAR) || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0'), member, score FROM o
  UNION ALL SELECT 'lb:month:' || strftime(d, '%Y%m'), member, score FROM o UNION ALL SELECT 'lb:year:' || strftime(d, '%Y'), member, score FROM o),
s AS (SELECT key, member, CAST(sum(score) AS DOUBLE) AS score FROM k GROUP BY key, member),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM s) """


@query(_P + "SELECT * FROM r WHERE rank <= 9")
def leaderboard_periods(spark, folder):
    scores = _periods(spark, folder).withColumn("score", F.col("score").cast("double"))
    return zsets.zrevrange(scores, 0, 9)


@query(_P + "SELECT * FROM r WHERE member = '42'")
def leaderboard_user(spark, folder):
    scores = _periods(spark, folder).withColumn("score", F.col("score").cast("double"))
    return zsets.member_ranks(scores, "42", rev=True)
