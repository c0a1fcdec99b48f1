"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.operators import change_feed, copy_differences, nested, radix, snapshot_changes
from slotweave.queries import Registry, table
from slotweave.workspace import materialize

registry = Registry()
query = registry.add


_P1 = """WITH snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, version ORDER BY delivery_id) AS r FROM topology_snapshots
  WHERE len(slots) = slot_count AND cluster_id IS NOT NULL AND version IS NOT NULL) WHERE r = 1),
pair AS (SELECT cluster_id, version AS a, lead(version) OVER w AS b, slots AS old, lead(slots) OVER w AS new, shards AS old_shards, lead(shards) OVER w AS new_shards FROM snap WINDOW w AS (PARTITION BY cluster_id ORDER BY version)),
twin AS (SELECT * FROM pair WHERE b IS NOT NULL),
slot AS (SELECT cluster_id, a, b, unnest(list_filter(list_transform(list_zip(old, new), lambda z, i: {'i': i - 1, 'o': coalesce(z[1], ''), 'n': coalesce(z[2], '')}), lambda s: s.o <> s.n)) AS s FROM twin),
key AS (SELECT DISTINCT cluster_id, a, b, unnest(list_concat(map_keys(old_shards), map_keys(new_shards))) AS k, old_shards, new_shards FROM twin),
shard AS (SELECT *, map_contains(old_shards, k) AS had, map_contains(new_shards, k) AS has, CAST(list_sort(map_entries(old_shards[k].members)) AS VARCHAR) AS o, CAST(list_sort(map_entries(new_shards[k].members)) AS VARCHAR) AS n FROM key)
SELECT cluster_id, a AS from_version, b AS to_version, 'slot' AS record, CAST(s.i AS VARCHAR) AS item, CASE WHEN s.o = '' THEN 'added' WHEN s.n = '' THEN 'removed' ELSE 'changed' END AS change FROM slot
UNION ALL SELECT cluster_id, a, b, 'shard', k, CASE WHEN NOT had THEN 'added' WHEN NOT has THEN 'removed' ELSE 'changed' END FROM shard WHERE NOT had OR NOT has OR o IS DISTINCT FROM n"""

_P2 = """WITH body AS (SELECT report_id, CAST(body AS JSON) AS j FROM rebalance_reports WHERE json_valid(body)),
plain AS (SELECT report_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CAST(json_extract_string(j, '$') AS JSON) ELSE j END AS j FROM body),
rep AS (SELECT report_id, coalesce(json_extract(j, '$.batches'), json_extract(j, '$.report.batches'), json_extract(j, '$.result.batches')) AS b FROM plain),
arr AS (SELECT report_id, CASE json_type(b) WHEN 'ARRAY' THEN json_extract(b, '$[*]') ELSE [b] END AS l FROM rep WHERE b IS NOT NULL AND json_type(b) <> 'NULL'),
bat AS (SELECT report_id, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS i FROM arr),
sl AS (SELECT report_id, i, json_extract(b, '$.slots') AS s FROM bat WHERE json_type(b) <> 'NULL'),
ll AS (SELECT report_id, i, CASE json_type(s) WHEN 'ARRAY' THEN list_transform(json_extract(s, '$[*]'), lambda x: json_extract_string(x, '$')) WHEN 'VARCHAR' THEN string_split(json_extract_string(s, '$'), ',') ELSE [] END AS l FROM sl),
leaf AS (SELECT report_id, i, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS k FROM ll),
zs AS (SELECT dump_id, unnest(zsets) AS z, generate_subscripts(zsets, 1) - 1 AS i FROM slot_dumps),
zm AS (SELECT dump_id, i, unnest(z.members) AS m, generate_subscripts(z.members, 1) - 1 AS k FROM zs WHERE z IS NOT NULL),
ps AS (SELECT probe_id, unnest(shards) AS s, generate_subscripts(shards, 1) - 1 AS i FROM node_probes),
pl AS (SELECT probe_id, i, unnest(s.learners) AS n, generate_subscripts(s.learners, 1) - 1 AS k FROM ps WHERE s IS NOT NULL)
SELECT DISTINCT kind, parent_id, CAST(child_no AS INT) AS child_no, CAST(leaf_no AS INT) AS leaf_no, item FROM (
  SELECT 'batch_slot' AS kind, report_id AS parent_id, i AS child_no, k AS leaf_no, trim(v) AS item FROM leaf WHERE v IS NOT NULL
  UNION ALL SELECT 'batch_slot', report_id, i, -1, '' FROM ll WHERE len(list_filter(l, lambda x: x IS NOT NULL)) = 0
  UNION ALL SELECT 'zset_member', dump_id, i, k, m.member FROM zm WHERE m.member IS NOT NULL
  UNION ALL SELECT 'zset_member', dump_id, i, -1, '' FROM zs WHERE z IS NOT NULL AND coalesce(len(list_filter(z.members, lambda x: x.member IS NOT NULL)), 0) = 0
  UNION ALL SELECT 'learner', probe_id, i, k, n FROM pl WHERE n IS NOT NULL)"""

_P3 = """WITH v AS (SELECT node_id, CAST(probed_at AS DATE) AS d, latency_ms AS x FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY received_at) AS r FROM node_probes WHERE reachable AND latency_ms >= 0) WHERE r = 1),
day AS (SELECT *, row_number() OVER (PARTITION BY node_id, d ORDER BY x) AS r, count(*) OVER (PARTITION BY node_id, d) AS n FROM v),
mon AS (SELECT *, row_number() OVER (PARTITION BY node_id, date_trunc('month', d) ORDER BY x) AS r, count(*) OVER (PARTITION BY node_id, date_trunc('month', d)) AS n FROM v),
pct AS (SELECT CAST(unnest([50, 95]) AS INT) AS pct)
SELECT a.node_id, strftime(a.d, '%Y-%m-%d') AS probe_day, pct FROM pct, day a, mon b WHERE a.r = (a.n * pct + 99) // 100 AND b.r = (b.n * pct + 99) // 100
  AND a.node_id = b.node_id AND date_trunc('month', a.d) = date_trunc('month', b.d) AND a.x >= 2 * b.x"""

_CANON = "CASE WHEN data IS NULL THEN NULL WHEN json_valid(decode(data)) THEN 'j' || (SELECT string_agg(fullkey || '=' || type || '=' || coalesce(CAST(atom AS VARCHAR), ''), chr(10) ORDER BY fullkey) FROM json_tree(CAST(decode(data) AS JSON))) ELSE 'b' || hex(data) END"
_P4 = f"""WITH c AS (SELECT shard_id AS shard, max(commit_index) FILTER (role = 'leader') AS l, max(commit_index) FILTER (role = 'follower') AS f FROM shard_status WHERE shard_id IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT shard, idx, term, cmd, {_CANON} AS data FROM wal_leader JOIN c USING (shard) WHERE idx <= least(l, f) AND l IS NOT NULL AND f IS NOT NULL),
b AS (SELECT DISTINCT shard, idx, term, cmd, {_CANON} AS data FROM wal_follower JOIN c USING (shard) WHERE idx <= least(l, f) AND l IS NOT NULL AND f IS NOT NULL),
j AS (SELECT coalesce(a.shard, b.shard) AS shard, coalesce(a.idx, b.idx) AS idx, a.shard IS NULL AS ma, b.shard IS NULL AS mb, a.term IS DISTINCT FROM b.term AS t, a.cmd IS DISTINCT FROM b.cmd AS m, a.data IS DISTINCT FROM b.data AS d
  FROM a FULL JOIN b ON a.shard = b.shard AND a.idx = b.idx)
SELECT shard, CAST(0 AS BIGINT) AS idx, 'commit_index' AS field FROM c WHERE l IS DISTINCT FROM f UNION ALL SELECT shard, idx, 'missing_in_leader' FROM j WHERE ma UNION ALL SELECT shard, idx, 'missing_in_follower' FROM j WHERE mb
UNION ALL SELECT shard, idx, 'term' FROM j WHERE NOT ma AND NOT mb AND t UNION ALL SELECT shard, idx, 'cmd' FROM j WHERE NOT ma AND NOT mb AND m UNION ALL SELECT shard, idx, 'data' FROM j WHERE NOT ma AND NOT mb AND d"""

_P5 = """WITH starts AS (SELECT shard, term, min(idx) AS s FROM command_log GROUP BY ALL),
ends AS (SELECT shard, term, min(s) OVER (PARTITION BY shard ORDER BY term DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM starts),
raw AS (SELECT shard, idx, decode(data) AS d FROM command_log JOIN ends USING (shard, term) WHERE (e IS NULL OR idx < e) AND data IS NOT NULL),
c AS (SELECT shard, idx, json_extract_string(d, '$.cmd') AS cmd, json_extract(d, '$.args') AS a, json_extract_string(d, '$.args.key') AS k FROM raw WHERE json_valid(d)),
gone AS (SELECT shard, idx, k, a, unnest(range(0, 100)) AS i FROM c WHERE cmd = 'DEL' AND k IS NOT NULL),
names AS (SELECT shard, idx, i, CASE WHEN i = 0 THEN k ELSE json_extract_string(a, '$."' || i || '"') END AS k FROM gone),
upto AS (SELECT shard, idx, min(i) FILTER (k IS NULL) AS stop FROM names GROUP BY ALL),
zrem AS (SELECT shard, idx, k, a, unnest(json_keys(a)) AS name FROM c WHERE cmd = 'ZREM' AND k IS NOT NULL),
ev AS (SELECT shard, idx, 'string' AS store, k AS kv_key, '' AS member, true AS live FROM c WHERE cmd = 'SET' AND k IS NOT NULL
  UNION ALL SELECT shard, idx, 'zset', k, json_extract_string(a, '$.member'), true FROM c WHERE cmd = 'ZADD' AND k IS NOT NULL
  UNION ALL SELECT n.shard, n.idx, 'string', k, '', false FROM names n JOIN upto u ON u.shard = n.shard AND u.idx = n.idx WHERE i < stop
  UNION ALL SELECT shard, idx, 'zset', k, json_extract_string(a, '$."' || name || '"'), false FROM zrem WHERE name <> 'key')
SELECT shard, store, kv_key, member, max(idx) AS last_idx FROM ev GROUP BY shard, store, kv_key, member HAVING arg_max(live, idx)"""


@query(_P1)
def p1_found(spark, folder):
    return snapshot_changes.topology_changes(table(spark, folder, "topology_snapshots"))


@query(_P2)
def p2_found(spark, folder):
    return nested.nested_elements(table(spark, folder, "rebalance_reports"), table(spark, folder, "slot_dumps"), table(spark, folder, "node_probes"))


@query(
    """WITH s AS (SELECT probe_id, unnest(shards) AS s, generate_subscripts(shards, 1) - 1 AS i FROM node_probes)
SELECT DISTINCT probe_id, CAST(i AS INT) AS position, s.shard_id AS shard_id, s.role AS role, s.leader_id AS leader_id, s.term AS term, s.commit_index AS commit_index, s.slots AS slots FROM s WHERE s IS NOT NULL"""
)
def p2_shard_states(spark, folder):
    """The flat table of shard states, each with its probe and position."""
    shard = nested.Node("shard", "shards", nested.PROBE_NODES.fields)
    written = nested.write_tagged(nested.emit_typed(table(spark, folder, "node_probes"), "probe_id", [shard]))
    states = written.table("shard", "shard_id STRING, role STRING, leader_id STRING, term BIGINT, commit_index BIGINT, slots INT").distinct()
    return states.select(F.col("root").alias("probe_id"), F.get("pk", F.lit(0)).alias("position"), "shard_id", "role", "leader_id", "term", "commit_index", "slots")


_BATCHES = _P2.partition(",\nsl AS")[0]  # the reports read as in p2_found, down to the batches
_ZSETS = "WITH zs AS (SELECT dump_id, unnest(zsets) AS z, generate_subscripts(zsets, 1) - 1 AS i FROM slot_dumps)"


@query(
    f"""{_BATCHES}
SELECT DISTINCT report_id, CAST(i AS INT) AS position, json_extract_string(b, '$.from') AS from_shard, json_extract_string(b, '$.to') AS to_shard, TRY_CAST(json_extract_string(b, '$.keys_moved') AS BIGINT) AS keys_moved, json_extract_string(b, '$.error') AS error
FROM bat WHERE json_type(b) <> 'NULL'"""
)
def p2_batches(spark, folder):
    """The flat table of batches, each with its report and position."""
    written = nested.write_tagged(nested.report_rows(table(spark, folder, "rebalance_reports")))
    rows = nested.flat_table(written, "batch", "report_id")
    return rows.select("report_id", "position", F.col("from").alias("from_shard"), F.col("to").alias("to_shard"), F.expr("try_cast(keys_moved AS BIGINT)").alias("keys_moved"), "error")


@query(
    f"""{_BATCHES},
el AS (SELECT report_id, i, 'skipped_key' AS kind, unnest(json_extract(b, '$.skipped_keys[*]')) AS e, generate_subscripts(json_extract(b, '$.skipped_keys[*]'), 1) - 1 AS k FROM bat
  UNION ALL SELECT report_id, i, 'attempt', unnest(json_extract(b, '$.attempts[*]')), generate_subscripts(json_extract(b, '$.attempts[*]'), 1) - 1 FROM bat)
SELECT DISTINCT kind, report_id, CAST(i AS INT) AS position, CAST(k AS INT) AS element_no, CASE kind WHEN 'skipped_key' THEN trim(json_extract_string(e, '$')) END AS skipped_key,
  CASE kind WHEN 'attempt' THEN TRY_CAST(json_extract_string(e, '$.no') AS BIGINT) END AS attempt, CASE kind WHEN 'attempt' THEN json_extract_string(e, '$.took') END AS took FROM el WHERE json_type(e) <> 'NULL'"""
)
def p2_batch_elements(spark, folder):
    """The elements of batches other than slots: skipped keys and attempts, each with its report, batch and position."""
    written = nested.write_tagged(nested.report_rows(table(spark, folder, "rebalance_reports")))
    keys = nested.flat_table(written, "batch_skipped_key", "report_id")
    attempts = nested.flat_table(written, "batch_attempt", "report_id")
    nothing = F.lit(None)
    return keys.select(F.lit("skipped_key").alias("kind"), "report_id", "position", F.col("key_no").alias("element_no"), F.col("value").alias("skipped_key"), nothing.cast("bigint").alias("attempt"), nothing.cast("string").alias("took")).unionByName(
        attempts.select(F.lit("attempt").alias("kind"), "report_id", "position", F.col("attempt_no").alias("element_no"), nothing.cast("string").alias("skipped_key"), F.expr("try_cast(no AS BIGINT)").alias("attempt"), "took")
    )


@query(f"{_ZSETS} SELECT DISTINCT dump_id, CAST(i AS INT) AS position, z.key AS key FROM zs WHERE z IS NOT NULL")
def p2_zsets(spark, folder):
    """The flat table of sorted sets, each with its dump and position."""
    return nested.flat_table(nested.write_tagged(nested.dump_rows(table(spark, folder, "slot_dumps"))), "zset", "dump_id")


@query(
    f"""{_ZSETS}, zm AS (SELECT dump_id, i, unnest(z.members) AS m, generate_subscripts(z.members, 1) - 1 AS k FROM zs WHERE z IS NOT NULL)
SELECT DISTINCT dump_id, CAST(i AS INT) AS position, CAST(k AS INT) AS member_no, m.member AS member, m.score AS score FROM zm WHERE m IS NOT NULL"""
)
def p2_zset_members(spark, folder):
    """The members of sorted sets with their scores, each with its dump, set and position."""
    return nested.flat_table(nested.write_tagged(nested.dump_rows(table(spark, folder, "slot_dumps"))), "zset_member", "dump_id")


@query(
    """WITH ps AS (SELECT probe_id, unnest(shards) AS s, generate_subscripts(shards, 1) - 1 AS i FROM node_probes),
pm AS (SELECT probe_id, i, unnest(s.members) AS n, generate_subscripts(s.members, 1) - 1 AS k FROM ps WHERE s IS NOT NULL)
SELECT DISTINCT probe_id, CAST(i AS INT) AS position, CAST(k AS INT) AS member_no, n AS value FROM pm WHERE n IS NOT NULL"""
)
def p2_shard_members(spark, folder):
    """The members of shard states, each with its probe, shard state and position."""
    shard = nested.Node("shard", "shards", (), (nested.Node("member", "members"),), emit=False)
    return nested.flat_table(nested.write_tagged(nested.emit_typed(table(spark, folder, "node_probes"), "probe_id", [shard])), "member", "probe_id")


@query(_P3)
def p3_found(spark, folder):
    return radix.slow_days(table(spark, folder, "node_probes"))


@query(
    """WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem),
p AS (SELECT CAST(unnest([1, 25, 50, 75, 99]) AS INT) AS pct) SELECT l_returnflag, l_linestatus, pct, n AS size, x AS value FROM r, p WHERE r = (n * pct + 99) // 100"""
)
def p3_price_percentiles(spark, folder):
    """Percentiles of a floating-point column."""
    keys = ["l_returnflag", "l_linestatus"]
    found = radix.radix_percentiles(table(spark, folder, "lineitem"), "l_extendedprice", keys, {"all": keys}, [1, 25, 50, 75, 99])["all"]
    return found.select(*keys, "pct", "size", "value")


@query(
    _P3.partition(",\nday AS")[0]
    + """, c AS (SELECT node_id, date_trunc('month', d) AS m, x, CASE WHEN x = 0 THEN -1 ELSE CAST(floor(log2(x)) AS INT) END AS e FROM v),
h AS (SELECT node_id, m, CASE WHEN e > 8 THEN (x >> (e - 8)) + e * 1024 ELSE x END AS cell, count(*) AS n, min(x) AS low, max(x) AS high FROM c GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY node_id, m) AS size, sum(n) OVER (PARTITION BY node_id, m ORDER BY low) AS upto FROM h),
p AS (SELECT CAST(unnest([50, 95, 99]) AS INT) AS pct)
SELECT node_id, strftime(m, '%Y-%m') AS probe_month, pct, CAST(size AS BIGINT) AS size, low, high FROM t, p WHERE (size * pct + 99) // 100 <= upto AND (size * pct + 99) // 100 > upto - n"""
)
def p3_merged_months(spark, folder):
    """Bounds of a month's percentiles from histograms of days that were built in separate runs."""
    values = radix.probe_values(table(spark, folder, "node_probes"))
    early = F.dayofmonth("day") <= 15
    runs = [materialize(radix.digit_histogram(values.where(part), "latency_ms", ["node_id", "day", "month"]), "histogram-run") for part in (early, ~early)]
    found = radix.bounded_percentiles(runs[0].unionByName(runs[1]), ["node_id", "month"], [50, 95, 99])
    return found.select("node_id", F.date_format("month", "yyyy-MM").alias("probe_month"), "pct", "size", "low", "high")


@query(_P4)
def p4_found(spark, folder):
    return copy_differences.log_differences(table(spark, folder, "wal_leader"), table(spark, folder, "wal_follower"), table(spark, folder, "shard_status"))


@query(_P5)
def p5_found(spark, folder):
    return change_feed.live_records(table(spark, folder, "command_log"))
