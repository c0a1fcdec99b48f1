"""The general data problems: whole small tables against plain Python, and the cases of each operator."""

import json
import math
import random
import struct
from collections import Counter
from datetime import datetime
from decimal import Decimal

import brute
import pytest
from pyspark.sql import functions as F

from slotweave.functions import jsontext
from slotweave.operators import change_feed, copy_differences, nested, neighbours, radix, snapshot_changes
from slotweave.queries import problems


@pytest.mark.parametrize("name", ["p1", "p2", "p3", "p4", "p5"])
def test_whole_tables(spark, data, name):
    got = [tuple(r) for r in problems.registry.queries[f"{name}_found"](spark, data).collect()]
    assert len(got) == len(set(got))
    assert set(got) == getattr(brute, name)(data)


TOPOLOGY = "delivery_id BIGINT, cluster_id STRING, version BIGINT, slot_count INT, slots ARRAY<STRING>, shards MAP<STRING, STRUCT<id: STRING, members: MAP<STRING, STRING>>>, previous STRING"


def _topology(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TOPOLOGY)


def test_topology_cases(spark, rows):
    s1, s1b, s2 = {"id": "s1", "members": {"a": "x", "b": "y"}}, {"id": "s1", "members": {"b": "y", "a": "x"}}, {"id": "s2", "members": None}
    df = _topology(
        spark,
        (1, "c", 1, 2, ["s1", None], {"s1": s1}),
        (2, "c", 1, 2, ["s1", ""], {"s1": s1b}),  # delivered again
        (3, "c", 4, 2, ["", "s1"], {"s1": s1b, "s2": s2}),
        (4, "c", 3, 2, ["s1"], {}),  # incomplete
        (5, "c", 9, 2, ["s2", "s1"], None),
        (6, "c", 10, 2, None, None),
        (7, None, 11, 2, ["a", "b"], None),
        (8, "d", None, 2, ["a", "b"], None),
        (9, "e", 1, 0, [], {}),
        (10, "e", 2, 0, [], {}),
    )
    assert rows(snapshot_changes.topology_changes(df)) == sorted(
        [
            ("c", 1, 4, "slot", "0", "removed"),
            ("c", 1, 4, "slot", "1", "added"),
            ("c", 1, 4, "shard", "s2", "added"),
            ("c", 4, 9, "slot", "0", "added"),
            ("c", 4, 9, "shard", "s1", "removed"),
            ("c", 4, 9, "shard", "s2", "removed"),
        ],
        key=repr,
    )
    assert snapshot_changes.topology_changes(df.limit(0)).count() == 0


def test_except_all_keeps_multiplicity(spark, rows):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k INT, v STRING")
    new = spark.createDataFrame([(1, "a"), (2, None), (4, "d"), (4, "d")], "k INT, v STRING")
    gone, came = snapshot_changes.residues(old, new)
    assert rows(gone) == rows(old.exceptAll(new)) == [(1, "a"), (3, "c")]
    assert rows(came) == rows(new.exceptAll(old)) == [(4, "d"), (4, "d")]


def test_label_changes_null_keys_and_values(spark, rows):
    old = spark.createDataFrame([(None, "a"), (1, None), (2, "x")], "k INT, v STRING")
    new = spark.createDataFrame([(None, "b"), (1, None), (3, "y")], "k INT, v STRING")
    assert rows(snapshot_changes.label_changes(old, new, ["k"], "v")) == [(2, "removed"), (3, "added"), (None, "changed")]


def test_neighbours_across_blocks(spark):
    rng = random.Random(1)
    values = sorted(rng.sample(range(1000), 120))
    df = spark.createDataFrame([("k", v) for v in values + values[:5]] + [("l", 3), (None, 1), ("k", None)], "key STRING, v BIGINT")
    got = {(r.key, r.v): (r.previous, r.next) for r in neighbours.with_neighbours(df, ["key"], "v", block=16).collect()}
    want = {("k", v): (a, b) for a, v, b in zip([None, *values], values, [*values[1:], None])} | {("l", 3): (None, None)}
    assert got == want


def test_rank_in_blocks_is_dense(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("key"), "id")
    got = neighbours.rank_in_blocks(df, "key", F.xxhash64("id"), [F.col("id")], salts=8).collect()
    for key in (0, 1):
        assert sorted(r["rank"] for r in got if r["key"] == key) == list(range(250))


@pytest.mark.parametrize(
    "body, want",
    [
        ('{"batches": [{"slots": [1, null, "3"]}, null, {"from": "a"}]}', [("batch", (0,)), ("batch_slot", (0, 0)), ("batch_slot", (0, 2)), ("batch", (2,))]),
        ('{"result": {"batches": {"slots": "4, 5,,6"}}}', [("batch", (0,)), ("batch_slot", (0, 0)), ("batch_slot", (0, 1)), ("batch_slot", (0, 3))]),
        ('"{\\"report\\": {\\"batches\\": [{\\"slots\\": []}]}}"', [("batch", (0,))]),
        ('{"batches": null}', []),
        ('{"batches": [{"slots": [1', []),
        ("null", []),
        ("", []),
        ("[1, 2]", []),
        ('"text"', []),
    ],
)
def test_report_shapes(body, want):
    assert [(tag, pk) for tag, pk, _ in nested.visit_report(body)] == want


def test_nested_typed(spark, rows):
    schema = "id BIGINT, tag STRING, zsets ARRAY<STRUCT<key: STRING, members: ARRAY<STRUCT<member: STRING, score: DOUBLE>>>>"
    inf = float("inf")
    df = spark.createDataFrame([(1, "x", [("a", [("m", 1.5), None, ("n", None)]), None, ("b", None), (None, [("", inf)])]), (2, "x", None), (3, "x", []), (None, "x", [("z", [])])], schema)
    written = nested.write_tagged(nested.emit_typed(df, "id", [nested.DUMP_NODES]))
    assert rows(written.table("zset", "key STRING")) == [(1, [0], [], "a"), (1, [2], [], "b"), (1, [3], [], None)]
    assert rows(written.table("zset_member", "member STRING, score DOUBLE")) == [(1, [0, 0], [0], "m", 1.5), (1, [0, 2], [0], "n", None), (1, [3, 0], [3], "", inf)]


def test_nested_whole_tables(spark, rows):
    body = '{"batches": [null, {"from": "a", "to": "b", "keys_moved": 7, "slots": [1], "skipped_keys": ["bf:1", null, "c"], "attempts": [{"no": 1, "took": "2s"}, null, {"no": "2"}]}]}'
    reports = spark.createDataFrame([(1, body), (1, body)], "report_id BIGINT, body STRING")
    dumps = spark.createDataFrame([(2, [("a", [("m", 1.5), None])])], "dump_id BIGINT, zsets ARRAY<STRUCT<key: STRING, members: ARRAY<STRUCT<member: STRING, score: DOUBLE>>>>")
    state = ("s", "leader", "n", 3, 9, 4, ["n", None, "o"], ["p"])
    probes = spark.createDataFrame([(3, [None, state])], "probe_id BIGINT, shards ARRAY<STRUCT<shard_id: STRING, role: STRING, leader_id: STRING, term: BIGINT, commit_index: BIGINT, slots: INT, members: ARRAY<STRING>, learners: ARRAY<STRING>>>")
    written = nested.write_tagged(nested.report_rows(reports), nested.dump_rows(dumps), nested.probe_rows(probes))
    want = {
        "batch": [(1, 1, "a", "b", "7", None)],
        "batch_slot": [(1, 1, 0, "1")],
        "batch_skipped_key": [(1, 1, 0, "bf:1"), (1, 1, 2, "c")],
        "batch_attempt": [(1, 1, 0, "1", "2s"), (1, 1, 2, "2", None)],
        "zset": [(2, 0, "a")],
        "zset_member": [(2, 0, 0, "m", 1.5)],
        "shard": [(3, 1, "s", "leader", "n", 3, 9, 4)],
        "member": [(3, 1, 0, "n"), (3, 1, 2, "o")],
        "learner": [(3, 1, 0, "p")],
    }
    assert set(want) == set(nested.TABLES) and {tag: rows(nested.flat_table(written, tag, "root")) for tag in want} == want
    assert rows(nested.nested_elements(reports, dumps, probes)) == [("batch_slot", 1, 1, 0, "1"), ("learner", 3, 1, 0, "p"), ("zset_member", 2, 0, 0, "m")]


def test_nested_text_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, '{"batches": {}}'), (2, "")], "id BIGINT, body STRING")
    assert nested.emit_text(df, "id", "body", nested.visit_report).count() == 0
    assert nested.emit_text(df.limit(0), "id", "body", nested.visit_report).count() == 0


def _percentile(values, pct):
    values = sorted(values)
    return values[max(1, -(-len(values) * pct // 100)) - 1]


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(38,20)"])
def test_radix_percentiles_exact(spark, kind):
    rng = random.Random(7)
    draws = {
        "bigint": lambda: rng.choice([rng.randint(-(2**62), 2**62), 2**60 + rng.randint(0, 3), rng.randint(0, 9), 5]),
        "double": lambda: rng.choice([rng.uniform(-1e9, 1e9), rng.gauss(0, 1e-8), 0.0, -0.0, float("-inf"), 5e-324, 2.0**-1022]),
        "decimal(38,20)": lambda: Decimal(rng.randint(0, 3)) + Decimal(rng.randint(1, 9)).scaleb(-20),
    }
    data = [(g, d, draws[kind]()) for g in range(4) for d in range(3) for _ in range(rng.randint(1, 80))]
    df = spark.createDataFrame(data + [(None, 1, data[0][2]), (1, 1, None)], f"g INT, d INT, v {kind}")
    if kind == "double":
        df = df.union(spark.createDataFrame([(1, 1, float("nan"))], "g INT, d INT, v DOUBLE"))
    pcts = [0, 1, 50, 95, 100]
    found = radix.radix_percentiles(df, "v", ["g", "d"], {"fine": ["g", "d"], "coarse": ["g"]}, pcts)
    fine = {(r.g, r.d, r.pct): r.value for r in found["fine"].collect()}
    coarse = {(r.g, r.pct): r.value for r in found["coarse"].collect()}
    assert fine == {(g, d, p): _percentile([v for a, b, v in data if (a, b) == (g, d)], p) for g in range(4) for d in range(3) for p in pcts}
    assert coarse == {(g, p): _percentile([v for a, _, v in data if a == g], p) for g in range(4) for p in pcts}


def test_ordered_bits_are_those_of_a_double(spark):
    rng = random.Random(2)
    values = [0.0, 5e-324, 2.0**-1022, 1.7976931348623157e308, float("inf"), *(2.0**e for e in range(-1074, 1024, 7)), *(math.ldexp(rng.uniform(1, 2), rng.randint(-1080, 1022)) for _ in range(300))]
    values += [math.nextafter(v, 0) for v in values[5:300]]
    df = spark.createDataFrame([(s * v,) for v in values for s in (1, -1)], "v DOUBLE").select("v", radix.ordered_bits(F.col("v")).alias("bits"))
    for r in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.bits == (-1 - bits if r.v < 0 else bits)


def test_histograms_of_separate_runs_add_up(spark):
    df = spark.range(1, 60_001).select((F.col("id") % 2).alias("g"), (F.col("id") % 10).alias("part"), (F.col("id") * 1000003 % 999983 * F.pow(F.lit(10.0), F.col("id") % 10)).alias("v"))
    runs = [radix.digit_histogram(df.where(F.col("part") == p), "v", ["g", "part"]) for p in range(10)]  # each with a value range of its own
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    whole = radix.digit_histogram(df, "v", ["g"])
    assert Counter(map(tuple, whole.collect())) == Counter(tuple(r) for r in radix.merge_histograms(merged, ["g"]).collect())
    exact = {(r.g, r.pct): r.value for r in radix.radix_percentiles(df, "v", ["g"], {"all": ["g"]}, [1, 50, 99])["all"].collect()}
    got = radix.bounded_percentiles(merged, ["g"], [1, 50, 99]).collect()
    assert len(got) == 6 and all(r.low <= exact[r.g, r.pct] <= r.high <= r.low * (1 + radix.ERROR) for r in got)


def test_radix_empty(spark):
    df = spark.createDataFrame([], "g INT, v DOUBLE")
    assert radix.radix_percentiles(df, "v", ["g"], {"all": ["g"]}, [50])["all"].count() == 0


def test_canonical_json_of_long_numbers():
    canonical, long = copy_differences.canonical, b"1" * 40
    assert canonical(long + b"1") != canonical(long + b"2") and canonical(b"0." + long + b"1") != canonical(b"0." + long + b"2")
    assert canonical(b"1e-9999999") != canonical(b"0") and canonical(b"1e9999999") == canonical(b"10E9999998")
    assert canonical(long) == canonical(long + b".000") == canonical(b"0." + long + b"e40")


def test_json_of_any_depth():
    deep = "[" * 150_000 + "1.0" + "]" * 150_000
    same, other = deep.replace("1.0", " 1 "), deep.replace("1.0", "2")
    canonical = lambda text: copy_differences.canonical(text.encode())
    assert canonical(deep) == canonical(same) != canonical(other) and canonical(deep)[0] == "j"
    assert canonical('["\\u00002.5"]') != canonical("[2.5]") == canonical("[25e-1]")
    body = '{"batches": {"slots": [7]}}'
    for n in range(40):
        body = json.dumps({"report": body}) if n % 8 == 0 else '{"result": %s}' % body
    assert [(tag, pk) for tag, pk, _ in nested.visit_report(body)] == [("batch", (0,)), ("batch_slot", (0, 0))]
    assert [(tag, pk) for tag, pk, _ in nested.visit_report('{"batches": {"slots": [%s, 1]}}' % deep)] == [("batch", (0,)), ("batch_slot", (0, 0)), ("batch_slot", (0, 1))]
    for text in ('{"a":1}x', "{", "[1,]", '{"a"}', "", "nul", "[1 2]", '{"a":1,}', "[" * 150_000):
        with pytest.raises(ValueError):
            jsontext.canonical_text(text)
        with pytest.raises(ValueError):
            jsontext._nested(text, int)


def test_canonical_json():
    same = [b'{"a": 1, "b": [1.0, "x"]}', b'{ "b":[1e0,"\\u0078"],"a":1.00 }']
    assert copy_differences.canonical(same[0]) == copy_differences.canonical(same[1])
    different = [None, b"", b"null", b'"1"', b"1", b"{", b"{ ", b"NaN", b"\xff", b'{"a":"1"}', b'{"a":1}', b"[]", b"{}"]
    assert len({copy_differences.canonical(x) for x in different}) == len(different)


LOG = "shard STRING, node STRING, idx BIGINT, term BIGINT, cmd STRING, data BINARY, ts TIMESTAMP_NTZ, upto STRING, bucket STRING"
STATUS = "shard_id STRING, role STRING, commit_index BIGINT, shard STRING"


def _log(spark, *entries):
    return spark.createDataFrame([(s, "n", i, t, c, d, datetime(2017, 1, 1), "clash", "clash") for s, i, t, c, d in entries], LOG)


def test_log_differences_cases(spark, rows):
    leader = _log(spark, ("a", 1, 1, "SET", b'{"k": 1, "l": 2}'), ("a", 1, 1, "SET", b'{"l":2,"k":1}'), ("a", 2, 1, None, None), ("a", 3, 1, "SET", b"x"), ("a", 40, 1, "SET", b"{}"), ("b", 1, 1, "X", b""), (None, 1, 1, "X", b""), ("a", None, 1, "X", b""))
    follower = _log(spark, ("a", 1, 1, "SET", b'{ "l" : 2, "k" : 1.0 }'), ("a", 2, 2, "", b""), ("a", 4, 1, "SET", b"x"), ("a", 50, 1, "SET", b"{}"))
    status = spark.createDataFrame([("a", "leader", 45, "z"), ("a", "leader", 9, "z"), ("a", "follower", 44, "z"), ("b", "leader", 5, "z"), ("c", "leader", None, "z"), (None, "leader", 1, "z")], STATUS)
    assert rows(copy_differences.log_differences(leader, follower, status)) == sorted(
        [("a", 0, "commit_index"), ("b", 0, "commit_index"), ("a", 2, "term"), ("a", 2, "cmd"), ("a", 2, "data"), ("a", 3, "missing_in_follower"), ("a", 4, "missing_in_leader"), ("a", 40, "missing_in_follower")], key=repr
    )
    assert copy_differences.log_differences(leader.limit(0), follower.limit(0), status.limit(0)).count() == 0
    assert copy_differences.log_differences(leader, leader, status).where("field <> 'commit_index'").count() == 0


def test_repeated_entries_follow_one_rule(spark, rows):
    """Rows of one entry that are equal in term and time: both steps must take the same one."""
    cells = [("SET", b"1"), ("DEL", b"2"), ("ZADD", b"3")]
    for n in range(8):
        twice = [("a", i, 1, *cells[(i + n + k) % 3]) for i in range(8) for k in range(2)]
        leader, follower = _log(spark, *twice), _log(spark, *reversed(twice), ("a", 8, 1, "SET", b"9"))
        status = spark.createDataFrame([("a", "leader", 99, "z"), ("a", "follower", 99, "z")], STATUS)
        assert rows(copy_differences.log_differences(leader, follower, status)) == [("a", 8, "missing_in_leader")]
    one = _log(spark, *(("a", i, 1, "SET", b"1") for i in range(8)))
    two = _log(spark, *(("a", i, 1, cmd, b"1") for i in range(8) for cmd in ("SET", "DEL")))
    assert len({r[2] for r in rows(copy_differences.log_differences(one, two, status))}) <= 1
    assert copy_differences.log_differences(one, two, status).count() in (0, 8)


def _feed(spark, *entries):
    return spark.createDataFrame([(s, i, t, "x", d if d is None or isinstance(d, bytes) else d.encode(), "clash", 0) for s, i, t, d in entries], "shard STRING, idx BIGINT, term BIGINT, cmd STRING, data BINARY, seq STRING, _end INT").drop("_end")


def test_change_feed_cases(spark, rows, tmp_path):
    put = '{"cmd":"SET","args":{"key":"%s","value":"v"}}'
    feed = _feed(
        spark,
        ("a", 5, 1, '{"cmd":"DEL","args":{"key":"k1","1":"k2","3":"k4"}}'),
        ("a", 1, 1, put % "k1"),
        ("a", 2, 1, put % "k2"),
        ("a", 2, 1, put % "k2"),
        ("a", 3, 1, put % "k4"),
        ("a", 6, 1, put % "k2"),
        ("a", 7, 1, '{"cmd":"ZADD","args":{"key":"z","member":"m","score":"1"}}'),
        ("a", 8, 1, '{"args":{"key":"z","member":"m","1":"","x":null},"cmd":"ZREM"}'),
        ("a", 9, 1, '{"cmd":"ZADD","args":{"key":"z","member":"","score":"1"}}'),
        ("a", 10, 1, put % "lost"),
        ("a", 10, 2, put % "kept"),
        ("a", 11, 1, put % "late"),
        ("a", 12, 2, "{"),
        ("a", 13, 2, None),
        ("a", 14, 2, b"\xff"),
        ("a", 15, 2, "[]"),
        ("a", 16, 2, '{"cmd":"SET"}'),
        ("a", 17, 2, '{"cmd":"SADD","args":{"key":"k","value":"v"}}'),
        (None, 1, 1, put % "n"),
        ("b", None, 1, put % "n"),
        ("b", 1, None, put % "n"),
    )
    target = f"file://{tmp_path}/state"
    got = rows(change_feed.live_records(feed, target))
    assert got == sorted([("a", "string", "k4", "", 3), ("a", "string", "k2", "", 6), ("a", "zset", "z", "", 9), ("a", "string", "kept", "", 10)], key=repr)
    again = feed.orderBy(F.rand(3)).repartition(7)
    assert rows(change_feed.live_records(again.unionByName(feed), target)) == got  # any order, delivered twice, a second version
    assert change_feed.published(spark, target).where("NOT live").count() == 2
    assert change_feed.live_records(feed.limit(0)).count() == 0


def test_upsert_keeps_the_highest_sequence(spark, rows):
    changes = spark.createDataFrame([("s", "string", "k", "", n % 50, n % 3 > 0, str(n % 50)) for n in range(200)], change_feed.STATE)
    assert [r[4] for r in rows(change_feed.apply_changes(changes, buckets=2))] == [49]


def test_reduced_changes_may_be_given_back_in_parts(spark, rows, monkeypatch):
    """Small buffers and many buckets give the same state as one table."""
    rng = random.Random(8)
    changes = [("s", "string", f"k{rng.randint(0, 30)}", "", n, rng.random() < 0.7, "v" * rng.randint(0, 50)) for n in range(3000)]
    rng.shuffle(changes)
    want = {}
    for c in sorted(changes, key=lambda c: c[4]):
        want[c[2]] = c
    df = spark.createDataFrame(changes, change_feed.STATE).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for size in (2_000, 24 << 20):
            monkeypatch.setattr(change_feed, "BUCKET_BYTES", size)
            assert rows(change_feed.apply_changes(df)) == sorted(want.values(), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lost_terms_broadcast_or_joined(spark, rows, monkeypatch):
    rng = random.Random(3)
    log = [(rng.choice("ab"), rng.randint(0, 60), rng.randint(1, 6), b"{}") for _ in range(400)] + [(None, 1, 1, b""), ("a", None, 1, b""), ("a", 1, None, b"")]
    df = spark.createDataFrame(log, "shard STRING, idx BIGINT, term BIGINT, data BINARY")
    valid = [e for e in log if None not in e[:3]]
    want = sorted((e for e in valid if not any(o[0] == e[0] and o[1] <= e[1] and o[2] > e[2] for o in valid)), key=repr)
    plain = lambda found: sorted(((r.shard, r.idx, r.term, bytes(r.data)) for r in found.collect()), key=repr)
    assert plain(change_feed.in_force(df)) == want
    monkeypatch.setattr(change_feed, "BROADCAST_ROWS", 0)
    assert plain(change_feed.in_force(df)) == want


def test_ranks_take_as_many_parts_as_rows_need(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 40)
    df = spark.range(500).select((F.col("id") % 2).alias("key"), (F.col("id") * 7919 % 501).alias("id"))
    got = neighbours.spread_rank(df, ["key"], [F.col("id")])
    assert {(r.key, r.id): r["rank"] for r in got.collect()} == {(k, v): n for k in (0, 1) for n, v in enumerate(sorted(i * 7919 % 501 for i in range(k, 500, 2)))}
    blocks = neighbours.rank_in_blocks(df, "key", F.xxhash64("id"), [F.col("id")]).collect()
    for key in (0, 1):
        assert sorted(r["rank"] for r in blocks if r["key"] == key) == list(range(250))


def test_repeated_deliveries_of_one_id(spark, rows):
    s = {"s": {"id": "s", "members": {"a": "x"}}}
    df = _topology(spark, (1, "c", 1, 2, ["s", ""], s), (1, "c", 1, 2, ["s", ""], s), (2, "c", 2, 2, ["s", "s"], s), (2, "d", 1, 1, ["s"], s), (2, "d", 1, 1, ["s"], s), (2, "d", 1, 1, ["s"], s), (1, "d", 2, 1, [""], s))
    assert rows(snapshot_changes.topology_changes(df)) == [("c", 1, 2, "slot", "1", "added"), ("d", 1, 2, "slot", "0", "removed")]
