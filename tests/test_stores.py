"""Golden values, the cases of the store operators, and batch against fold against stream."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from slotweave.engine import COMMANDS, CommandError, Engine
from slotweave.functions import bounds, geo, glob, hashing, keyspace, resp
from slotweave.operators import bloom, boards, cms, geosearch, neighbours, pubsub, ratelimit, replay, sets, slots, strings, zsets
from slotweave.plans import consensus, migration, placement, status
from slotweave.sources import topology, wal


def test_hash_tags_and_slots(spark):
    tags = {"foo": "foo", "{user:42}:profile": "user:42", "prefix{tag}suffix": "tag", "{}empty": "{}empty", "unclosed{tag": "unclosed{tag", "{first}{second}": "first", "": ""}
    numbers = {"{user:42}:profile": 3462, "foo": 9505, "user:1": 642, "user:7": 10167, "alpha": 14698, "bravo": 14473, "leaderboard": 4691, "": 0}
    df = spark.createDataFrame([(k,) for k in {*tags, *numbers}] + [(None,)], "key STRING")
    got = {r.key: (r.tag, r.slot) for r in df.select("key", keyspace.hash_tag(F.col("key")).alias("tag"), keyspace.hash_slot(F.col("key")).alias("slot")).collect()}
    assert {k: got[k][0] for k in tags} == tags and {k: got[k][1] for k in numbers} == numbers and got[None] == (None, None)
    assert all(keyspace.slot_of(k) == got[k][1] for k in got if k is not None)


def test_ring_golden():
    count = lambda owners: {s: owners.count(s) for s in sorted(set(owners))}
    two, three = (placement.Ring([f"shard-{i}" for i in range(n)]).assign() for n in (2, 3))
    assert count(two) == {"shard-0": 8602, "shard-1": 7782} and count(three) == {"shard-0": 5735, "shard-1": 4914, "shard-2": 5735}
    assert sum(a != b for a, b in zip(two, three)) == 6044
    assert list(count(placement.Ring(["s1", "s2", "s3", "s4"]).assign()).values()) == [3481, 4301, 4301, 4301]
    assert list(count(placement.Ring(["s1", "s2", "s3"]).assign(1024)).values()) == [306, 359, 359]
    assert list(count(placement.Ring(["shard-a", "shard-b"]).assign(256)).values()) == [135, 121]
    assert placement.Ring([]).assign(3) == ["", "", ""] and placement.Ring([]).lookup(1) == ""


def test_hash_golden():
    import numpy as np

    assert hashing.murmur3_32([b"", b"hello"], np.array([0, 1])).tolist() == [[0, 0x514E28B7], [0x248BFA47, 0xBB4ABCAD]]
    halves = hashing.murmur3_128([b"hello", b"", b"The quick brown fox jumps over the lazy dog"], 0)
    assert [x.tolist() for x in halves] == [[0xCBD8A7B341BD9B02, 0, 0xE34BBC7BBC071B6C], [0x5B1E906A48AE1D19, 0, 0x7A433CA9C49A9347]]
    assert hashing.murmur3_32([b"The quick brown fox jumps over the lazy dog", b"test", b"a" * 9], np.array([0])).tolist()[:2] == [[0x2E4FF723], [0xBA6BD213]]
    assert hashing.fnv1a64(b"") == 0xCBF29CE484222325 and hashing.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_geo_golden(spark):
    df = spark.createDataFrame([("Palermo", 13.361389, 38.115556), ("Catania", 15.087269, 37.502669), ("bad", 181.0, 0.0), ("null", None, 1.0)], "m STRING, lon DOUBLE, lat DOUBLE")
    bits = df.select("m", geo.encode(F.col("lon"), F.col("lat")).alias("b"))
    lon, lat = geo.decode(F.col("b"))
    got = {r.m: r for r in bits.select("m", "b", geo.geohash(F.col("b")).alias("h"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat")).collect()}
    assert (got["Palermo"].b, got["Catania"].b, got["bad"].b, got["null"].b) == (3479099956230698, 3479447370796909, None, None)
    assert (got["Palermo"].h, got["Catania"].h) == ("sqc8b49rny0", "sqdtr74hyu0")
    assert (got["Catania"].lon, got["Catania"].lat) == (15.087267, 37.502668)
    p, c = got["Palermo"], got["Catania"]
    exact = spark.range(1).select(*(geo.distance(*(F.lit(float(x)) for x in (13.361389338970184, 38.1155563954963, 15.087267458438873, 37.50266842333162)), u) for u in ("m", "km", "mi", "ft"))).first()
    assert [round(x, 2) for x in exact] == [166274.15, 166.27, 103.32, 545518.87]
    with pytest.raises(ValueError):
        geo.distance(p.lon, p.lat, c.lon, c.lat, "yd")


def test_cells_of_fewer_steps(spark):
    spread = lambda x, y, step: sum((y >> i & 1) << 2 * i | (x >> i & 1) << 2 * i + 1 for i in range(step))
    for step in (1, 5, 26):
        n = 1 << step
        cells_ = [(x % n, y % n) for x, y in [(0, 0), (n - 1, n - 1), (7, 12), (n // 2, n // 2 - 1), (n - 1, 0)]]
        df = spark.createDataFrame([(i, spread(x, y, step)) for i, (x, y) in enumerate(cells_)], "i INT, c BIGINT")
        low, high = geo.score_limits(F.col("c"), step)
        for r in df.select("i", "c", geo.neighbours(F.col("c"), step).alias("n"), low.alias("low"), high.alias("high"), geo.cell(low, step).alias("again")).collect():
            x, y = cells_[r.i]
            assert r.n == [spread((x + a) % n, (y + b) % n, step) for a, b in ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))]
            assert r.low == r.c << 2 * (26 - step) and r.high == r.c + 1 << 2 * (26 - step) and r.again == r.c
    assert [geo.steps_for_radius(m) for m in (200, 200_000, 1e7, 1.1e7, 2.1e7, 1e-9)] == [16, 6, 1, 1, 1, 26]


def _haversine(a, b):
    u, v = (math.sin(math.radians(y - x) / 2) for x, y in ((a[1], b[1]), (a[0], b[0])))
    return 2 * geo.EARTH * math.asin(math.sqrt(min(1.0, u * u + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * v * v)))


@pytest.mark.parametrize("radius", [50_000, 900_000, 7_000_000, 19_000_000, 21_000_000])
def test_geosearch_against_brute_force(spark, radius):
    rng = random.Random(radius)
    point = lambda: (rng.choice([rng.uniform(-180, 180), 179.99, -179.99, 0.0]), rng.choice([rng.uniform(-85, 85), 84.9, -84.9, 0.0]))
    centres, members = [(i, *point()) for i in range(12)], [(i, *point()) for i in range(150)]
    frame = lambda rows, name: spark.createDataFrame([*rows, (None, 0.0, 0.0), (999, None, 1.0)], f"{name} BIGINT, lon DOUBLE, lat DOUBLE")
    got = sorted((r.centre, r.member) for r in geosearch.members_within(frame(centres, "centre"), frame(members, "member"), radius).collect())
    assert got == sorted((c[0], m[0]) for c in centres for m in members if _haversine(c[1:], m[1:]) <= radius)
    with pytest.raises(ValueError):
        geosearch.members_within(frame(centres, "centre"), frame(members, "member"), 0)


def test_geosearch_shuffles_centres(spark):
    """Centres are few bytes to Spark, whatever the number of their cells; only those that the caller calls few go through the driver."""
    points = spark.range(500).select("id", (F.col("id") * 7919 % 360 - 180.0).alias("lon"), (F.col("id") * 61 % 170 - 85.0).alias("lat"))
    centres, members = points.limit(200).withColumnRenamed("id", "centre"), points.withColumnRenamed("id", "member")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = geosearch.members_within(centres, members, 1_500_000)
    assert "Broadcast" not in plan(found)
    few = geosearch.members_within(centres, members, 1_500_000, few=True)
    assert "Broadcast" in plan(few) and sorted(found.collect()) == sorted(few.collect())


@pytest.mark.parametrize("unit", ["m", "mi"])
def test_geosearch_on_the_circle(spark, unit):
    """A radius that is some member's distance to the last digit, or the next number below it; coordinates that are no numbers match nothing."""
    rng = random.Random(5)
    nan = float("nan")
    members = spark.createDataFrame([*((i, rng.uniform(-180, 180), rng.uniform(-85, 85)) for i in range(40)), (40, 10.0, 20.0), (41, 10.0, 20.000001), (42, 10.000001, 20.0), (43, -170.0, -20.0), (44, nan, 20.0), (45, 10.0, nan)], "member BIGINT, lon DOUBLE, lat DOUBLE")
    centre = spark.createDataFrame([(0, 10.0, 20.0)], "centre BIGINT, lon DOUBLE, lat DOUBLE")
    true = {r.member: r.d for r in members.where("member < 44").select("member", geo.distance(F.lit(10.0), F.lit(20.0), F.col("lon"), F.col("lat"), unit).alias("d")).collect()}
    for radius in [r for m in (0, 1, 41, 42, 43) for r in (true[m], math.nextafter(true[m], 0))]:
        got = {r.member: r.distance for r in geosearch.members_within(centre, members, radius, unit).collect()}
        assert got == {m: d for m, d in true.items() if d <= radius}


GLOBS = [
    ("abc", "abc", True), ("abc", "abd", False), ("*", "anything", True), ("*", "", True), ("abc*", "abc123", True), ("abc*", "abd123", False), ("*abc", "xxabc", True),
    ("*abc", "xxabd", False), ("news.*.eu", "news.sports.eu", True), ("news.*.eu", "news.sports.us", False), ("a*b*c", "axxbyyc", True), ("a*b*c", "axxcyyb", False),
    ("user?", "user1", True), ("user?", "user", False), ("user?", "user12", False), ("[abc]d", "ad", True), ("[abc]d", "dd", False), ("[a-z]1", "q1", True), ("[a-z]1", "Q1", False),
    ("[^a-z]1", "Q1", True), ("[^a-z]1", "q1", False), (r"a\*b", "a*b", True), (r"a\*b", "axb", False), ("", "", True), ("", "x", False), ("a[", "a[", True),
    ("[z-a]", "m", True), ("[!x]", "y", True), ("a\n*", "a\nb\n", True), ("x\\", "x\\", True), ("[]a", "a", False), ("a.c", "abc", False), ("a", "a\n", False),
]


def test_glob(spark):
    import re

    assert [bool(re.match(glob.glob_regex(p), s)) for p, s, _ in GLOBS] == [w for *_, w in GLOBS]
    df = spark.createDataFrame([(glob.glob_regex(p), s, w) for p, s, w in GLOBS], "p STRING, s STRING, w BOOLEAN")
    assert df.where(F.expr("s RLIKE p") != F.col("w")).collect() == []


def test_bounds():
    assert bounds.parse_bound("(5") == (5.0, True) and bounds.parse_bound("1e3") == (1000.0, False)
    assert bounds.parse_bound("+inf")[0] == -bounds.parse_bound("-inf")[0] < math.inf
    for bad in ("", "(", "x", " 5", "nan"):
        with pytest.raises(ValueError):
            bounds.parse_bound(bad)


def test_wire_texts():
    for value in (5, "", "text", "a\r\nb", [1, "x", [""]], []):
        assert resp.decode(resp.encode(value)) == value
    assert resp.encode((1, 0)) == "@2|1|0|\r\n" and resp.decode("@2|1|0|\r\n") == [1, 0]
    assert resp.decode(resp.encode(None)) == "" and str(resp.decode("-bad\r\n")) == "bad" and resp.encode(42.0) == "$9\r\n42.000000\r\n"
    assert resp.shortest_float(42.0) == "42" and resp.shortest_float(0.5) == "0.5"


def test_sketch_sizes_and_bounds(spark):
    assert bloom.sizing(100, 0.01) == (120 * 8, 7) and bloom.sizing(10_000, 0.01) == (11_984 * 8, 7)
    assert (cms.dimensions(0.001, 0.01), cms.dimensions(0.01, 0.01), cms.dimensions(0.0001, 0.001)) == ((2000, 7), (200, 7), (20000, 10))
    for bad in ((0, 0.01), (5, 0), (5, 1)):
        with pytest.raises(ValueError):
            bloom.sizing(*bad)
    items = spark.createDataFrame([("a", f"i{n}") for n in range(200)] + [(None, "x"), ("a", None)], "key STRING, item STRING")
    filters = bloom.merge(bloom.madd(items.where("item < 'i5'"), 400, 0.01), bloom.madd(items.where("item >= 'i5'"), 400, 0.01))
    assert bloom.exists(filters, items, 400, 0.01).where("present = 0").count() == 0
    other = items.select("key", F.concat(F.lit("o"), "item").alias("item"))
    assert bloom.exists(filters, other, 400, 0.01).where("present = 1").count() < 20
    adds = spark.createDataFrame([("k", f"w{n % 37}", n) for n in range(500)] + [("k", "big", 2**33), ("k", None, 1)], "key STRING, item STRING, n BIGINT")
    truth = {r.item: r.n for r in adds.dropna().groupBy("item").agg(F.sum("n").alias("n")).collect()}
    got = {r.item: r.estimate for r in cms.query(cms.incrby(adds, 50, 5), adds, 50, 5).collect()}
    assert got.keys() == truth.keys() and all(got[i] >= min(n, cms.MAX_CELL) for i, n in truth.items()) and got["big"] == cms.MAX_CELL


def test_strings_cases(spark, rows):
    log = [(1, 0, "SET", "a", "x", 10), (2, 5, "EXPIRE", "a", None, 1), (3, 0, "SET", "b", "y", 10), (4, 0, "DEL", "b", None, None), (5, 0, "SET", "c", None, 0), (6, 1000, "EXPIRE", "d", None, 5), (7, 0, "SET", "e", "z", 5), (8, 2, "SET", "e", "z2", None), (9, 0, "SET", None, "n", None), (9, 0, "X", "a", "n", None)]
    df = spark.createDataFrame(log, "idx BIGINT, ts_ms BIGINT, cmd STRING, key STRING, value STRING, ttl_s BIGINT")
    state = strings.replay(df)
    assert rows(state) == [("a", "x", 1005), ("c", None, None), ("e", "z2", None)]
    keys = spark.createDataFrame([("a",), ("c",), ("zz",), ("a",)], "key STRING")
    assert rows(strings.ttl(state, keys, 4)) == [("a", 1), ("a", 1), ("c", -1), ("zz", -2)]
    assert rows(strings.get(state, keys, 1005)) == [("a", None), ("a", None), ("c", None), ("zz", None)]
    rest, count = strings.delete(state, keys)
    assert rows(rest) == [("e", "z2", None)] and count.first().deleted == 2
    assert rows(strings.expire(state, spark.createDataFrame([("a", 1), ("zz", 1)], "key STRING, ttl_s BIGINT"), 1005)) == rows(state)
    assert strings.replay(df.limit(0)).count() == 0
    ops = spark.createDataFrame([(1, "SET", "n", "5"), (2, "INCR", "n", None), (3, "SET", "n", "x"), (4, "INCR", "n", None), (5, "DEL", "n", None), (6, "INCR", "n", None)], "idx BIGINT, cmd STRING, key STRING, value STRING")
    assert rows(strings.increments(ops)) == [("n", 2, 6), ("n", 4, None), ("n", 6, 1)]


def test_sets_cases(spark, rows):
    log = spark.createDataFrame([(1, "SADD", "s", "a"), (2, "SADD", "s", "a"), (3, "SREM", "s", "a"), (4, "SADD", "s", "b"), (5, "SREM", "t", "x"), (6, "SADD", None, "x"), (7, "SADD", "s", None)], "idx BIGINT, cmd STRING, key STRING, member STRING")
    state = sets.replay(log)
    assert rows(state) == [("s", "b")] and rows(sets.scard(state)) == [("s", 1)]
    asked = spark.createDataFrame([("s", ["b", "q", "b"]), ("zz", ["b"])], "key STRING, members ARRAY<STRING>")
    assert rows(sets.smismember(state, asked)) == [("s", [1, 0, 1]), ("zz", [0])]
    many = spark.createDataFrame([("s", f"m{i}") for i in range(20)], "key STRING, member STRING")
    taken, rest = sets.spop(many, 7, seed=2)
    assert taken.count() == 7 and rows(taken.union(rest)) == rows(many) and rows(sets.srand(many, 7, 2)) == rows(taken) and sets.srand(many, 99).count() == 20
    with pytest.raises(ValueError):
        sets.srand(many, -1)


def test_zsets_cases(spark, rows):
    inf, nan = math.inf, math.nan
    log = spark.createDataFrame([(i, "z", m, s) for i, (m, s) in enumerate([("a", 1.0), ("b", 1.0), ("c", -inf), ("d", inf), ("e", nan), ("f", None), (None, 1.0), ("a", 2.0)])], "idx BIGINT, key STRING, member STRING, score DOUBLE")
    state = zsets.zadd(log)
    assert rows(state) == [("z", "a", 2.0), ("z", "b", 1.0), ("z", "c", -inf), ("z", "d", inf)]
    assert [(r.member, r["rank"]) for r in zsets.zrank(state).orderBy("rank").collect()] == [("c", 0), ("b", 1), ("a", 2), ("d", 3)]
    assert [r.member for r in zsets.zrange(state, -2, -1).orderBy("rank").collect()] == ["a", "d"]
    assert zsets.zrange(state, 3, 1).count() == 0 and zsets.zrange(state, -99, 99).count() == 4
    assert rows(zsets.zrangebyscore(state, "-inf", "+inf").select("member")) == [("a",), ("b",)]
    assert zsets.zrangebyscore(state, "-inf", "+inf", count=0).count() == 0
    assert zsets.zcount(state, "(1", "2").first().n == 1
    assert [zsets.rank_of(state, "z", m).first()[0] for m in ("c", "d", "none")] == [0, 3, -1] and zsets.rank_of(state, "z", "c", True).first()[0] == 3
    top, rest = zsets.zpop(state, 1)
    assert top.first().member == "d" and rest.count() == 3 and zsets.zpop(state, 0)[0].count() == 0
    assert zsets.zrank(state.limit(0)).count() == 0


def test_spread_rank_equals_window(spark):
    from pyspark.sql import Window

    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice([None, "hot", "hot", "hot", "x"]), i, rng.randint(0, 5)) for i in range(700)], "key STRING, id INT, v INT")
    order = [F.desc("v"), F.col("id")]
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1)
    got = neighbours.spread_rank(df, ["key"], order, partitions=6)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (tuple(r) for r in want.collect())))


def test_boards_cases(spark, rows):
    log = spark.createDataFrame([(1, "b", "x", 5, "old"), (2, "b", "x", 3, "new"), (3, "b", "y", 8, None), (4, "b", None, 1, ""), (5, None, "x", 1, "")], "idx BIGINT, key STRING, member STRING, score BIGINT, data STRING")
    board = boards.add(log)
    assert rows(boards.ranks(board)) == [("b", "x", 8, "new", 1), ("b", "y", 8, None, 2)]
    assert boards.by_rank(board, 0).count() == 0 and boards.by_rank(board, 2).first().member == "y" and boards.rank_range(board, -5, 99).count() == 2


def test_limiters(spark):
    fixed = ratelimit.Limiter.fresh(0, 3)
    assert [fixed.check("fixed", 3, 60_000, t)[0] for t in (0, 1, 2, 3, 59_999, 60_000)] == [True, True, True, False, False, True]
    sliding = ratelimit.Limiter.fresh(0, 1)
    assert [sliding.check("sliding", 1, 10, t) for t in (0, 5, 10, 11)] == [(True, 0, 0), (False, 0, 5), (False, 0, 0), (True, 0, 0)]
    token = ratelimit.Limiter.fresh(0, 2)
    assert [token.check("token", 2, 1000, t) for t in (0, 0, 0, 500)] == [(True, 1, 0), (True, 0, 0), (False, 0, 1000), (True, 0, 0)]
    assert ratelimit.Limiter.fresh(0, 0).check("fixed", 0, 10, 20) == (False, 0, 0)
    calls = spark.createDataFrame([(i, i, "k", 3, 60_000, None) for i in range(5)] + [(9, 1, None, 3, 1, None)], "idx BIGINT, ts_ms BIGINT, key STRING, limit BIGINT, window_ms BIGINT, type STRING")
    assert [r.allowed for r in ratelimit.check(calls).orderBy("idx").collect()] == [True] * 3 + [False] * 2


def test_channels(spark, rows):
    subs = spark.createDataFrame([("a", "channel", "news"), ("a", "pattern", "n*"), ("b", "pattern", "[x"), (None, "channel", "news"), ("c", "channel", None)], "sub_id STRING, kind STRING, topic STRING")
    pubs = spark.createDataFrame([(i, "news", str(i), "clash") for i in range(138)] + [(200, None, "m", "")], "idx BIGINT, channel STRING, message STRING, sub_id STRING")
    sent = pubsub.fan_out(pubs, subs.where("sub_id IS NOT NULL"))
    assert sent.count() == 276 and rows(pubsub.dropped(sent)) == [("a", 128, 148)] and pubsub.mailboxes(sent).count() == 128
    assert [r.seq for r in pubsub.poll(pubsub.mailboxes(sent), 126).orderBy("seq").collect()] == [127, 128]
    assert pubsub.fan_out(pubs, subs.limit(0)).count() == 0


def test_slot_movement(spark, rows):
    state = {
        "strings": spark.createDataFrame([("k", "v", None), ("old", "v", 5)], "key STRING, value STRING, expire_at_ms BIGINT"),
        "sets": spark.createDataFrame([("s", f"m{i}") for i in range(10)], "key STRING, member STRING"),
        "zsets": spark.createDataFrame([("z", "a", 1.5), ("z", "b", -1.0)], "key STRING, member STRING, score DOUBLE"),
        "boards": spark.createDataFrame([("b", "a", 3, None)], "key STRING, member STRING, score BIGINT, data STRING"),
    }
    everything = list(range(64))
    dumped = slots.dump(state, everything, 10, 64, chunk=4)
    assert dumped.where("store = 'sets'").count() == 3 and dumped.where("key = 'old'").count() == 0
    empty = slots.delete_slots(state, everything, 64)
    assert all(df.count() == 0 for df in empty.values())
    back = slots.restore(empty, dumped, 10)
    assert rows(back["strings"]) == [("k", "v", None)] and all(rows(back[s]) == rows(state[s]) for s in ("sets", "zsets", "boards"))
    assert slots.parse_slots("3, 1,3", 8) == [3, 1]
    for bad in ("", "9", "-1", "x"):
        with pytest.raises(ValueError):
            slots.parse_slots(bad, 8)


def test_topology_and_status(spark, rows):
    shards = topology.from_text(spark, "s1:n1=u1,n2=u2;s2:n3=u3")
    assert rows(shards) == [("s1", "n1", "u1"), ("s1", "n2", "u2"), ("s2", "n3", "u3")]
    with pytest.raises(ValueError):
        topology.from_text(spark, "s1")
    slots_df = spark.createDataFrame([(0, "s1"), (1, "s1"), (2, "s2")], "slot INT, shard STRING")
    reported = spark.createDataFrame([("n1", "s1", 4, "n1"), ("n2", "s1", 5, ""), ("n9", "s2", 7, "n9")], "node_id STRING, shard_id STRING, term BIGINT, leader_id STRING")
    views = {r.shard: r for r in status.shard_views(shards, slots_df, reported, 4).collect()}
    assert (views["s1"].healthy, views["s1"].term, views["s1"].leader, views["s1"].share) == (2, 5, "n1", 0.5)
    assert (views["s2"].healthy, views["s2"].term, views["s2"].leader) == (0, 0, None)
    progress = spark.createDataFrame([("s", n, True, m, 3) for n, m in (("a", 9), ("b", 7), ("c", 2))] + [("s", "l", False, 99, 3)], "shard STRING, node STRING, is_voter BOOLEAN, match_index BIGINT, current_term BIGINT")
    log = spark.createDataFrame([("s", i, 3 if i > 5 else 2) for i in range(10)], "shard STRING, idx BIGINT, term BIGINT")
    assert rows(consensus.commit_index(progress, log)) == [("s", 7)]
    assert consensus.commit_index(progress, log.where("term = 2")).count() == 0
    assert rows(placement.with_owners(slots_df, spark.createDataFrame([(2, "s9"), (3, "s1")], "slot INT, shard STRING"))) == [(0, "s1"), (1, "s1"), (2, "s9"), (3, "s1")]


def test_log_files(spark, tmp_path):
    spark.dataSource.register(wal.WalSource)
    path = tmp_path / "log"
    entries = [(i, 1, "SET" if i % 2 else None, f"d{i}".encode() if i % 3 else None, "") for i in range(20)]
    spark.createDataFrame(entries, wal.SCHEMA).repartition(3).write.format("wal").mode("append").option("path", str(path)).save()
    read = lambda: sorted((r.idx, r.term, r.cmd, bytes(r.data)) for r in spark.read.format("wal").option("path", str(path)).load().collect())
    assert read() == [(i, 1, c or "", d or b"") for i, _, c, d, _ in entries]
    torn = path / "torn.wal"
    frames = [wal.frame(i, 2, "X", b"y") for i in range(4)]
    torn.write_bytes(b"".join(frames)[:-3])
    assert [e[0] for e in wal.read_frames(str(torn))] == [0, 1, 2] and wal.whole_length(str(torn)) == sum(map(len, frames[:3]))
    wal.truncate(str(torn), 2)
    assert [e[0] for e in wal.read_frames(str(torn))] == [0, 1]
    (path / "bad.wal").write_bytes(b"\xff\xff\xff\xff123456")
    with pytest.raises(ValueError):
        list(wal.read_frames(str(path / "bad.wal")))


def test_engine(spark):
    e = Engine(spark, now_ms=1000)
    run = lambda cmd, **args: [tuple(r) for r in e.execute(cmd, args).collect()]
    assert run("PING") == [("PONG",)] and run("SET", key="k", value="5", ttl="10") == [("OK",)]
    assert run("GET", key="k") == [("5",)] and run("TTL", key="k") == [(10,)] and run("INCR", key="k") == [(6,)] and run("GET", key="none") == []
    assert run("DEL", **{"key": "k", "1": "x"}) == [(1,)] and run("TTL", key="k") == [(-2,)]
    assert run("SADD", key="s", value="a") == [(1,)] and run("SADD", key="s", value="a") == [(0,)] and run("SCARD", key="s") == [(1,)]
    assert run("ZADD", key="z", member="a", score="42") == [(1,)] and run("ZADD", key="z", member="b", score="1", xx="true") == [(0,)]
    e.checkpoint()
    assert run("ZINCRBY", key="z", member="b", increment="2.5") == [(2.5,)] and run("ZRANK", key="z", member="a") == [(1,)]
    assert run("ZRANGE", key="z", start="0", stop="-1") == [(0, "b", 2.5), (1, "a", 42.0)] and run("ZCOUNT", key="z", min="(2.5", max="+inf") == [(1,)]
    assert run("ZPOPMAX", key="z") == [(0, "a", 42.0)] and run("ZCARD", key="z") == [(1,)]
    assert run("SL_ADD", key="b", member="m", score="3") == [(3,)] and run("SL_ADD", key="b", member="m", score="4") == [(7,)] and run("SL_GETRANK", key="b", member="m") == [(1,)]
    for m, lon, lat in (("Palermo", "13.361389", "38.115556"), ("Catania", "15.087269", "37.502669")):
        run("GEOADD", key="g", member=m, longitude=lon, latitude=lat)
    assert round(run("GEODIST", key="g", member1="Palermo", member2="Catania")[0][0], 3) == 166274.152
    assert sorted(m for m, _ in run("GEOSEARCH", key="g", radius="200000", fromlonlat_lon="15", fromlonlat_lat="37")) == ["Catania", "Palermo"]
    assert run("BF_MADD", **{"key": "f", "1": "x", "2": "y"}) == [(2,)] and sorted(run("BF_MEXISTS", **{"key": "f", "1": "x", "2": "q"})) == [("q", 0), ("x", 1)]
    assert run("CMS_INITBYPROB", key="c", errRate="0.001", probability="0.01") == [("OK",)] and run("CMS_INCRBY", key="c", item="i", value="3") == [(3,)]
    assert [run("RATELIMIT_CHECK", key="r", limit="2", window_ms="5")[0][0] for _ in range(3)] == [True, True, False]
    assert run("PSUBSCRIBE", pattern="n*") == [("sub-1",)] and run("PUBLISH", channel="news", message="hi") == [(1,)] and run("POLL", id="sub-1")[0][-1] == "hi" and run("POLL", id="sub-1") == []
    for cmd, args in (("NOPE", {}), ("SET", {}), ("ZADD", {"key": "z", "member": "a", "score": "nan"}), ("ZADD", {"key": "z", "member": "a", "score": "1", "nx": "true", "xx": "true"}), ("GEOADD", {"key": "g", "member": "x", "longitude": "181", "latitude": "0"}), ("CMS_QUERY", {"key": "none", "item": "i"}), ("ZRANGEBYSCORE", {"key": "z", "min": "x", "max": "1"})):
        with pytest.raises(CommandError):
            e.execute(cmd, args)
    assert all(hasattr(e, f"_{c.lower()}") for c in COMMANDS)


def test_polls_within_a_publish_lose_no_copy(spark):
    e = Engine(spark)
    for cmd, args in (("SUBSCRIBE", {"channel": "news"}), ("PSUBSCRIBE", {"pattern": "n*", "id": "sub-1"}), ("PSUBSCRIBE", {"pattern": "*s", "id": "sub-1"})):
        e.execute(cmd, args)
    poll = lambda **args: [(r.payload, r.kind, r.pattern) for r in e.execute("POLL", {"id": "sub-1", **args}).collect()]
    copies = lambda m: [(m, "message", None), (m, "pmessage", "*s"), (m, "pmessage", "n*")]
    e.execute("PUBLISH", {"channel": "news", "message": "a"})
    assert [poll(max="1") for _ in range(2)] == [[c] for c in copies("a")[:2]]
    e.execute("PUBLISH", {"channel": "news", "message": "b"})
    assert poll(max="2") == [copies("a")[2], copies("b")[0]] and poll(max="3") == copies("b")[1:] and poll() == []
    sent = [(2 + i, "sub-1", kind, "news", pattern, m) for i in range(22) for m, kind, pattern in copies(str(i))]  # as after 22 publishes
    e.sent = spark.createDataFrame(sent, e.sent.schema)
    assert poll() + poll() == [c for i in range(22) for c in copies(str(i))] and poll() == []


def test_streams_equal_batch(spark, data):
    from slotweave.queries import stores, streams

    batch = sorted(map(tuple, strings.replay(stores.kv_log(spark, data)).select("key", "value", "expire_at_ms").collect()), key=repr)
    assert sorted(map(tuple, streams.stream_kv_replay(spark, data).select("key", "value", "expire_at_ms").collect()), key=repr) == batch

def test_mixed_log_against_a_fold(spark, rows):
    """Sorted sets, boards and strings from one log in any order of arrival, against one command after the other."""
    rng = random.Random(4)
    log, zset, board, text = [], {}, {}, {}
    for idx in range(900):
        key, member = rng.choice("ab"), rng.choice("xyz")
        n = rng.randint(-5, 9)
        cmd = rng.choice(["ZADD", "ZADD", "ZINCRBY", "ZREM", "SL_ADD", "SL_DELETE", "SET", "INCR", "DEL", "PING"])
        args = {"key": key, "member": member}
        own = (key, member)
        if cmd == "ZADD":
            mode = rng.choice(["", "nx", "xx", "both"])
            args["score"] = str(n)
            args |= {"nx": "true"} if mode in ("nx", "both") else {}
            args |= {"xx": "TRUE"} if mode in ("xx", "both") else {}
            if mode == "" or mode == "nx" and own not in zset or mode == "xx" and own in zset:
                zset[own] = float(n)
        elif cmd == "ZINCRBY":
            args["increment"] = str(n)
            zset[own] = zset.get(own, 0.0) + n
        elif cmd == "ZREM":
            args["1"] = "x"
            zset.pop(own, None), zset.pop((key, "x"), None)
        elif cmd == "SL_ADD":
            args |= {"score": str(n)} | ({"data": f"d{idx}"} if n > 0 else {})
            board[own] = (board.get(own, (0, None))[0] + n, args.get("data") or board.get(own, (0, None))[1])
        elif cmd == "SL_DELETE":
            board.pop(own, None)
        elif cmd == "SET":
            args = {"key": key, "value": rng.choice(["7", "-3", "word", ""])}
            text[key] = args["value"]
        elif cmd == "INCR":
            if key not in text:
                text[key] = "1"
            elif text[key].lstrip("-").isdigit():
                text[key] = str(int(text[key]) + 1)
        elif cmd == "DEL":
            args = {"key": key, "1": "b", "3": "a"} if n > 5 else {"key": key}
            text.pop(key, None)
            n > 5 and text.pop("b", None)
        log.append(("s", idx, 1, cmd, json.dumps({"cmd": cmd, "args": args}).encode()))
    log += [("s", 901, 1, "", b"{"), ("s", 902, 1, "", None), ("s", 903, 1, "", b'{"cmd":"ZADD"}'), ("s", 904, 1, "", b'{"cmd":"ZADD","args":{"key":"a","member":"q","score":"x"}}'), (None, 905, 1, "", log[0][4])]
    rng.shuffle(log)
    df = spark.createDataFrame(log + log[:40], "shard STRING, idx BIGINT, term BIGINT, cmd STRING, data BINARY")
    for block in (64, 1 << 20):
        assert {(r.key, r.member): r.score for r in replay.zsets(df, block).collect()} == zset
        assert {(r.key, r.member): (r.score, r.data) for r in replay.boards(df, block).collect()} == board
    assert {r.key: r.value for r in replay.strings(df).collect()} == text
    geo_ = spark.createDataFrame([("s", 1, 1, "", b'{"cmd":"GEOADD","args":{"key":"g","member":"Palermo","longitude":"13.361389","latitude":"38.115556"}}')], df.schema)
    assert rows(replay.zsets(geo_)) == [("s", "g", "Palermo", 3479099956230698.0)]
    assert replay.zsets(df.limit(0)).count() == replay.strings(df.limit(0)).count() == replay.sets(df.limit(0)).count() == 0


def test_changes_put_together():
    """Two changes in a row do the same as their sum, on a missing record and on one that is there."""
    ops = [replay.single_change(op, n) for op in ("put", "put_new", "put_old", "add", "end") for n in (2.0, -3.0)]
    for a in ops:
        for b in ops:
            for c in ops:
                for start in (None, 5.0):
                    want = replay.applied(c, replay.applied(b, replay.applied(a, start)))
                    assert replay.applied(replay.together(replay.together(a, b), c), start) == replay.applied(replay.together(a, replay.together(b, c)), start) == want


def test_use_counters_and_limiter_start(spark, rows):
    log = spark.createDataFrame([(i, i * 1000, "k") for i in range(50)] + [(60, 50_000 + 600_000, "k"), (1, 5, "once"), (None, 5, "x"), (3, None, "x")], "idx BIGINT, ts_ms BIGINT, key STRING")
    got = {r.key: (r.last_access_ms, r.frequency) for r in strings.use_counters(log, seed=1).collect()}
    assert got["once"] == (5, 5) and got["k"][0] == 650_000 and 0 <= got["k"][1] <= 1 and len(got) == 2
    calls = [(1, 0, "k", 1, 1000, "fixed", "INIT"), (2, 900, "k", 1, 1000, "fixed", None), (3, 950, "k", 1, 1000, "fixed", "CHECK"), (4, 1000, "k", 1, 1000, "fixed", "CHECK"), (5, 1001, "k", 9, 9, "fixed", "INIT")]
    df = spark.createDataFrame(calls, "idx BIGINT, ts_ms BIGINT, key STRING, `limit` BIGINT, window_ms BIGINT, type STRING, cmd STRING")
    assert rows(ratelimit.check(df)) == [(2, "k", True, 0, 0, "fixed"), (3, "k", False, 0, 50, "fixed"), (4, "k", True, 0, 0, "fixed")]


def test_drained_mailboxes(spark):
    rng = random.Random(9)
    sent = [(i, rng.choice("ab"), "message", "c", None, "x") for i in range(300)]
    polls = [(i, rng.choice("ab"), rng.randint(0, 6)) for i in range(0, 300, 4)]
    got = pubsub.drained(spark.createDataFrame(sent, "idx BIGINT, sub_id STRING, kind STRING, channel STRING, pattern STRING, payload STRING"), spark.createDataFrame(polls, "idx BIGINT, sub_id STRING, most INT"), size=7).collect()
    box, want = {"a": [0, 0, 0], "b": [0, 0, 0]}, set()
    for idx, order, own, most in sorted([(i, 0, s, 0) for i, s, *_ in sent] + [(i, 1, s, m) for i, s, m in polls]):
        state = box[own]
        if not order:
            full = state[0] - state[1] >= 7
            state[2 if full else 0] += 1
            want.add((own, idx, "copy", None if full else state[0], None, None))
        else:
            n = min(most, state[0] - state[1])
            want.add((own, idx, "poll", None, n, state[2]))
            state[1], state[2] = state[1] + n, 0
    assert {(r.sub_id, r.idx, r.event, r.seq, r.delivered, r.dropped) for r in got} == want and len(got) == len(want)


def test_globs_meet_by_their_beginning(spark):
    topics = ["news.*", "news.sport", "*", "?ews.a", "n[aeo]ws.*", "\\*x", "news", "", "ne*", "zz*"]
    names = ["news.a", "news.sport", "news", "nows.b", "*x", "", "zebra"]
    got = pubsub.matching(spark.createDataFrame([(n,) for n in names + [None]], "channel STRING"), spark.createDataFrame([(t,) for t in topics + [None]], "topic STRING"))
    import re

    assert {tuple(r) for r in got.collect()} == {(n, t) for n in names for t in topics if re.match(glob.glob_regex(t), n)}
    assert pubsub.matching(spark.createDataFrame([("a",)], "channel STRING"), spark.createDataFrame([], "topic STRING")).count() == 0


def test_migration_steps(spark, rows):
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    source = {"strings": frame([("a", "1", None), ("b", "2", 50), ("c", "3", None)], "key STRING, value STRING, expire_at_ms BIGINT"), "sets": frame([("a", "m")], "key STRING, member STRING"), "bloom": frame([("a",)], "key STRING")}
    target = {"strings": frame([("a", "old", None), ("b", "old", None)], "key STRING, value STRING, expire_at_ms BIGINT"), "sets": frame([], "key STRING, member STRING")}
    slots_ = sorted({keyspace.slot_of("a", 64), keyspace.slot_of("b", 64)} - {keyspace.slot_of("c", 64)})
    none = frame([(63, "x", "y", "copying")], "slot INT, from STRING, to STRING, state STRING")
    start = migration.Cluster(3, frame([(s, "p") for s in range(64)], "slot INT, shard STRING"), none, {"p": source, "q": target})
    done, report = migration.migrate(start, "p", "q", slots_, 100, 64)
    assert done.version == 5 and report == migration.Moved(slots_, "p", "q", 2, ["a (bloom)"])
    assert rows(done.states["p"]["strings"]) == [("c", "3", None)] and rows(done.states["p"]["sets"]) == []
    assert rows(done.states["q"]["strings"]) == [("a", "1", None), ("b", "old", None)] and rows(done.states["q"]["sets"]) == [("a", "m")]
    assert {r.slot for r in done.owners.collect() if r.shard == "q"} == set(slots_) and rows(done.migrations) == rows(none)
    for step in ("dump", "restore"):
        given_up, report = migration.migrate(start, "p", "q", slots_, 100, 64, fail=step)
        assert report.error and given_up.version == 5 and rows(given_up.owners) == rows(start.owners) and rows(given_up.migrations) == rows(none)
        assert rows(given_up.states["p"]["strings"]) == rows(source["strings"]) and rows(given_up.states["q"]["strings"]) == rows(target["strings"])
    assert migration.migrate(start, "p", "q", slots_, 100, 64, fail="mark")[0] is start
    stuck, _ = migration.migrate(start, "p", "q", slots_, 100, 64, fail="flip")
    assert stuck.version == 4 and stuck.migrations.count() == 1 + len(slots_)
    uncleaned, report = migration.migrate(start, "p", "q", slots_, 100, 64, fail="delete")
    assert report.error and uncleaned.version == 5 and rows(uncleaned.states["p"]["strings"]) == rows(source["strings"])
    with pytest.raises(ValueError):
        migration.migrate(start, "p", "q", slots_, 100, 64, fail="other")
    with pytest.raises(ValueError):
        placement.plan_moves(start.owners, done.owners, start.migrations)
    assert placement.plan_moves(start.owners, done.owners, none.limit(0)).count() == len(slots_)


def test_update_merge_and_saved_state(spark, rows, tmp_path):
    docs = lambda data: spark.createDataFrame(data, "cluster STRING, version BIGINT, text STRING")
    current = docs([("a", 5, "x"), ("b", 5, "x"), ("c", 5, "x")])
    assert rows(placement.update(current, docs([("a", 3, "y"), ("b", 9, "y"), ("b", 8, "z"), ("d", 2, "y")]), "cluster")) == [("a", 6, "y"), ("b", 9, "y"), ("c", 5, "x"), ("d", 2, "y")]
    log = lambda data: spark.createDataFrame(data, "shard STRING, idx BIGINT, term BIGINT")
    held = log([(s, i, 1) for s in "abcd" for i in range(5)])
    offered = log([("a", 3, 1), ("a", 4, 1), ("b", 3, 1), ("b", 4, 2), ("b", 5, 2), ("c", 3, 2), ("d", 0, 2), ("d", 1, 2)])
    previous = spark.createDataFrame([("a", 2, 1), ("b", 2, 1), ("c", 2, 9), ("d", -1, 0)], "shard STRING, prev_idx BIGINT, prev_term BIGINT")
    merged = rows(consensus.merge_entries(held, offered, previous))
    assert merged == sorted([("a", i, 1) for i in range(5)] + [("b", i, 1) for i in range(4)] + [("b", 4, 2), ("b", 5, 2)] + [("c", i, 1) for i in range(5)] + [("d", 0, 2), ("d", 1, 2)], key=repr)
    path = f"file://{tmp_path}/state.json"
    assert topology.load_state(spark, path) == (0, "", -1)
    topology.save_state(spark, path, 7, "n1", 12)
    topology.save_state(spark, path, 8, "", 13)
    assert topology.load_state(spark, path) == (8, "", 13)
    (tmp_path / "broken").write_text("{")
    assert topology.load_state(spark, f"file://{tmp_path}/broken") == (0, "", -1)


def test_dump_and_restore_commands(spark):
    engine = Engine(spark, now_ms=1000)
    for cmd, args in [("SET", {"key": "a", "value": "1"}), ("SET", {"key": "b", "value": "2", "ttl": "5"}), ("SADD", {"key": "s", "value": "m"}), ("BF_RESERVE", {"key": "f", "capacity": "10", "errRate": "0.1"}), ("RATELIMIT_INIT", {"key": "r", "limit": "1", "window_ms": "10"})]:
        engine.execute(cmd, args).collect()
    dumped = engine.execute("CLUSTER_DUMPSLOT", {"slots": "1", "slot": "0"}).collect()
    assert {(r.store, r.key) for r in dumped} == {("strings", "a"), ("strings", "b"), ("sets", "s"), ("skipped", "f"), ("skipped", "r")}
    other = Engine(spark, now_ms=7000)
    payload = json.dumps([r.asDict() for r in dumped])
    assert other.execute("CLUSTER_RESTORE", {"payload": payload}).first()[0] == 2  # b has expired
    assert other.execute("GET", {"key": "a"}).first()[0] == "1" and other.execute("SCARD", {"key": "s"}).first()[0] == 1
    for bad in ("{", '[{"store":"sets"}]', ""):
        with pytest.raises(CommandError):
            other.execute("CLUSTER_RESTORE", {"payload": bad})


def test_checkpoint_drops_read_mail(spark):
    engine = Engine(spark)
    own = engine.execute("SUBSCRIBE", {"channel": "c"}).first()[0]
    for n in range(4):
        engine.execute("PUBLISH", {"channel": "c", "message": str(n)}).collect()
    assert [r.payload for r in engine.execute("POLL", {"id": own, "max": "3"}).collect()] == ["0", "1", "2"]
    engine.checkpoint()
    assert engine.sent.count() == 1
    assert [r.payload for r in engine.execute("POLL", {"id": own}).collect()] == ["3"]


def test_large_and_overwritten_log_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wal, "PART", 300)
    path = str(tmp_path / "one.wal")
    entries = [(n, 1, rng_text, rng_text.encode() * (n % 7)) for n, rng_text in enumerate(['{"cmd":"x"', "SET", 'a"b', "é"] * 25)]
    with open(path, "wb") as file:
        file.write(b"".join(wal.frame(*e) for e in entries) + b"\x00\x00\x01")
    parts = wal._parts(path)
    assert len(parts) > 5 and [r[:4] for p in parts for r in wal._rows(p)] == entries
    monkeypatch.undo()
    spark.dataSource.register(wal.WalSource)
    folder = str(tmp_path / "logs")
    frame = lambda *ids: spark.createDataFrame([(i, 1, "c", b"d", "") for i in ids], "idx BIGINT, term BIGINT, cmd STRING, data BINARY, file STRING").coalesce(1)
    ids = lambda: sorted(r.idx for r in spark.read.format("wal").option("path", folder).load().collect())
    for mode, own, want in [("append", (1, 2), [1, 2]), ("append", (3,), [1, 2, 3]), ("overwrite", (4,), [4]), ("append", (5,), [4, 5]), ("overwrite", (6, 7), [6, 7])]:
        frame(*own).write.format("wal").mode(mode).option("path", folder).save()
        assert ids() == want
    assert len([n for n in (tmp_path / "logs").iterdir() if n.name.endswith(".wal")]) == 1
