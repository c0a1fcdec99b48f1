"""One command at a time: a thin facade over the stores.

``Engine.execute`` checks the arguments, then gives a DataFrame for a read, or changes the state and gives the reply
for a write.  A write replaces a store's DataFrame by a derived one; ``checkpoint`` writes the stores out and cuts
their lineage, as after a long run of single writes.  Bulk work belongs into the replays of the operator modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import geo
from slotweave.functions.keyspace import SLOTS, hash_slot, hash_tag
from slotweave.operators import bloom, boards, cms, geosearch, pubsub, sets, slots, strings, zsets
from slotweave.operators.ratelimit import Limiter
from slotweave.plans import placement
from slotweave.plans import status as shard_status
from slotweave.workspace import materialize

SCHEMAS = {
    "strings": "key STRING, value STRING, expire_at_ms BIGINT",
    "sets": "key STRING, member STRING",
    "zsets": "key STRING, member STRING, score DOUBLE",
    "boards": "key STRING, member STRING, score BIGINT, data STRING",
}


class CommandError(ValueError):
    """An unknown command, or arguments that do not fit it; the state is unchanged."""


def _number(args: dict[str, str], name: str, kind: Callable = int, default=None):
    if name not in args and default is not None:
        return default
    try:
        text = args[name]
        if text != text.strip() or "_" in text:
            raise ValueError
        value = kind(text)
        if value != value:
            raise ValueError
        return value
    except KeyError:
        raise CommandError(f"missing argument {name!r}") from None
    except ValueError:
        raise CommandError(f"argument {name!r} is no valid number") from None


def _text(args: dict[str, str], name: str) -> str:
    if not args.get(name):
        raise CommandError(f"missing argument {name!r}")
    return args[name]


def _numbered(args: dict[str, str], first: str) -> list[str]:
    found, n = [_text(args, first)], 1 if first != "1" else 2
    while str(n) in args:
        found.append(args[str(n)])
        n += 1
    return found


def _place():
    """Where a copy stands in its mailbox; the copies of one publish share its idx."""
    return F.struct("idx", "kind", "channel", F.coalesce("pattern", F.lit("")).alias("pattern"))


class Engine:
    def __init__(self, spark: SparkSession, now_ms: int = 0, seed: int = 0):
        self.spark, self.now_ms, self.seed = spark, now_ms, seed
        self.state = {store: spark.createDataFrame([], schema) for store, schema in SCHEMAS.items()}
        self.blooms: dict[str, tuple[int, float, int]] = {}
        self.sketches: dict[str, tuple[int, int]] = {}
        self.limiters: dict[str, Limiter] = {}
        self.bits = spark.createDataFrame([], "key STRING, word BIGINT, bits BIGINT")
        self.cells = spark.createDataFrame([], "key STRING, row INT, col BIGINT, n BIGINT")
        self.topics = spark.createDataFrame([], "sub_id STRING, kind STRING, topic STRING")
        self.sent = spark.createDataFrame([], "idx BIGINT, sub_id STRING, kind STRING, channel STRING, pattern STRING, payload STRING")
        self.subscribers: list[str] = []
        self.polled: dict[str, tuple] = {}
        self.published = 0

    def execute(self, cmd: str, args: dict[str, str] | None = None) -> DataFrame:
        """The result of one command; an unknown one, or one with bad arguments, raises CommandError."""
        handler = getattr(self, f"_{cmd.lower()}", None) if cmd in COMMANDS else None
        if handler is None:
            raise CommandError(f"unknown command: {cmd}")
        return handler(args or {})

    def checkpoint(self) -> None:
        """Write out everything that writes have derived; mail that has been polled is dropped."""
        self.state = {store: materialize(df, f"engine-{store}") for store, df in self.state.items()}
        if self.polled:
            read = self.spark.createDataFrame([(own, at) for own, at in self.polled.items()], "sub_id STRING, _read STRUCT<idx: BIGINT, kind: STRING, channel: STRING, pattern: STRING>")
            self.sent = self.sent.join(read, "sub_id", "left").where(F.col("_read").isNull() | (_place() > F.col("_read"))).drop("_read")
        for name in ("bits", "cells", "topics", "sent"):
            setattr(self, name, materialize(getattr(self, name), f"engine-{name}"))

    def locate(self, keys: DataFrame, owners: DataFrame, slots: int = SLOTS) -> DataFrame:
        """key, tag, slot, shard of each key."""
        rows = keys.select("key", hash_tag(F.col("key")).alias("tag"), hash_slot(F.col("key"), slots).cast("int").alias("slot"))
        return rows.join(placement.small(owners, slots), "slot", "left").select("key", "tag", "slot", "shard")

    def plan(self, old: list[str], new: list[str], slots: int = SLOTS) -> DataFrame:
        """The moves from the layout of some shards to that of others."""
        frames = [placement.owners_frame(self.spark, placement.Ring(s).assign(slots)) for s in (old, new)]
        return placement.plan_moves(*frames)

    def status(self, members: DataFrame, owners: DataFrame, probes: DataFrame, slot_count: int = SLOTS) -> DataFrame:
        """What the shards of a topology look like from the probes of its nodes; see ``plans.status``."""
        return shard_status.shard_views(members, owners, shard_status.reported_shards(shard_status.latest_probes(probes)), slot_count)

    # ---- helpers

    def _reply(self, value, kind: str = "bigint") -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"result {kind}")

    def _row(self, store: str, *values) -> DataFrame:
        return self.spark.createDataFrame([values], SCHEMAS[store])

    def _of(self, store: str, args: dict[str, str]) -> DataFrame:
        return self.state[store].where(F.col("key") == _text(args, "key"))

    def _replace(self, store: str, row: DataFrame, keys: list[str]) -> None:
        kept = self.state[store].join(row.select(*keys), keys, "left_anti")
        self.state[store] = kept.unionByName(row)

    # ---- strings

    def _ping(self, args):
        if len(args) > 1:
            raise CommandError("too many arguments")
        return self._reply(next(iter(args.values()), "PONG"), "string")

    def _set(self, args):
        ttl = _number(args, "ttl", default=0)
        self._replace("strings", self._row("strings", _text(args, "key"), args.get("value", ""), self.now_ms + ttl * 1000 if ttl > 0 else None), ["key"])
        return self._reply("OK", "string")

    def _get(self, args):
        return strings.live(self._of("strings", args), self.now_ms).select(F.col("value").alias("result"))

    def _ttl(self, args):
        asked = self.spark.createDataFrame([(_text(args, "key"),)], "key STRING")
        return strings.ttl(self.state["strings"], asked, self.now_ms).select(F.col("ttl").alias("result"))

    def _del(self, args):
        gone = self.spark.createDataFrame([(k,) for k in _numbered(args, "key")], "key STRING")
        rest, count = strings.delete(self.state["strings"], gone)
        self.state["strings"] = rest
        return count.select(F.col("deleted").alias("result"))

    def _expire(self, args):
        found = strings.live(self._of("strings", args), self.now_ms).agg(F.count(F.lit(1)).alias("result"))
        changes = self.spark.createDataFrame([(_text(args, "key"), _number(args, "ttl"))], "key STRING, ttl_s BIGINT")
        self.state["strings"] = strings.expire(self.state["strings"], changes, self.now_ms)
        return found

    def _incr(self, args):
        held = strings.live(self._of("strings", args), self.now_ms).first()
        try:
            value = int(held.value if held else 0) + 1
        except ValueError:
            raise CommandError("value is not an integer") from None
        self._replace("strings", self._row("strings", _text(args, "key"), str(value), held.expire_at_ms if held else None), ["key"])
        return self._reply(value)

    # ---- sets

    def _sadd(self, args):
        row = self._row("sets", _text(args, "key"), _text(args, "value"))
        new = 1 - sets.sismember(self.state["sets"], row).first().is_member
        self._replace("sets", row, ["key", "member"])
        return self._reply(new)

    def _srem(self, args):
        row = self._row("sets", _text(args, "key"), _text(args, "value"))
        there = sets.sismember(self.state["sets"], row)
        self.state["sets"] = sets.srem(self.state["sets"], row)
        return there.select(F.col("is_member").alias("result"))

    def _scard(self, args):
        return self._of("sets", args).agg(F.count(F.lit(1)).alias("result"))

    def _smembers(self, args):
        return self._of("sets", args).select(F.col("member").alias("result"))

    def _sismember(self, args):
        row = self._row("sets", _text(args, "key"), _text(args, "value"))
        return sets.sismember(self.state["sets"], row).select(F.col("is_member").alias("result"))

    def _smismember(self, args):
        rows = self.spark.createDataFrame([(_text(args, "key"), m) for m in _numbered(args, "value")], SCHEMAS["sets"])
        return sets.sismember(self.state["sets"], rows).select("member", F.col("is_member").alias("result"))

    def _srand(self, args):
        return sets.srand(self._of("sets", args), _number(args, "value", default=1), self.seed).select(F.col("member").alias("result"))

    def _spop(self, args):
        taken = materialize(sets.srand(self._of("sets", args), _number(args, "value", default=1), self.seed), "engine-taken")
        self.state["sets"] = sets.srem(self.state["sets"], taken)
        return taken.select(F.col("member").alias("result"))

    # ---- sorted sets

    def _zadd(self, args):
        flag = lambda name: args.get(name, "").lower() == "true"
        if flag("nx") and flag("xx"):
            raise CommandError("nx and xx exclude each other")
        row = self._row("zsets", _text(args, "key"), _text(args, "member"), _number(args, "score", float))
        there = zsets.zscore(self.state["zsets"], row).first().score is not None
        if flag("nx") and there or flag("xx") and not there:
            return self._reply(0)
        self._replace("zsets", row, ["key", "member"])
        return self._reply(1)

    def _zincrby(self, args):
        key, member, by = _text(args, "key"), _text(args, "member"), _number(args, "increment", float)
        score = (zsets.zscore(self.state["zsets"], self._row("zsets", key, member, by)).first().score or 0.0) + by
        self._replace("zsets", self._row("zsets", key, member, score), ["key", "member"])
        return self._reply(score, "double")

    def _zrem(self, args):
        key = _text(args, "key")
        gone = self.spark.createDataFrame([(key, m) for name, m in args.items() if name != "key"], SCHEMAS["sets"])
        count = self.state["zsets"].join(gone, ["key", "member"], "left_semi").agg(F.count(F.lit(1)).alias("result"))
        self.state["zsets"] = zsets.zrem(self.state["zsets"], gone)
        return count

    def _zscore(self, args):
        return self._of("zsets", args).where(F.col("member") == _text(args, "member")).select(F.col("score").alias("result"))

    def _zcard(self, args):
        return self._of("zsets", args).agg(F.count(F.lit(1)).alias("result"))

    def _zrank(self, args, rev: bool = False):
        return zsets.rank_of(self.state["zsets"], _text(args, "key"), _text(args, "member"), rev).select(F.col("rank").alias("result"))

    def _zrevrank(self, args):
        return self._zrank(args, rev=True)

    def _zrange(self, args, rev: bool | None = None):
        rev = args.get("rev", "").lower() == "true" if rev is None else rev
        return zsets.zrange(self._of("zsets", args), _number(args, "start"), _number(args, "stop"), rev).select("rank", "member", "score").orderBy("rank")

    def _zrevrange(self, args):
        return self._zrange(args, rev=True)

    def _zrangebyscore(self, args, rev: bool = False):
        try:
            found = zsets.zrangebyscore(self._of("zsets", args), _text(args, "min"), _text(args, "max"), _number(args, "offset", default=0), _number(args, "count") if "count" in args else None, rev)
        except CommandError:
            raise
        except ValueError as error:
            raise CommandError(str(error)) from None
        return found.select("position", "member", "score").orderBy("position")

    def _zrevrangebyscore(self, args):
        return self._zrangebyscore(args, rev=True)

    def _zcount(self, args):
        try:
            inside = zsets.within(F.col("score"), _text(args, "min"), _text(args, "max"))
        except CommandError:
            raise
        except ValueError as error:
            raise CommandError(str(error)) from None
        return self._of("zsets", args).where(inside).agg(F.count(F.lit(1)).alias("result"))

    def _zpopmax(self, args, highest: bool = True):
        taken = materialize(zsets.zpop(self._of("zsets", args), _number(args, "count", default=1), highest)[0], "engine-taken")
        self.state["zsets"] = zsets.zrem(self.state["zsets"], taken)
        return taken.select("rank", "member", "score").orderBy("rank")

    def _zpopmin(self, args):
        return self._zpopmax(args, highest=False)

    # ---- leaderboards

    def _sl_add(self, args):
        key, member = _text(args, "key"), _text(args, "member")
        held = self.state["boards"].where((F.col("key") == key) & (F.col("member") == member)).first()
        score = (held.score if held else 0) + _number(args, "score")
        self._replace("boards", self._row("boards", key, member, score, args.get("data")), ["key", "member"])
        return self._reply(score)

    def _sl_delete(self, args):
        row = self._row("sets", _text(args, "key"), _text(args, "member"))
        there = self.state["boards"].join(row, ["key", "member"], "left_semi").agg((F.count(F.lit(1)) > 0).alias("result"))
        self.state["boards"] = boards.delete(self.state["boards"], row)
        return there

    def _sl_getrank(self, args):
        return boards.ranks(self._of("boards", args)).where(F.col("member") == _text(args, "member")).select(F.col("rank").alias("result"))

    _sl_get_rank_by_name = _sl_getrank

    def _sl_get_by_rank(self, args):
        return boards.by_rank(self._of("boards", args), _number(args, "rank")).select("rank", "member", "score", "data").orderBy("rank")

    def _sl_get_rank_range(self, args):
        return boards.rank_range(self._of("boards", args), _number(args, "start"), _number(args, "end")).select("rank", "member", "score", "data").orderBy("rank")

    def _sl_get_score_range(self, args):
        return boards.score_range(self._of("boards", args), _number(args, "min"), _number(args, "max")).select("rank", "member", "score", "data").orderBy("rank")

    def _sl_len(self, args):
        return self._of("boards", args).agg(F.count(F.lit(1)).alias("result"))

    # ---- geographic members, kept as sorted sets

    def _geoadd(self, args):
        lon, lat = _number(args, "longitude", float), _number(args, "latitude", float)
        if not (geo.LONGITUDE[0] <= lon <= geo.LONGITUDE[1] and geo.LATITUDE[0] <= lat <= geo.LATITUDE[1]):
            raise CommandError("invalid coord")
        row = self.spark.range(1).select(F.lit(_text(args, "key")).alias("key"), F.lit(_text(args, "member")).alias("member"), geo.encode(F.lit(lon), F.lit(lat)).cast("double").alias("score"))
        self._replace("zsets", row, ["key", "member"])
        return self._reply(1)

    def _located(self, args, names: list[str]) -> DataFrame:
        own = self._of("zsets", args).where(F.col("member").isin(names)) if names else self._of("zsets", args)
        lon, lat = geo.decode(F.col("score").cast("bigint"))
        return own.select("member", lon.alias("lon"), lat.alias("lat"), "score")

    def _geopos(self, args):
        return self._located(args, [m for name, m in args.items() if name != "key"]).drop("score")

    def _geohash(self, args):
        found = self._located(args, [m for name, m in args.items() if name != "key"])
        return found.select("member", geo.geohash(F.col("score").cast("bigint")).alias("result"))

    def _geodist(self, args):
        unit = args.get("unit", "m").lower()
        if unit not in geo.UNITS:
            raise CommandError(f"unsupported unit {unit!r}")
        a, b = (self._located(args, [_text(args, name)]) for name in ("member1", "member2"))
        pair = a.select(F.lit(0).alias("k"), "lon", "lat").join(b.select(F.lit(0).alias("k"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "k")  # one row each
        return pair.select(geo.distance(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"), unit).alias("result"))

    def _geosearch(self, args):
        points = self._located(args, [])
        if "frommember" in args:
            centre = points.where(F.col("member") == args["frommember"]).select(F.lit("centre").alias("centre"), "lon", "lat")
        else:
            lon, lat = _number(args, "fromlonlat_lon", float), _number(args, "fromlonlat_lat", float)
            centre = self.spark.createDataFrame([("centre", lon, lat)], "centre STRING, lon DOUBLE, lat DOUBLE")
        radius = _number(args, "radius", float)
        if radius <= 0:
            raise CommandError("radius must be positive")
        return geosearch.members_within(centre, points, radius, few=True).select("member", "distance")


    # ---- sketches: parameters are kept per key, the bits and cells in one table for all keys

    def _known(self, table: dict, args) -> tuple:
        key = _text(args, "key")
        if key not in table:
            raise CommandError(f"no such key: {key}")
        return key, table[key]

    def _bf_reserve(self, args):
        key = _text(args, "key")
        if key in self.blooms:
            raise CommandError("key exists")
        self._bf_create(key, _number(args, "capacity"), _number(args, "errRate", float))
        return self._reply("OK", "string")

    def _bf_create(self, key: str, capacity: int, error_rate: float) -> None:
        try:
            bloom.sizing(capacity, error_rate)
        except ValueError as error:
            raise CommandError(str(error)) from None
        self.blooms[key] = (capacity, error_rate, 0)

    def _items(self, key: str, items: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(key, item) for item in items], "key STRING, item STRING")

    def _bf_madd(self, args):
        key = _text(args, "key")
        items = _numbered(args, "1") if "1" in args else []
        if key not in self.blooms:
            self._bf_create(key, bloom.CAPACITY, bloom.ERROR)
        capacity, error_rate, inserted = self.blooms[key]
        self.bits = bloom.merge(self.bits, bloom.madd(self._items(key, items), capacity, error_rate))
        self.blooms[key] = (capacity, error_rate, inserted + len(items))
        return self._reply(len(items))

    def _bf_mexists(self, args):
        key = _text(args, "key")
        items = _numbered(args, "1") if "1" in args else [_text(args, "item")]
        capacity, error_rate, _ = self.blooms.get(key, (bloom.CAPACITY, bloom.ERROR, 0))
        return bloom.exists(self.bits, self._items(key, items), capacity, error_rate).select("item", F.col("present").alias("result"))

    _bf_exists = _bf_mexists

    def _bf_info(self, args):
        _, (capacity, error_rate, inserted) = self._known(self.blooms, args)
        bits, hashes = bloom.sizing(capacity, error_rate)
        row = (capacity, bits // 8, hashes, error_rate, inserted)
        return self.spark.createDataFrame([row], "capacity BIGINT, size_bytes BIGINT, hashes BIGINT, error_rate DOUBLE, inserted BIGINT")

    def _cms_create(self, args, width: int, depth: int):
        key = _text(args, "key")
        if key in self.sketches:
            raise CommandError("key exists")
        if width <= 0 or depth <= 0:
            raise CommandError("width and height must be positive")
        self.sketches[key] = (width, depth)
        return self._reply("OK", "string")

    def _cms_initbydim(self, args):
        return self._cms_create(args, _number(args, "width"), _number(args, "height"))

    def _cms_initbyprob(self, args):
        try:
            width, depth = cms.dimensions(_number(args, "errRate", float), _number(args, "probability", float))
        except CommandError:
            raise
        except ValueError as error:
            raise CommandError(str(error)) from None
        return self._cms_create(args, width, depth)

    def _cms_incrby(self, args):
        key, (width, depth) = self._known(self.sketches, args)
        by = _number(args, "value")
        if not 0 <= by <= cms.MAX_CELL:
            raise CommandError("value out of range")
        adds = self._items(key, [_text(args, "item")]).withColumn("n", F.lit(by).cast("bigint"))
        self.cells = cms.merge(self.cells, cms.incrby(adds, width, depth))
        return self._cms_query(args)

    def _cms_query(self, args):
        key, (width, depth) = self._known(self.sketches, args)
        return cms.query(self.cells, self._items(key, [_text(args, "item")]), width, depth).select(F.col("estimate").alias("result"))

    # ---- rate limiters

    def _ratelimit_args(self, args) -> tuple[str, int, int, str]:
        limit, window = _number(args, "limit"), _number(args, "window_ms")
        if limit <= 0 or window <= 0:
            raise CommandError("limit and window must be positive")
        return _text(args, "key"), limit, window, args.get("type", "fixed")

    def _ratelimit_init(self, args):
        key, limit, _, _ = self._ratelimit_args(args)
        self.limiters.setdefault(key, Limiter.fresh(self.now_ms, limit))
        return self._reply("OK", "string")

    def _ratelimit_check(self, args):
        key, limit, window, kind = self._ratelimit_args(args)
        reply = self.limiters.setdefault(key, Limiter.fresh(self.now_ms, limit)).check(kind, limit, window, self.now_ms)
        return self.spark.createDataFrame([(*reply, kind)], "allowed BOOLEAN, remaining BIGINT, retry_after_ms BIGINT, type STRING")

    # ---- channels

    def _subscribed(self, args, kind: str, topic: str):
        own = args.get("id") if args.get("id") in set(self.subscribers) else f"sub-{len(self.subscribers) + 1}"
        if own not in self.subscribers:
            self.subscribers.append(own)
        self.topics = self.topics.unionByName(self.spark.createDataFrame([(own, kind, topic)], self.topics.schema)).distinct()
        return self._reply(own, "string")

    def _subscribe(self, args):
        return self._subscribed(args, "channel", _text(args, "channel"))

    def _psubscribe(self, args):
        return self._subscribed(args, "pattern", args.get("pattern") or _text(args, "channel"))

    def _unsubscribe(self, args, kind: str = "channel"):
        gone = (F.col("sub_id") == _text(args, "id")) & (F.col("kind") == kind)
        if args.get(kind):
            gone = gone & (F.col("topic") == args[kind])
        count = self.topics.agg(F.count_if(gone).alias("result"))
        self.topics = self.topics.where(~gone)
        return count

    def _punsubscribe(self, args):
        return self._unsubscribe(args, "pattern")

    def _publish(self, args):
        message = self.spark.createDataFrame([(self.published, _text(args, "channel"), args.get("message", ""))], "idx BIGINT, channel STRING, message STRING")
        self.published += 1
        sent = materialize(pubsub.fan_out(message, self.topics), "engine-sent")
        self.sent = self.sent.unionByName(sent)
        return sent.agg(F.count(F.lit(1)).alias("result"))

    def _poll(self, args):
        own, most = _text(args, "id"), _number(args, "max", default=64)
        box = self.sent.where(F.col("sub_id") == own)
        place = _place()  # a page may end between the copies of one publish
        if own in self.polled:
            idx, *rest = self.polled[own]
            box = box.where(place > F.struct(F.lit(idx).cast("bigint").alias("idx"), *(F.lit(v).alias(n) for n, v in zip(("kind", "channel", "pattern"), rest))))
        read = materialize(pubsub.poll(pubsub.mailboxes(box), most=most), "engine-polled")
        if (last := read.agg(F.max(place)).first()[0]) is not None:
            self.polled[own] = tuple(last)
        return read.select("seq", "kind", "channel", "pattern", "payload").orderBy("seq")

    def _pubsub_channels(self, args):
        return pubsub.channels(self.topics)

    # ---- slots

    def _wanted(self, args) -> tuple[list[int], int]:
        count = _number(args, "slots", default=SLOTS)
        try:
            return slots.parse_slots(",".join(filter(None, (args.get("slot"), args.get("slot_list")))), count), count
        except ValueError as error:
            raise CommandError(str(error)) from None

    def _cluster_dumpslot(self, args):
        wanted, count = self._wanted(args)
        named = {"bloom": self.blooms, "cms": self.sketches, "ratelimit": self.limiters}
        others = {store: self.spark.createDataFrame([(key,) for key in keys], "key STRING") for store, keys in named.items() if keys}
        return slots.dump({**self.state, **others}, wanted, self.now_ms, count)

    def restore(self, dumped: DataFrame) -> DataFrame:
        """Put the keys of a dump in place of the state's own; the reply counts those that were restored."""
        dumped = materialize(dumped, "engine-dump")
        self.state = slots.restore(self.state, dumped, self.now_ms)
        return slots.restored_keys(dumped, self.now_ms).agg(F.count(F.lit(1)).alias("result"))

    def _cluster_restore(self, args):
        """The payload is a JSON array of a dump's rows (store, key, chunk, entry)."""
        text = _text(args, "payload")
        schema = "array<struct<slot: bigint, store: string, key: string, chunk: bigint, entry: string>>"
        rows = self.spark.createDataFrame([(text,)], "payload STRING").select(F.from_json("payload", schema).alias("rows"))
        if rows.where("rows IS NULL OR exists(rows, r -> r IS NULL OR r.store IS NULL OR r.key IS NULL OR r.entry IS NULL)").count():
            raise CommandError("invalid payload")
        return self.restore(rows.select(F.inline("rows")))

    def _cluster_delslot(self, args):
        wanted, count = self._wanted(args)
        self.state = slots.delete_slots(self.state, wanted, count)
        return self._reply("OK", "string")


COMMANDS = frozenset(
    "PING SET GET TTL DEL EXPIRE INCR SADD SREM SCARD SMEMBERS SISMEMBER SMISMEMBER SPOP SRAND ZADD ZINCRBY ZREM ZSCORE ZCARD ZRANK ZREVRANK ZRANGE ZREVRANGE"
    " ZRANGEBYSCORE ZREVRANGEBYSCORE ZCOUNT ZPOPMAX ZPOPMIN SL_ADD SL_DELETE SL_GETRANK SL_GET_RANK_BY_NAME SL_GET_BY_RANK SL_GET_RANK_RANGE"
    " SL_GET_SCORE_RANGE SL_LEN GEOADD GEOPOS GEODIST GEOHASH GEOSEARCH BF_RESERVE BF_MADD BF_EXISTS BF_MEXISTS BF_INFO CMS_INITBYDIM CMS_INITBYPROB"
    " CMS_INCRBY CMS_QUERY RATELIMIT_INIT RATELIMIT_CHECK SUBSCRIBE PSUBSCRIBE UNSUBSCRIBE PUNSUBSCRIBE PUBLISH POLL PUBSUB_CHANNELS CLUSTER_DUMPSLOT"
    " CLUSTER_RESTORE CLUSTER_DELSLOT".split()
)
