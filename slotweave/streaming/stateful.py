"""The stores as streams: each key's state is kept by Spark, and a micro-batch changes it as the batch fold would.

State is bounded per key: one row for a string, one limiter, or a mailbox of at most 128 messages.  Entries of a
micro-batch are put in the order of idx; the string store also copes with entries that come in a later batch than
newer ones, as it keeps the idx of its last write, deletes included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slotweave.operators.pubsub import MAILBOX
from slotweave.operators.ratelimit import REPLY, Limiter


def replay_strings(log: DataFrame) -> DataFrame:
    """key, value, expire_at_ms, idx, live: the newest row of each key that a batch has changed; output mode update.

    ``log`` has the columns of ``slotweave.operators.strings``; the last row of a key is its state, and equals what
    the batch replay gives.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        write, value, expire, live, touched, touch = state.get if state.exists else (-1, None, None, False, -1, None)
        for row in pd.concat(batches).sort_values("idx").itertuples(index=False):
            ttl = None if pd.isna(row.ttl_s) else int(row.ttl_s)
            if row.cmd in ("SET", "DEL") and row.idx > write:
                write, live, value = int(row.idx), row.cmd == "SET", row.value if row.cmd == "SET" else None
                expire = int(row.ts_ms) + ttl * 1000 if live and ttl is not None and ttl > 0 else None
            elif row.cmd == "EXPIRE" and row.idx > touched and ttl is not None:
                touched, touch = int(row.idx), int(row.ts_ms) + ttl * 1000
        state.update((write, value, expire, live, touched, touch))
        ends = touch if touched > write else expire
        yield pd.DataFrame({"key": [key[0]], "value": [value], "expire_at_ms": pd.array([ends if live else None], "Int64"), "idx": [write], "live": [live]})

    kept = "write BIGINT, value STRING, expire BIGINT, live BOOLEAN, touched BIGINT, touch BIGINT"
    out = "key STRING, value STRING, expire_at_ms BIGINT, idx BIGINT, live BOOLEAN"
    return log.where("key IS NOT NULL AND idx IS NOT NULL").groupBy("key").applyInPandasWithState(fold, out, kept, "update", GroupStateTimeout.NoTimeout)


def check_limits(calls: DataFrame) -> DataFrame:
    """A reply for each call; see ``slotweave.operators.ratelimit``.  Output mode append."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limiter = Limiter(*state.get) if state.exists else None
        out = []
        for row in pd.concat(batches).sort_values("idx").itertuples(index=False):
            limiter = limiter or Limiter.fresh(row.ts_ms, row.limit)
            out.append((row.idx, key[0], *limiter.check(row.type or "fixed", row.limit, row.window_ms, row.ts_ms), row.type or "fixed"))
        state.update((int(limiter.start), int(limiter.refilled), float(limiter.available), int(limiter.count)))
        yield pd.DataFrame(out, columns=["idx", "key", "allowed", "remaining", "retry_after_ms", "type"])

    kept = "start BIGINT, refilled BIGINT, available DOUBLE, count BIGINT"
    rows = calls.select("idx", "ts_ms", "key", "limit", "window_ms", "type").dropna(subset=["idx", "ts_ms", "key", "limit", "window_ms"])
    return rows.groupBy("key").applyInPandasWithState(fold, REPLY, kept, "append", GroupStateTimeout.NoTimeout)


def fill_mailboxes(deliveries: DataFrame, size: int = MAILBOX) -> DataFrame:
    """sub_id, seq, idx, payload of the messages that a mailbox keeps; those beyond its size are dropped.  Output mode append."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        rows = pd.concat(batches).sort_values(["idx", "kind", "channel"])
        kept = rows.head(max(size - held, 0))
        state.update((held + len(kept),))
        yield pd.DataFrame({"sub_id": kept["sub_id"], "seq": range(held + 1, held + len(kept) + 1), "idx": kept["idx"], "payload": kept["payload"]})

    return deliveries.groupBy("sub_id").applyInPandasWithState(fold, "sub_id STRING, seq BIGINT, idx BIGINT, payload STRING", "held BIGINT", "append", GroupStateTimeout.NoTimeout)
