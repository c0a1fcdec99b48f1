"""Rate limiters: an ordered fold over the calls of each key.

A partition holds whole keys, sorted by idx; the fold passes over it batch by batch and keeps the state of one key
only, so that a hot key needs time but no memory.  The calls of one key depend on each other and can't be split.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLY = "idx BIGINT, key STRING, allowed BOOLEAN, remaining BIGINT, retry_after_ms BIGINT, type STRING"


@dataclass
class Limiter:
    """The state of one key.  The arguments of each check overrule those before."""

    start: int
    refilled: int
    available: float
    count: int = 0

    @classmethod
    def fresh(cls, now: int, limit: int) -> "Limiter":
        return cls(now, now, float(limit))

    def check(self, kind: str, limit: int, window: int, now: int) -> tuple[bool, int, int]:
        """(allowed, remaining, retry after ms) of a call at ``now``; an unknown kind counts as 'fixed'."""
        if kind == "token":
            seconds = window // 1000
            if now > self.refilled:
                self.available = float(limit) if not seconds else min(float(limit), self.available + (now - self.refilled) / 1000 * limit / seconds)
                self.refilled = now
            if self.available >= 1:
                self.available -= 1
                return True, int(self.available), 0
            return False, int(self.available), int((1 - self.available) * 1000)
        if kind == "sliding":
            if self.count and now - self.start > window:
                self.count, self.start = 0, now
            if self.count >= limit:
                return False, 0, window - (now - self.start)
        elif self.count >= limit:
            if now - self.start < window:
                return False, 0, window - (now - self.start)
            self.count, self.start = 0, now
            if limit <= 0:
                return False, 0, 0
        self.count += 1
        return True, limit - self.count, 0


def check(calls: DataFrame) -> DataFrame:
    """A reply for each call (idx, ts_ms, key, limit, window_ms, type), in the order of idx within a key.

    Calls with a null in any of these but ``type`` are left out; a null type is 'fixed'.  Rows whose ``cmd`` is
    'INIT', if there is that column, start a limiter that isn't there yet, and give no reply.
    """
    init = F.coalesce(F.col("cmd") == "INIT", F.lit(False)) if "cmd" in calls.columns else F.lit(False)
    rows = calls.select("idx", "ts_ms", "key", "limit", "window_ms", "type", init.alias("init")).dropna(subset=["idx", "ts_ms", "key", "limit", "window_ms"])

    def fold(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for idx, now, own, limit, window, kind, starts in batch.itertuples(index=False, name=None):
                if own != key:
                    key, state = own, Limiter.fresh(now, limit)
                if not starts:
                    out.append((idx, own, *state.check(kind or "fixed", limit, window, now), kind or "fixed"))
            yield pd.DataFrame(out, columns=["idx", "key", "allowed", "remaining", "retry_after_ms", "type"])

    return rows.repartition("key").sortWithinPartitions("key", "idx").mapInPandas(fold, REPLY)
