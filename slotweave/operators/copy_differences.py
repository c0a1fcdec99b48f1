"""Differences between two copies of a dataset, by a matrix of checksums.

Rows are put into key buckets; for each bucket and column an additive wide hash is summed on either side.  Sums need
one small aggregate per copy, and equal sums mean equal contents.  Only the buckets whose sums differ are read
again, with only the columns that differ somewhere, and joined key by key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions.jsontext import canonical_text
from slotweave.workspace import materialize

BUCKET = 32  # neighbouring log indexes in a bucket


def canonical(data: bytes | None) -> str | None:
    """One text for each JSON value, and another one for bytes that are no JSON; None stays None.

    Key order, white space, escapes and the spelling of numbers do not count.  Of repeated keys the last counts.
    """
    if data is None:
        return None
    try:
        return "j" + canonical_text(data.decode("utf-8"))
    except (ValueError, ArithmeticError):
        return "b" + data.hex()


@F.pandas_udf(T.StringType())
def canonical_json(data: pd.Series) -> pd.Series:
    return pd.Series([canonical(x) for x in data], dtype=object)


def _wide(key: list[Column], column: Column, name: str) -> list[Column]:
    """Four BIGINT sums of 32-bit parts: a 128-bit additive hash that no bucket below 2^31 rows overflows."""
    sums = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *key, column.isNull(), column)
        sums += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_{seed}l"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"{name}_{seed}h")]
    return sums


def checksum_matrix(rows: DataFrame, bucket: list[str], keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each bucket: the key hash 'key' and a hash for each column, as an array of four sums each."""
    key = [F.col(k) for k in keys]
    sums = _wide(key, F.lit(0), "key") + [s for c in columns for s in _wide(key, F.col(c), c)]
    matrix = rows.groupBy(*bucket).agg(*sums)
    parts = lambda c: F.array(*(f"{c}_{s}{h}" for s in (1, 2) for h in "lh")).alias(c)
    return matrix.select(*bucket, parts("key").alias("_key"), *(parts(c).alias(f"_{c}") for c in columns))


def unequal_buckets(left: DataFrame, right: DataFrame, bucket: list[str], columns: list[str]) -> DataFrame:
    """bucket columns, and for each column whether its checksums differ; buckets with equal keys and columns are left out."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in bucket], "full")
    differs = lambda c: ~F.col(f"a._{c}").eqNullSafe(F.col(f"b._{c}"))
    flags = joined.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in bucket), differs("key").alias("differs_key"), *(differs(c).alias(f"differs_{c}") for c in columns))
    return flags.where(" OR ".join(["differs_key", *(f"differs_{c}" for c in columns)]))


FIELDS = ["term", "cmd", "data"]


def _digests(log: DataFrame, commits: DataFrame) -> DataFrame:
    """shard, bucket, idx, term and two 64-bit hashes each of cmd and data, for the compared entries, each once.

    Of repeated rows that with the highest term counts, then the latest, then that with the greatest hashes.  The
    texts become hashes before the first shuffle, and are read and parsed once.
    """
    rows = log.where("shard IS NOT NULL AND idx IS NOT NULL").join(commits, "shard").where("idx <= upto")
    rows = rows.select("shard", "idx", F.floor(F.col("idx") / BUCKET).cast("bigint").alias("bucket"), "term", "ts", "cmd", canonical_json("data").alias("data"))
    hashes = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(seed), c)).alias(f"{c}{seed}") for c in ("cmd", "data") for seed in (7, 8)]
    names = ["term", "ts", "cmd7", "cmd8", "data7", "data8"]
    rows = rows.select("shard", "bucket", "idx", "term", "ts", *hashes)
    once = rows.groupBy("shard", "bucket", "idx").agg(F.max(F.struct(*names)).alias("_row"))
    pair = lambda c: F.struct(F.col(f"_row.{c}7").alias("a"), F.col(f"_row.{c}8").alias("b"))
    return once.select("shard", "bucket", "idx", "_row.term", *(F.when(F.col(f"_row.{c}7").isNotNull(), pair(c)).alias(c) for c in ("cmd", "data")))


def commit_indexes(status: DataFrame) -> DataFrame:
    """shard, leader, follower: the largest commit index reported for the shard's copy in each role, null if none."""
    role = lambda name: F.max(F.when(F.col("role") == name, F.col("commit_index"))).alias(name)
    return status.where("shard_id IS NOT NULL").groupBy(F.col("shard_id").alias("shard")).agg(role("leader"), role("follower"))


def log_differences(leader: DataFrame, follower: DataFrame, status: DataFrame) -> DataFrame:
    """shard, idx, field for everything that differs between a leader's and a follower's log.

    A shard whose commit indexes differ gives idx 0 and field 'commit_index'; entries up to the smaller one are
    compared.  A shard without a commit index in one role differs, and none of its entries is compared.  ``field``
    is 'missing_in_leader', 'missing_in_follower', or the field that differs; null equals null only, and data is
    compared as JSON values.  Rows with a null shard or index are not entries.
    """
    columns = ["shard", "idx", "term", "ts", "cmd", "data"]
    leader, follower = leader.select(*columns), follower.select(*columns)
    commits = materialize(commit_indexes(status), "copy-commits")
    differing = commits.where(~F.col("leader").eqNullSafe(F.col("follower"))).select("shard", F.lit(0).cast("bigint").alias("idx"), F.lit("commit_index").alias("field"))
    upto = commits.where("leader IS NOT NULL AND follower IS NOT NULL").select("shard", F.least("leader", "follower").alias("upto"))

    sides = [materialize(_digests(log, upto), "copy-entries") for log in (leader, follower)]
    matrices = [checksum_matrix(side, ["shard", "bucket"], ["shard", "idx"], FIELDS) for side in sides]
    flags = materialize(unequal_buckets(*matrices, ["shard", "bucket"], FIELDS), "copy-buckets")
    a, b = (side.join(flags.select("shard", "bucket"), ["shard", "bucket"], "left_semi").withColumn("here", F.lit(True)) for side in sides)
    joined = a.alias("a").join(b.alias("b"), ["shard", "bucket", "idx"], "full").join(flags, ["shard", "bucket"])
    both = F.col("a.here").isNotNull() & F.col("b.here").isNotNull()
    fields = [F.when(F.col("a.here").isNull(), F.lit("missing_in_leader")), F.when(F.col("b.here").isNull(), F.lit("missing_in_follower"))]
    fields += [F.when(both & F.col(f"differs_{c}") & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in FIELDS]
    found = joined.select("shard", "idx", F.explode(F.array(*fields)).alias("field")).where("field IS NOT NULL")
    return found.unionByName(differing)
