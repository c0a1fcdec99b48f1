"""Next and previous value within a key, without one task per key.

``lead`` over a window that is partitioned by the key alone puts all rows of a hot key into one task.  Here a key's
values are cut into blocks of the value range; the window runs within (key, block), and the few block heads carry
the neighbour across block borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.workspace import materialize


def with_neighbours(df: DataFrame, keys: list[str], value: str, block: int = 4096) -> DataFrame:
    """Distinct (keys, value) with columns ``previous`` and ``next``, null at the ends.

    ``value`` is an integer column.  Rows with a null key or value are left out; repeated rows count once.
    """
    rows = df.select(*keys, value).dropna().distinct().withColumn("_block", F.floor(F.col(value) / F.lit(block)).cast("bigint"))
    inside = Window.partitionBy(*keys, "_block").orderBy(value)
    rows = rows.withColumn("_after", F.lead(value).over(inside)).withColumn("_before", F.lag(value).over(inside))
    ends = rows.groupBy(*keys, "_block").agg(F.min(value).alias("_first"), F.max(value).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.select(*keys, "_block", F.lead("_first").over(across).alias("_first_after"), F.lag("_last").over(across).alias("_last_before"))
    return rows.join(ends, [*keys, "_block"]).select(
        *keys, value, F.coalesce("_before", "_last_before").alias("previous"), F.coalesce("_after", "_first_after").alias("next")
    )


ROWS = 1_000_000  # of a part of a ranking, so that parts stay small whatever the number of rows
_NUMBER_BITS = 33  # of the row number within a partition, in monotonically_increasing_id


def spread_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """The rows with a 0-based BIGINT ``rank`` within ``keys`` by ``order``, which must have no ties within a key.

    A window over the keys alone would sort a hot key in one task.  Here all rows are range-partitioned by (keys,
    order), in as many partitions as their number needs, so that a hot key spans many of them; the place of a row
    in its sorted partition is written with it, and the sizes of the key's earlier parts are added.  A column of
    that name in ``df`` is replaced.
    """
    spark = df.sparkSession
    given = materialize(df.drop(rank), "unranked")
    count = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-given.count() // ROWS))
    ranged = given.repartitionByRange(count, *keys, *order).sortWithinPartitions(*keys, *order)
    rows = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("_part", F.shiftright("_at", _NUMBER_BITS)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << _NUMBER_BITS) - 1)))
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")
    starts = sizes.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_part").alias("_p"), start.alias("_start"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(starts, same).withColumn(rank, (F.col("_start") + F.col("_at")).cast("bigint")).select(*given.columns, rank)


def rank_in_blocks(df: DataFrame, key: str, salt: Column, order: list[Column], rank: str = "rank", salts: int | None = None) -> DataFrame:
    """A 0-based number for each row within ``key``; ties of ``key`` are spread over ``salts`` blocks.

    The number follows (block, order), so it is dense within the key but is no order of the rows.  The block is
    ``salt`` modulo ``salts``; no task holds more than one block of a key.  Without ``salts`` there are as many as
    the number of rows needs.
    """
    salts = salts or -(-df.count() // ROWS) or 1
    rows = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    sizes = rows.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_salt").orderBy(*order)
    rows = rows.withColumn("_number", F.row_number().over(inside) - 1)
    same = (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_s"))
    return rows.join(sizes, same).withColumn(rank, F.col("_start") + F.col("_number")).drop("_salt", "_number", "_key", "_s", "_start")
