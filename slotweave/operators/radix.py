"""Percentiles per group by radix selection.

Values become integers in the same order, the sortable bits of a floating number; a histogram counts one group of
leading bits (a digit) per group, and for each percentile only the digit that contains its rank is followed into the
next histogram.  A digit whose values are all equal ends the search, so most percentiles are exact after one or two
histograms.

Digits lie at fixed places of those bits, whatever the values are.  So histograms of parts (partitions, days, files,
separate runs) have the same cells and add up to the histogram of the whole: those of days, kept, give months.  The
first digit is the sign, the exponent and eight bits of the fraction: it bounds each percentile to 1/256 of its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.workspace import materialize

SHIFTS = (44, 32, 20, 8, 0)  # the bits behind each digit
FIRST = SHIFTS[0]
ERROR = 2.0**-8  # of a value, after the first digit; for values of less than 2^-1022 it is 2^-1030 at most


def ordered_bits(value: Column) -> Column:
    """A BIGINT in the same order as a number: its bits as a double, those of negative numbers turned round.

    Built from exact arithmetic, so that it stays within the generated code: powers of two, and quotients by them,
    are exact.  0.0 and -0.0 are equal.  Integers above 2^53 and decimals that share a double share their bits.
    """
    x = value.cast("double")
    size = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(size)).cast("int")
    guess = F.when(power(guess) > size, guess - 1).otherwise(guess)
    exponent = F.when(power(guess + 1) <= size, guess + 1).otherwise(guess)
    fraction = ((size / power(exponent) - 1) * F.lit(2.0**52)).cast("bigint")
    bits = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(size < F.lit(2.0**-1022), (size / F.lit(2.0**-1074)).cast("bigint"))
        .when(size == F.lit(float("inf")), F.lit(2047 << 52).cast("bigint"))
        .otherwise(F.shiftleft((exponent + 1023).cast("bigint"), 52) + fraction)
    )
    return F.when(x < 0, -1 - bits).otherwise(bits)


def _counted(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    floating = isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType))
    rows = df.where(F.col(value).isNotNull() & (~F.isnan(value) if floating else F.lit(True))).dropna(subset=keys)
    return rows.select(*keys, ordered_bits(F.col(value)).alias("bits"), (F.col(value) + F.lit(0).cast(df.schema[value].dataType) if floating else F.col(value)).alias("value"))


def _digits(values: DataFrame, keys: list[str], shift: int | None) -> DataFrame:
    """keys, shift, cell, n, lo, hi of each digit; without a shift every value is a cell of its own."""
    cell = F.shiftright("bits", shift or 0).alias("cell")
    rows = values.groupBy(*keys, F.lit(-1 if shift is None else shift).alias("shift"), cell, *(["value"] if shift is None else []))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).drop("value")


def digit_histogram(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, shift, cell, n, lo, hi: rows, least and greatest value of each first digit, to be kept and merged.

    Rows with a null in ``keys``, and null or NaN values, are not counted.
    """
    return _digits(_counted(df, value, keys), keys, FIRST)


def merge_histograms(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The histogram of coarser groups, from that of finer ones or from the union of separate runs'."""
    return histogram.groupBy(*keys, "shift", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def bounded_percentiles(histogram: DataFrame, keys: list[str], pcts: list[int]) -> DataFrame:
    """keys, pct, size, low, high from merged histograms; the percentile lies between the two, ``ERROR`` apart at most."""
    found = _pick(merge_histograms(histogram.where(F.col("shift") == FIRST), keys), keys, None, pcts)
    return found.select(*keys, "pct", "size", F.col("lo").alias("low"), F.col("hi").alias("high"))


def _pick(histogram: DataFrame, keys: list[str], targets: DataFrame | None, pcts: list[int]) -> DataFrame:
    """keys, pct, rank, size, cell, lo, hi: the digit that holds each target rank, and the rank within it."""
    inside = Window.partitionBy(*keys, *([] if targets is None else ["pct"])).orderBy("lo")
    if targets is None:
        total = F.sum("n").over(Window.partitionBy(*keys))
        rows = histogram.withColumn("size", total).withColumn("through", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("pct", F.explode(F.array(*map(F.lit, pcts)))).withColumn("rank", F.greatest(F.expr("(size * pct + 99) div 100"), F.lit(1)))
    else:
        rows = histogram.join(targets.select(*keys, "pct", "rank", "size", F.col("cell").alias("above")), [*keys, "above"])
        rows = rows.withColumn("through", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where((F.col("rank") <= F.col("through")) & (F.col("rank") > F.col("through") - F.col("n")))
    return rows.select(*keys, "pct", (F.col("rank") - (F.col("through") - F.col("n"))).alias("rank"), "size", "cell", "lo", "hi")


def radix_percentiles(df: DataFrame, value: str, base: list[str], groupings: dict[str, list[str]], pcts: list[int], digits: int | None = None) -> dict[str, DataFrame]:
    """For each grouping: its keys, pct, size, value, low, high.

    The percentile is the smallest value that at least pct % of the group's values do not exceed.  ``base`` are the
    finest groups, for which the histograms are made; each grouping's keys are some of them.  Rows with a null in
    ``base``, and null or NaN values, are not counted; a group without values gives no row.

    With ``digits`` the search stops after so many digits: ``low`` and ``high`` then bound the percentile, and
    ``value`` is ``high``; after one digit they are at most ``ERROR`` apart.  Otherwise all three are equal and exact,
    in the type of the column.  Repeated values count as often as they occur.
    """
    values = materialize(_counted(df, value, base), "radix-values")
    done: dict[str, list[DataFrame]] = {name: [] for name in groupings}
    targets: dict[str, DataFrame] = {}
    current = values
    levels = [*SHIFTS, None]  # at last values that share a double
    for level, shift in enumerate(levels):
        keys = base if level == 0 else [*base, "above"]
        histogram = materialize(_digits(current, keys, shift), f"radix-digit{level}")
        last = shift is None or level + 1 == digits
        wanted = []
        for name, own in groupings.items():
            if level and name not in targets:
                continue
            merged = merge_histograms(histogram, own if level == 0 else [*own, "above"]) if shift is not None else histogram.groupBy(*own, "above", "cell", "lo", "hi").agg(F.sum("n").alias("n"))
            picked = materialize(_pick(merged, own, targets.get(name), pcts), f"radix-{name}{level}")
            done[name].append(picked if last else picked.where("lo = hi"))
            if not last and not (rest := picked.where("lo < hi")).isEmpty():
                targets[name] = rest
                wanted.append(histogram.join(rest.select(*own, "cell").distinct(), [*own, "cell"]).select(*base, "cell"))
            else:
                targets.pop(name, None)
        if last or not targets:
            break
        needed = wanted[0]
        for more in wanted[1:]:
            needed = needed.unionByName(more)
        needed = needed.distinct()
        # only the values within a digit that holds a target rank go into the next histogram
        current = values.withColumn("above", F.shiftright("bits", shift)).join(needed.withColumnRenamed("cell", "above"), [*base, "above"], "left_semi")
    results = {}
    for name, parts in done.items():
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        results[name] = whole.select(*groupings[name], "pct", "size", F.col("hi").alias("value"), F.col("lo").alias("low"), F.col("hi").alias("high"))
    return results


def probe_values(probes: DataFrame) -> DataFrame:
    """node_id, day, month, latency_ms of the reachable probes with a latency that is neither null nor negative.

    A probe that was received again counts once, as first received.
    """
    rows = probes.where("reachable AND latency_ms >= 0 AND probe_id IS NOT NULL").select("probe_id", F.struct("received_at", "node_id", F.to_date("probed_at").alias("day"), "latency_ms").alias("got"))
    once = rows.groupBy("probe_id").agg(F.min("got").alias("got")).select("got.node_id", "got.day", "got.latency_ms")
    return once.withColumn("month", F.trunc("day", "month"))


def slow_days(probes: DataFrame, pcts: tuple[int, ...] = (50, 95), factor: int = 2) -> DataFrame:
    """node_id, probe_day, pct: days on which a node's percentile is at least ``factor`` times that of its month."""
    found = radix_percentiles(probe_values(probes), "latency_ms", ["node_id", "day", "month"], {"day": ["node_id", "day", "month"], "month": ["node_id", "month"]}, list(pcts))
    month = found["month"].select("node_id", "month", "pct", F.col("value").alias("usual"))
    days = found["day"].join(month, ["node_id", "month", "pct"]).where(F.col("value") >= factor * F.col("usual"))
    return days.select("node_id", F.date_format("day", "yyyy-MM-dd").alias("probe_day"), F.col("pct").cast("int").alias("pct"))
