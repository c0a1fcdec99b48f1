"""Filling containers of fixed capacity with items, leaving little space unused.

Minimum bin slack: a container starts with the longest remaining item, and a subset-sum dynamic program over the
remaining lengths picks the items that fill the window closest to its capacity.  The program keeps the reachable
sums as the bits of one integer and finds the chosen counts by walking back through its steps.

Items of one length are alike, so the program runs on the histogram of lengths, which has at most ``capacity`` rows
whatever the number of items.  A filling is used as often as the counts allow.  Groups of lengths are planned in
parallel tasks; what they can't fill well is planned together at last.  The items themselves never leave the
executors: each gets its rank within its length, and the rank falls into one interval of the plan.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotweave.operators.neighbours import ROWS, rank_in_blocks
from slotweave.workspace import materialize

CAPACITY = 16_384
PLAN_BYTES = 256 << 20  # of a plan, which grows with the capacity, not with the items
_RANK_BITS = 40  # up to 2^40 items of one length


def fill_window(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How many items of each length to take so that their sum is as near to ``room`` as can be, and not above.

    ``lengths`` are sorted; longer ones are tried first, and the program stops once ``room`` itself is reached.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[at]
        left, part = min(counts[length], room // length), 1
        while left > 0:
            take = min(part, left)
            wider = (reach | (reach << (length * take))) & mask
            if wider != reach:
                steps.append((reach, length, take))
                reach = wider
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(repeats, {length: items}), ...]: container fillings that use up the histogram; longest items first."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    lengths, plan = sorted(counts), []
    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        filling = fill_window(capacity - longest, lengths, counts)
        counts[longest] += 1
        filling[longest] = filling.get(longest, 0) + 1
        repeats = min(counts[length] // n for length, n in filling.items())
        for length, n in filling.items():
            counts[length] -= repeats * n
            if not counts[length]:
                del counts[length]
                del lengths[bisect_right(lengths, length) - 1]
        plan.append((repeats, filling))
    return plan


GROUPS = 16  # of lengths, that are planned in parallel
_FEW = 500  # lengths in a group at least; fewer leave too little choice
_SLACK = 1024  # a group's container is kept if it leaves at most this part of its capacity unused


def _plan_group(capacity: int):
    def plan(group: pd.DataFrame) -> pd.DataFrame:
        made = plan_containers(dict(zip(group["length"].tolist(), group["n"].tolist())), capacity)
        return pd.DataFrame({"repeats": [r for r, _ in made], "lengths": [list(f) for _, f in made], "items": [list(f.values()) for _, f in made]})

    return plan


def plan_in_groups(spark: SparkSession, histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``plan_containers``, but most of it in parallel tasks; the same histogram gives the same plan.

    Where splitting the lengths costs more than one container in a thousand, all of them are planned together, too,
    and the better plan counts.
    """
    groups = min(GROUPS, len(histogram) // _FEW)
    if groups < 2:
        return plan_containers(histogram, capacity)
    rows = [((length * 0x9E3779B1 >> 7) % groups, length, n) for length, n in sorted(histogram.items())]
    frame = spark.createDataFrame(rows, "part INT, length BIGINT, n BIGINT").repartition(groups, "part")
    made = frame.groupBy("part").applyInPandas(_plan_group(capacity), "repeats BIGINT, lengths ARRAY<BIGINT>, items ARRAY<BIGINT>")
    plan, rest = [], {}
    for repeats, lengths, items in sorted(map(tuple, made.collect())):  # the plan, whose size depends on ``capacity`` alone
        if capacity - sum(length * n for length, n in zip(lengths, items)) <= capacity // _SLACK:
            plan.append((repeats, dict(zip(lengths, items))))
        else:
            for length, n in zip(lengths, items):
                rest[length] = rest.get(length, 0) + repeats * n
    plan += plan_containers(rest, capacity)
    containers = lambda p: sum(repeats for repeats, _ in p)
    if containers(plan) > -(-sum(length * n for length, n in histogram.items()) // capacity) * 1.001 + 1:
        plan = min(plan, plan_containers(histogram, capacity), key=containers)
    return plan


def _intervals(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan as sorted intervals of ranks within each length."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for repeats, filling in plan:
        offset = 0
        for length in sorted(filling, reverse=True):
            n, start = filling[length], used.get(length, 0)
            rows.append(((length << _RANK_BITS) + start, container, n, offset))
            used[length] = start + repeats * n
            offset += n * length
        container += repeats
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("start", "container", "each", "offset"))}


def pack(items: DataFrame, id_column: str, tokens: str, capacity: int = CAPACITY) -> DataFrame:
    """id, piece, pieces, length, container, position: where each item lies.

    An item longer than ``capacity`` is split into full containers and one rest, its ``pieces``; no other item is
    split.  ``position`` counts tokens from the start of the container.  Items with a null id or length, or a length
    below 1, take no space and give no row; repeated ids are items of their own.  Containers are numbered from 0.

    The plan that goes to every task has an interval for each length in each filling: at most 180 lengths fit into
    one container, and a filling at least halves what is left of one of at most ``capacity`` lengths.  A capacity so
    large that its plan could exceed ``PLAN_BYTES`` is refused.
    """
    spark = items.sparkSession
    lengths = items.select(F.col(id_column).alias("id"), F.col(tokens).cast("bigint").alias("tokens")).where("id IS NOT NULL AND tokens >= 1")
    pieces = F.expr(f"(tokens + {capacity - 1}) div {capacity}")
    cut = lengths.withColumn("pieces", pieces.cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.select("id", "piece", "pieces", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece") * F.lit(capacity)).alias("length"))
    cut = materialize(cut, "pack-items")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}  # at most `capacity` rows
    steps = _intervals(plan_in_groups(spark, histogram, capacity))
    if (size := sum(a.nbytes for a in steps.values())) > PLAN_BYTES:
        raise ValueError(f"a plan of {size} bytes for a capacity of {capacity}: choose a smaller capacity")
    plan = spark.sparkContext.broadcast(steps)
    hot = max(histogram.values(), default=1)

    def place(batches):
        steps = plan.value
        for batch in batches:
            if not len(batch):
                continue
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            key = (length << _RANK_BITS) + rank
            at = np.searchsorted(steps["start"], key, side="right") - 1
            within = key - steps["start"][at]
            each = steps["each"][at]
            yield pd.DataFrame({"id": batch["id"], "piece": batch["piece"], "pieces": batch["pieces"], "length": length, "container": steps["container"][at] + within // each, "position": steps["offset"][at] + within % each * length})

    ranked = rank_in_blocks(cut, "length", F.xxhash64("id", "piece"), [F.col("id"), F.col("piece")], salts=max(16, -(-hot // ROWS)))
    schema = f"id {dict(cut.dtypes)['id']}, piece INT, pieces INT, length BIGINT, container BIGINT, position BIGINT"
    return ranked.select("id", "piece", "pieces", "length", "rank").mapInPandas(place, schema)


def byt5_tokens(text: str = "text"):
    """Tokens of the public ByT5 tokenizer: the UTF-8 bytes and one end token; null for a null text."""
    return F.octet_length(F.col(text)) + F.lit(1)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The containers of whole documents; see ``pack``."""
    return pack(documents.select("doc_id", byt5_tokens().alias("tokens")), "doc_id", "tokens", capacity).withColumnRenamed("id", "doc_id")


def audit(documents: DataFrame, placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row that says whether an assignment of documents keeps the rules, recomputed from where the pieces lie.

    documents and tokens placed; documents whose pieces do not add up to their length, or that are not placed;
    documents that are split though they fit; containers above capacity; pieces that overlap or leave a gap before
    them; and whether at most 0.1 % more containers than the tokens need, and one, are used.
    """
    placed = materialize(placed, "pack-placed")
    sizes = documents.select("doc_id", byt5_tokens().alias("tokens")).where("doc_id IS NOT NULL AND tokens IS NOT NULL").groupBy("doc_id").agg(F.sum("tokens").alias("tokens"))
    own = placed.groupBy("doc_id").agg(F.sum("length").alias("placed"), F.count_distinct("container").alias("containers"))
    by_document = sizes.join(own, "doc_id", "full").agg(
        F.count("placed").alias("documents"),
        F.coalesce(F.sum("placed"), F.lit(0)).alias("tokens"),
        F.count_if(~F.col("tokens").eqNullSafe(F.col("placed"))).alias("incomplete"),
        F.count_if((F.col("tokens") <= capacity) & (F.col("containers") > 1)).alias("split_without_need"),
    )
    before = F.lag(F.col("position") + F.col("length"), 1, 0).over(Window.partitionBy("container").orderBy("position"))
    by_container = placed.withColumn("_gap", (before != F.col("position")).cast("int")).groupBy("container").agg(F.sum("length").alias("used"), F.max(F.col("position") + F.col("length")).alias("end"), F.sum("_gap").alias("gaps"))
    by_container = by_container.agg(
        F.count_if((F.col("used") > capacity) | (F.col("end") > capacity)).alias("over_full"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("misplaced"),
        (F.count(F.lit(1)) <= F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity) * 1.001 + 1).alias("near_ideal"),
    )
    return by_document.withColumn("_k", F.lit(0)).join(by_container.withColumn("_k", F.lit(0)), "_k").drop("_k")  # one row each
