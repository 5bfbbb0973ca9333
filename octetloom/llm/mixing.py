"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only)."""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BUCKETS, boxed, buckets_for, hash_bucket, shuffled_key, with_rank

#: Most slots of one period of the schedule: the sum of all integer weights.
MAX_PERIOD = 100_000
#: Most lookups (ranges of slots times sources) that the driver makes; this sets the size of a range only.
LOOKUPS = 5_000_000


def pfair_period(weights: dict[str, int]) -> list[tuple[str, int]]:
    """One period of the schedule: slot -> (source, number of its block).

    With W the sum of the weights, block j (from 0) of a source of weight w is
    released at slot floor(j*W/w) and due by slot ceil((j+1)*W/w). Each slot
    goes to the released block that is due first (then by source name). As the
    weights fill the period exactly, every block meets its deadline, so at any
    slot each source is less than one block away from its share.
    """
    total = sum(weights.values())
    if total > MAX_PERIOD:
        raise ValueError(f"the weights sum to {total}; at most {MAX_PERIOD} slots make a period")
    waiting = sorted((0, s, 0) for s in weights)
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    plan = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        _, s, j = heapq.heappop(ready)
        plan.append((s, j))
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
    return plan


def mix(
    docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = 1,
    block_rows: int = 16, seed: int = 3, source: str = "source",
) -> DataFrame:
    """Return ``docs`` with ``mix_slot`` (the schedule's slot) and
    ``mix_position`` (long, gapless from 0), the order of the mixture.

    Rows of each source, in a seeded shuffle, form blocks of ``block_rows``.
    Blocks take the slots of the Pfair schedule for the integer ``weights``
    (``default_weight`` for sources not named). No row is dropped or repeated:
    once a source has run out its slots stay idle, and the order of the rest
    holds. Weights below 1 are refused.

    A null source is a source of its own (named null, default weight); null ids
    and texts sort first in ties; repeated rows stay neighbours; an empty table
    gives an empty result. Columns ``mix_slot`` and ``mix_position`` of the
    input are replaced, others are kept.

    Partitions of the result follow the position, so a written result keeps
    the order of the mixture, one range of it in each file.

    Only the list of distinct sources (at most 100,000, else refused) reaches
    the driver. Rows are dealt by source and hashed bucket, then by slots.
    """
    spark = docs.sparkSession
    weights = dict(weights or {})
    if default_weight < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights are integers from 1")
    rows, ties = boxed(docs, ["mix_slot", "mix_position"])
    own = F.coalesce(F.concat(F.lit("s"), F.col("row").getField(source).cast("string")), F.lit("-"))
    doc_id = F.col("row").getField("doc_id")
    keyed = rows.select("row", own.alias("source"), shuffled_key(doc_id, seed).alias("key"))
    sizes = {r["source"]: r["count"] for r in keyed.groupBy("source").count().limit(MAX_PERIOD + 1).collect()}
    used = {s: weights.get(s[1:], default_weight) if s != "-" else default_weight for s in sizes}
    plan = pfair_period(used)
    total = len(plan) or 1
    period = spark.createDataFrame([(s, j, slot, used[s]) for slot, (s, j) in enumerate(plan)], "source string, j long, slot long, w long")
    n = sum(sizes.values())

    ranked = with_rank(keyed, ["source"], hash_bucket(F.col("key"), buckets_for(n)), [F.col("key"), doc_id, *ties], "rank")
    ranked = ranked.select("row", "source", "rank", F.expr(f"rank div {int(block_rows)}").alias("block"))
    # The period is bounded by MAX_PERIOD rows of four small columns, so it can be broadcast.
    weight_of = F.broadcast(period.groupBy("source").agg(F.first("w").alias("w")))
    slotted = (
        ranked.join(weight_of, "source").withColumn("j", F.expr("block % w"))
        .join(F.broadcast(period.drop("w")), ["source", "j"])
        .select("row", "rank", F.expr(f"(block div w) * {total} + slot").alias("mix_slot"))
    )
    # Rows are dealt in ranges of slots; how many rows come before each follows from the plan.
    span, before = _before(plan, sizes, used, block_rows)
    offsets = spark.createDataFrame(list(enumerate(before)), "bucket long, before long")
    dealt = slotted.withColumn("bucket", F.expr(f"mix_slot div {span}")).repartitionByRange("bucket")
    placed = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy("mix_slot", "rank")))
    # At most MAX_BUCKETS rows of two numbers.
    return placed.join(F.broadcast(offsets), "bucket").select("row.*", "mix_slot", (F.col("before") + F.col("nth") - 1).alias("mix_position"))


def _before(plan: list[tuple[str, int]], sizes: dict[str, int], weights: dict[str, int], block_rows: int) -> tuple[int, list[int]]:
    """(slots of a range, number of rows in all slots before each range). By
    slot q a source has had weight x full periods blocks, and those of its
    slots in the last period that lie before q; all blocks but its last are full."""
    total = len(plan) or 1
    last = max(((-(-n // block_rows)) // weights[s] + 1) * total for s, n in sizes.items()) if sizes else 1
    buckets = max(1, min(MAX_BUCKETS, LOOKUPS // max(len(sizes), 1)))
    span = -(-last // buckets)
    slots: dict[str, list[int]] = {s: [] for s in sizes}
    for slot, (s, _) in enumerate(plan):
        slots[s].append(slot)
    starts = [(q // total, q % total) for q in range(0, last, span)]
    before = [0] * len(starts)
    for s, n in sizes.items():
        w, had = weights[s], slots[s]
        for i, (periods, rest) in enumerate(starts):
            before[i] += min(n, block_rows * (periods * w + bisect_left(had, rest)))
    return span, before
