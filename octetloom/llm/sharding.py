"""Proportional stratified interleaving into shards (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, buckets_for, hash_bucket, shuffled_key, with_rank


def shard(docs: DataFrame, shards: int = 8, seed: int = 7, stratum: str = "source") -> DataFrame:
    """Return ``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0).

    Rows of each stratum are ranked in a seeded shuffle; all rows are then
    ordered by the fractional rank (2*rank+1)/(2*stratum rows), and that order
    is cut into ``shards`` equal runs. Shard sizes are at most one apart, and
    each shard holds every stratum's share of rows up to rounding.

    The law is *rows*: copies are spread like any other rows. A null stratum is
    a stratum of its own; null ids and texts sort first; repeated rows take
    neighbouring places; an empty table gives an empty result. Existing
    columns named ``shard`` or ``slot`` are replaced; other columns are kept.

    Two shuffles of the rows passed in, so select what must travel. Both deal
    by hashed or rank buckets, never by stratum, so a stratum with a third of
    all rows is no larger a task than others.
    """
    rows, ties = boxed(docs, ["shard", "slot"])
    n = rows.count()
    buckets = buckets_for(n)
    doc_id = F.col("row").getField("doc_id")
    own = F.coalesce(F.concat(F.lit("s"), F.col("row").getField(stratum).cast("string")), F.lit("-"))
    keyed = rows.select("row", own.alias("stratum"), shuffled_key(doc_id, seed).alias("key"))
    # Ties by doc_id are repeated ids: any remaining columns that differ decide.
    ranked = with_rank(keyed, ["stratum"], hash_bucket(F.col("key"), buckets), [F.col("key"), doc_id, *ties], "rank")
    frac = ranked.withColumn("place", (2 * F.col("rank") + 1) / (2 * F.col("rank_total")))
    placed = with_rank(
        frac.withColumn("all", F.lit(0)), ["all"], (F.col("place") * buckets).cast("long"),
        [F.col("place"), F.col("stratum"), F.col("rank")], "pos",
    )
    # Shard k holds positions from ceil(k*n/shards) up to the next one's first.
    numbered = placed.withColumn("shard", F.expr(f"cast(pos * {int(shards)} div pos_total as int)"))
    return numbered.select("row.*", "shard", F.expr(f"pos - (shard * pos_total + {int(shards) - 1}) div {int(shards)}").alias("slot"))
