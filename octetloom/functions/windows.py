"""Window recipes: islands, gaps, sweeps, capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, groups: list[str], position: str, out: str = "island") -> DataFrame:
    """Number runs of consecutive positions among the rows given."""
    w = Window.partitionBy(*groups).orderBy(position)
    return df.withColumn(out, F.col(position) - F.row_number().over(w))


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], strict: bool = False) -> DataFrame:
    """For each left row, ``values`` of the latest right row at or before
    ``left_at`` (before it, if ``strict``); null if there is none. A union and a
    running last value: one shuffle by the keys, no inequality join. Of right
    rows at the same place the largest values count."""
    picked = F.struct(F.col(right_at).alias("_r"), *[F.col(v) for v in values])
    sides = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_at", F.col(left_at)).withColumn("_own", F.lit(True)).unionByName(
        right.select(*keys, F.col(right_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), picked.alias("_pick")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_pick").rowsBetween(Window.unboundedPreceding, 0)
    seen = sides.withColumn("_last", F.last("_pick", ignorenulls=True).over(w)).where("_own")
    return seen.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def overlap_sweep(findings: DataFrame, key: str = "source_id") -> DataFrame:
    """Make findings (key, start, stop, priority, ...) disjoint: in order of
    start, then higher priority, then longer, each is dropped if what came
    before covers it, else clipped to begin where that ends. Adds ``cursor``."""
    w = Window.partitionBy(key).orderBy(F.asc("start"), F.desc("priority"), F.desc("stop"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    swept = findings.withColumn("cursor", F.coalesce(F.max("stop").over(before), F.lit(0)))
    return swept.where("stop > cursor").withColumn("start", F.greatest("start", "cursor"))


def gaps(regions: DataFrame, sizes: DataFrame, key: str = "source_id") -> DataFrame:
    """What disjoint regions leave of each source [0, size): (key, start, stop)."""
    w = Window.partitionBy(key).orderBy("start")
    between = regions.select(key, F.coalesce(F.lag("stop").over(w), F.lit(0)).alias("a"), F.col("start").alias("b"))
    ends = regions.groupBy(key).agg(F.max("stop").alias("a"))
    tail = sizes.join(ends, key, "left").select(key, F.coalesce("a", F.lit(0)).alias("a"), F.col("size").alias("b"))
    return between.unionByName(tail).where("a < b").select(key, F.col("a").alias("start"), F.col("b").alias("stop"))


def capped(df: DataFrame, groups: list[str], order: list[Column], cap: int, total: str = "total") -> DataFrame:
    """The first ``cap`` rows of each group, with the group's exact count and
    whether the list was cut: counted over everything, capped afterwards."""
    whole, ranked = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn(total, F.count(F.lit(1)).over(whole)).withColumn("_rn", F.row_number().over(ranked))
        .where(F.col("_rn") <= cap).withColumn(f"{total}_truncated", F.col(total) > cap).drop("_rn")
    )
