"""Profiles and comparisons of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _unpivoted(table: DataFrame, columns: list[str], keep: list[Column]) -> DataFrame:
    """One row a (row, column): a struct of the number, if it is one, and text."""
    kinds = dict(table.dtypes)

    def cell(i: int, c: str) -> Column:
        numeric = kinds[c] not in ("string", "binary", "boolean")
        text = F.hex(c) if kinds[c] == "binary" else F.col(c).cast("string")
        return F.struct(F.lit(i).alias("column"), (F.col(c).cast("double") if numeric else F.lit(None).cast("double")).alias("num"), text.alias("value"))

    cells = F.array(*[cell(i, c) for i, c in enumerate(columns)])
    return table.select(*keep, F.explode(cells).alias("_c")).select(*[k for k in table.select(*keep).columns], "_c.*")


def summarize(table: DataFrame, columns: list[str], maximum_values: int = 65536) -> DataFrame:
    """Values of each column by count, largest first, then by value: (column,
    rank, value, count, distinct_total, truncated, lowest, highest).

    ``distinct_total`` is exact and counts all values, ``lowest`` and
    ``highest`` exist for numbers only; the list stops at ``maximum_values``.
    A table without rows has no summaries. One partial aggregation by (column,
    value) goes before everything else, so that repeats never travel.
    """
    counted = _unpivoted(table, columns, []).groupBy("column", "num", "value").agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy("column")
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("num"), F.asc("value"))
    ranked = counted.select(
        "column", F.row_number().over(order).cast("long").alias("rank"), "value", "count",
        F.count(F.lit(1)).over(whole).alias("distinct_total"), F.min("num").over(whole).alias("lowest"), F.max("num").over(whole).alias("highest"),
    )
    return ranked.withColumn("truncated", F.col("distinct_total") > maximum_values).where(F.col("rank") <= maximum_values)


def compare(tables: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Rows at which the tables, aligned on row number ``key`` (from 0), do not
    all agree: (column, row, values). Rows past the shortest table are not
    compared; with fewer than two tables there is nothing to compare."""
    if len(tables) < 2:
        return tables[0].sparkSession.createDataFrame([], f"column int, {key} long, values array<string>")
    joined = tables[0].select(key, *[F.col(c).alias(f"{c}_0") for c in columns])
    for i, t in enumerate(tables[1:], 1):
        joined = joined.join(t.select(key, *[F.col(c).alias(f"{c}_{i}") for c in columns]), key)
    cells = F.array(*[
        F.struct(F.lit(n).alias("column"), F.array(*[F.col(f"{c}_{i}").cast("string") for i in range(len(tables))]).alias("values"))
        for n, c in enumerate(columns)
    ])
    differ = F.exists("c.values", lambda v: ~v.eqNullSafe(F.col("c.values")[0]))
    return joined.select(key, F.explode(cells).alias("c")).where(differ).select("c.column", key, "c.values")


def row_numbered(df: DataFrame, order: list[str], out: str = "row") -> DataFrame:
    """Rows numbered from 0 in a total order. Dealt in ranges: each range is
    numbered alone and offset by the counts of those before it, so that no
    task sorts everything."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    return _offset(ranged, order, out)


def _offset(ranged: DataFrame, order: list[str], out: str) -> DataFrame:
    kept = ranged.persist()  # partition numbers must be the same in both uses
    counts = kept.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy(*order)
    return kept.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.row_number().over(own) - 1).drop("_part", "_before")
