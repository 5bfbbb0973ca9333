"""Comparisons: byte ranges, key sets, states, records and traces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_ranges(pairs: DataFrame) -> DataFrame:
    """Ranges in which two byte strings (columns a, b) differ: (pair_id, start,
    length). Bytes past the shorter one's end count as different, so a tail
    joins a run that touches it."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, a, b in zip(rows["pair_id"], rows["a"], rows["b"]):
                x, y = np.frombuffer(a or b"", dtype=np.uint8), np.frombuffer(b or b"", dtype=np.uint8)
                n = min(len(x), len(y))
                differ = np.ones(max(len(x), len(y)), dtype=np.int8)
                differ[:n] = x[:n] != y[:n]
                edge = np.diff(differ, prepend=0, append=0)
                out += [(key, int(s), int(e - s)) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
            yield pd.DataFrame(out, columns=["pair_id", "start", "length"])

    kind = dict(pairs.dtypes)["pair_id"]
    return pairs.select("pair_id", "a", "b").mapInPandas(scan, f"pair_id {kind}, start long, length long")


def presence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key with the side it is on: both, only_a, only_b."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_a").otherwise("only_b")
    return left.join(right, key, "full_outer").select(key, side.alias("side"))


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose keys ``b`` has not, repeats kept."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def state_differences(snapshots: DataFrame, inputs: int) -> DataFrame:
    """Paths whose values are not the same in all snapshots (snapshot, path,
    value): (path, present, distinct_values). A path missing from one is a
    difference; so is a null beside a value."""
    per = snapshots.groupBy("path").agg(
        F.count_distinct("snapshot").cast("long").alias("present"),
        F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col("value").cast("string")), F.lit("-"))).cast("long").alias("distinct_values"),
    )
    return per.where((F.col("present") < inputs) | (F.col("distinct_values") > 1))


def record_differences(records: DataFrame, fields: list[str], group: str | None = None) -> DataFrame:
    """Fields in which records differ, by group: (group, field, distinct_values)."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    keys = [group] if group else []
    flat = records.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.field", "c.value")
    return flat.groupBy(*keys, "field").agg(F.count_distinct("value").alias("distinct_values")).where("distinct_values > 1")


def occurrences(trace: DataFrame, record: str, step: str, address: str, out: str = "occurrence") -> DataFrame:
    """How many times the address has come up so far in its record, from 1."""
    return trace.withColumn(out, F.row_number().over(Window.partitionBy(record, address).orderBy(step)))


def first_divergence(trace: DataFrame, record: str, step: str, address: str, a, b) -> DataFrame:
    """Where two records' traces first differ: one row (step, a, b,
    occurrence_a, occurrence_b), none if they agree throughout. The trace that
    ends sooner differs where it ends; a record without a trace differs at 0."""
    marked = occurrences(trace.where(F.col(record).isin([a, b])), record, step, address)
    side = lambda key, name: marked.where(F.col(record) == key).select(
        step, F.col(address).alias(name), F.col("occurrence").cast("long").alias(f"occurrence_{name}")
    )
    both = side(a, "a").join(side(b, "b"), step, "full_outer")
    return both.where("NOT (a <=> b)").orderBy(step).limit(1)
