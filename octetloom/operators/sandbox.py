"""Sweeps of cases under one budget, and ordered folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(cases: DataFrame, order: str, steps: Column, per_case: int, budget: int, sweep: str = "sweep") -> DataFrame:
    """Which cases of a sweep run: case i does if the steps that those before
    it took leave room for a whole ``per_case``. Refused cases (null steps) cost
    nothing and stop nothing. Adds ``spent`` (before the case) and ``runs``."""
    before = Window.partitionBy(sweep).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.coalesce(steps, F.lit(0))).over(before), F.lit(0)).cast("long")
    return cases.withColumn("spent", spent).withColumn("runs", F.col("spent") + per_case <= budget)


def timeline(steps: DataFrame, key: str, order: list[str], fold: Callable, schema: str) -> DataFrame:
    """A fold over each key's steps in order, by ``fold(pandas) -> pandas``."""
    return steps.groupBy(key).applyInPandas(lambda rows: fold(rows.sort_values(order, kind="stable")), schema)
