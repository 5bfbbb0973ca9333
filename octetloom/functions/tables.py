"""Cutting lineage in iterative operators, and dealing rows out by size."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the folder that executors share (the session's
    ``spark.checkpoint.dir``; a local one only in local mode, where it is unset)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(path)
    return df.checkpoint()


#: Bytes of files that a task is dealt.
TASK_BYTES = 16 << 20


def tasks_for(*frames: DataFrame) -> int:
    """How many tasks the files that ``frames`` read make, one a core at least,
    so that a task's rows do not grow with the tables."""
    size = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size += sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    least = frames[0].sparkSession.sparkContext.defaultParallelism
    return max(least, min(math.ceil(size / TASK_BYTES), 20_000))
