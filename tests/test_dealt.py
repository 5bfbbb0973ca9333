"""References are dealt to more tasks as the tables grow, with the same rows."""

from octetloom.functions import tables
from octetloom.operators import graph
from octetloom.plans.queries import QUERIES


def test_tasks_grow_with_the_tables(spark, sf_dir, monkeypatch):
    """Pairs of all targets were in one task's table, whatever the size."""
    name = "reverse_refs_capped"
    few = sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(tables, "TASK_BYTES", 30_000)
    df = QUERIES[name](spark, sf_dir)
    n = tables.tasks_for(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert n > spark.sparkContext.defaultParallelism and plan.count(f", {n})") >= 2
    assert sorted(map(tuple, df.collect())) == few


def test_repeated_and_null_sites(spark):
    refs = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), ("a", None), ("a", None), ("a", 2), ("b", None), (None, 5), (None, 5)], "target string, site long")
    got = {r[0]: (r[1], r[2]) for r in graph.reverse_references(refs, 2).collect()}
    assert got == {"a": ([1, 2], 4), "b": ([], 1), None: ([5], 1)}
