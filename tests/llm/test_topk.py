import math

import numpy as np
from pyspark.sql import functions as F

from octetloom.llm import topk
from octetloom.llm.queries import op10_topk


def brute(rows, k=20, every=20):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in fine:
        if q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert result(op10_topk(spark, sf_dir)) == brute(rows)


def test_clusters_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "DATA_BLOCK", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5)) * 5
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * 0.05).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.5, 0.25, -1.0, 2.0]) for i in range(200)]  # one vector, many times
    rows += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 5), (2060, [float("inf")] + [0.0] * 4), (None, [1.0] * 5), (2080, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(topk.top_k(df, F.col("vec_id") % 20 == 0)) == brute(rows)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, rank int, score string"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(20, [1.0, 2.0], 1, "x"), (21, [1.0, 1.0], 1, "x"), (40, [0.0, 1.0], 1, "x")], schema)
    assert result(topk.top_k(few, F.col("vec_id") % 20 == 0)) == brute([(20, [1.0, 2.0]), (21, [1.0, 1.0]), (40, [0.0, 1.0])])
    assert topk.top_k(few.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_stay_exact():
    a = np.array([[2**40, 3]], dtype=np.int64)
    b = np.array([[2**20, 5], [1, 1]], dtype=np.int64)
    assert topk.products(a, b).tolist() == [[2**60 + 15, 2**40 + 3]]


def test_repeated_query_rows_cost_no_partners(spark):
    rng = np.random.default_rng(8)
    rows = [(20, [9.0, 9.0, 9.0])] * 25 + [(40, [8.0, 8.0, 8.0])] * 2 + [(i, rng.normal(size=3).tolist()) for i in range(100, 400) if i % 20]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    want = {}
    for q in (20, 40):
        a = [math.floor(64 * x) for x in dict(rows)[q]]
        scored = sorted((-sum(x * math.floor(64 * y) for x, y in zip(a, v)), i) for i, v in rows if i != q)[:20]
        want[q] = [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    for q in (20, 40):
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == want[q]


def test_large_components_do_not_overflow(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, -1e15]), (2, [-1e15, 2.0]), (3, [1e30, 0.0]), (4, [0.5, 4.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    large = 64 * 10**15
    scores = {r["vec_id"]: r["score"] for r in got}
    assert scores == {1: 2**63 - 1, 2: -(2**63), 3: 2**63 - 1, 4: 32 * large + 64 * 256}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 3, 4, 2]
