"""Exact top-k inner products by a Voronoi join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Most pivots; members of each cell that its summary holds; rows of a block.
MAX_PIVOTS = 64
SUMMARY_MEMBERS = 64
QUERY_BLOCK, DATA_BLOCK = 4096, 8192
#: Queries of one vector that share a part of its answer.
SHARED_BY = 32


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in doubles where no sum can leave them.
    Sums beyond a long become the nearest one."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    least, most = -(2**63), 2**63 - 1
    b = [[int(y) for y in q] for q in b]
    sums = [[min(max(sum(int(x) * y for x, y in zip(p, q)), least), most) for q in b] for p in a]
    return np.array(sums, dtype=np.int64).reshape(len(a), len(b))


def best(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best rows, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    rows, found, scores = [], [], []
    for at in range(0, len(queries), 512):
        s = products(queries[at : at + 512], data)
        if len(ids) > k:
            # The k-th best score, then all above it and the first of those equal.
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
            above = s > kth
            equal = s == kth
            take = above | equal & (equal.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True))
        else:
            take = np.ones(s.shape, dtype=bool)
        i, j = np.nonzero(take)
        rows.append(i + at)
        found.append(ids[j])
        scores.append(s[i, j])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _cells(pivots: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector (the first of equals) and the distance."""
    p, v = pivots.astype(np.float64), vectors.astype(np.float64)
    d = (v * v).sum(axis=1)[:, None] - 2 * (v @ p.T) + (p * p).sum(axis=1)[None, :]
    cell = d.argmin(axis=1)
    return cell, np.sqrt(np.maximum(((v - p[cell]) ** 2).sum(axis=1), 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """Each query's ``k`` best partners: (query_id, rank, vec_id, score).

    Components become floor(scale * x); the score is the integer inner product
    (shorter vectors count as padded with zeros); ties go to the smaller id; a
    query's own id is no partner of its. ``is_query`` is an expression over the
    input. With fewer partners, all are returned. Rows with a null id, a null
    vector, or a null or non-finite component take no part; repeated ids are one
    row each; an empty table gives an empty result; other columns are ignored.

    A query's id has m rows at most (1 if ids do not repeat), so its k partners
    are among the k + m best rows. Equal vectors are merged first: of each
    distinct vector only the k + m smallest ids can be among these, and each
    distinct query vector is solved once. Then the Voronoi join: data and queries fall into the cells of
    a few pivots; a cell's summary (its radius and the members next to its
    pivot) gives each query a score that k partners reach at least, and by
    q.x <= q.p + |q| * radius the cells that cannot reach it. Data goes only to
    the groups of queries that need its cell, in blocks, and is solved there.
    The driver gets the pivots and summaries (MAX_PIVOTS * SUMMARY_MEMBERS
    vectors at most), never a group.
    """
    spark = vectors.sparkSession
    finite = f"`{key}` IS NOT NULL AND `{value}` IS NOT NULL AND NOT exists(`{value}`, x -> x IS NULL OR isnan(x) OR abs(cast(x AS double)) = double('infinity'))"
    rows = vectors.where(finite).select(
        F.col(key).cast("long").alias("id"), F.expr(f"transform(`{value}`, x -> cast(floor({int(scale)} * cast(x AS double)) AS bigint))").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    )
    asked = rows.where("query").select("id", "v")
    # A query's own rows are dropped from the best ones, so as many more are kept.
    own = rows.join(asked.select("id").distinct(), "id", "left_semi").groupBy("id").count().agg(F.max("count")).first()[0]
    keep = k + (own or 1)
    first = Window.partitionBy("v").orderBy("id")
    data = rows.select("id", "v").withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep).drop("n")
    distinct = materialize(asked.groupBy("v").agg(F.min("id").alias("qid"), F.expr(f"cast(count(*) div {SHARED_BY} + 1 AS int)").alias("parts")), "queries")
    members = asked.join(distinct, "v").select("id", "qid", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).distinct()

    data = materialize(data, "vectors")
    n, width = data.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    count = distinct.count()
    if not n or not count:
        return spark.createDataFrame([], empty)
    some = data.orderBy(F.xxhash64("v"), "id").limit(min(MAX_PIVOTS, max(1, n // 128))).collect()
    pivots = np.unique(_matrix(pd.Series([r["v"] for r in some]), width), axis=0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, far = _cells(pivots, _matrix(b["v"], width))
            yield b.assign(cell=cell.astype(np.int32), far=far)

    data = materialize(data.mapInPandas(assign, "id long, v array<bigint>, cell int, far double"), "cells")
    radius = np.zeros(len(pivots))
    for r in data.groupBy("cell").agg(F.max("far").alias("far")).collect():
        radius[r["cell"]] = r["far"]
    near = data.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("far", "id"))).where(F.col("n") <= SUMMARY_MEMBERS)
    sample = _matrix(pd.Series([r["v"] for r in near.select("v").collect()]), width)

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The query's home cell, and which cells may hold one of its k best."""
        for b in batches:
            q = _matrix(b["v"], width)
            home, _ = _cells(pivots, q)
            s = products(q, sample)
            # All but k of them may be the query's own rows.
            least = -np.partition(-s, keep - 1, axis=1)[:, keep - 1] if s.shape[1] >= keep else np.full(len(q), -np.inf)
            most = products(q, pivots) + np.linalg.norm(q.astype(np.float64), axis=1)[:, None] * radius[None, :]
            need = most * (1 + 1e-9) + 1e-6 >= least[:, None]
            yield pd.DataFrame({"qid": b["qid"], "qv": b["v"], "home": home.astype(np.int32), "need": [np.flatnonzero(x).astype(np.int32) for x in need]})

    queries = materialize(distinct.mapInPandas(bounds, "qid long, qv array<bigint>, home int, need array<int>"), "bounds")
    # Groups of queries: neighbouring cells together, large cells in parts.
    groups: list[tuple[int, int, int]] = []
    group, filled = 0, 0
    for r in sorted(queries.groupBy("home").count().collect()):
        parts = -(-r["count"] // QUERY_BLOCK)
        if filled and filled + r["count"] > QUERY_BLOCK:
            group, filled = group + 1, 0
        groups.append((r["home"], group, parts))
        filled += r["count"]
        if parts > 1:
            group, filled = group + parts, 0
    of_home = F.broadcast(spark.createDataFrame(groups, "home int, first int, parts int"))  # a row a pivot
    grouped = queries.join(of_home, "home").withColumn("grp", (F.col("first") + F.pmod(F.xxhash64("qid"), F.col("parts"))).cast("int"))
    blocks = -(-n // DATA_BLOCK)
    # A row a pivot and query group at most.
    wanted = grouped.select(F.col("grp").alias("grp"), F.explode("need").alias("cell")).distinct()
    replicas = data.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).join(wanted, "cell").select("grp", "block", "id", "v")
    everywhere = grouped.select("grp", "qid", "qv").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "id": [], "score": []}, dtype="int64")
        i, ids, scores = best(_matrix(left["qv"], width), _matrix(right["v"], width), right["id"].to_numpy(), keep)
        return pd.DataFrame({"qid": left["qid"].to_numpy()[i], "id": ids, "score": scores})

    local = everywhere.groupBy("grp", "block").cogroup(replicas.groupBy("grp", "block")).applyInPandas(solve, "qid long, id long, score long")
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    solved = materialize(local.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= keep).drop("n"), "solved")
    # A vector that many queries ask for is handed to them in parts.
    shares = solved.join(distinct.select("qid", "parts"), "qid").select("qid", "id", "score", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = members.withColumnRenamed("id", "query_id").join(shares, ["qid", "part"]).where("query_id <> id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
