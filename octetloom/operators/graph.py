"""Graphs of calls and references, facts about them, and questions to both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import windows as W

#: Sites kept in a list of references, beside their exact number.
SITE_CAP = 32


def call_edges(calls: DataFrame) -> DataFrame:
    """Calls (caller, callee), one row a site, as edges with their number."""
    return calls.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("calls"))


def call_nodes(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Every function with the number of distinct callers and callees, 0 if none."""
    out = edges.groupBy(F.col("caller").alias("function")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("callee").alias("function")).agg(F.count(F.lit(1)).alias("in_degree"))
    joined = functions.select("function").join(into, "function", "left").join(out, "function", "left")
    return joined.select("function", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))


def coverage(instructions: DataFrame, calls: DataFrame, total_bytes: int | None = None) -> DataFrame:
    """One row: instructions, decoded bytes, percent of ``total_bytes`` (0 if
    that is 0), distinct (site, callee) calls and distinct sites."""
    own = instructions.agg(F.count(F.lit(1)).alias("instructions"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("decoded_bytes"), F.coalesce(F.max("total"), F.lit(0)).cast("long").alias("total_bytes"))
    pairs = calls.groupBy("site", "callee").count()
    seen = pairs.agg(F.count(F.lit(1)).alias("calls"))
    sites = calls.agg(F.count_distinct("site").alias("call_sites"))
    if total_bytes is not None:
        own = own.withColumn("total_bytes", F.lit(total_bytes).cast("long"))
    rows = own.unionByName(seen, allowMissingColumns=True).unionByName(sites, allowMissingColumns=True)
    names = ["instructions", "decoded_bytes", "total_bytes", "calls", "call_sites"]
    total = F.col("total_bytes")
    percent = F.when(total == 0, F.lit(0.0)).otherwise(F.col("decoded_bytes") / total * 100)
    return rows.agg(*[F.max(n).alias(n) for n in names]).withColumn("percent", percent)


def callers(calls: DataFrame, address) -> DataFrame:
    return calls.where(F.col("callee") == address)


def callees(calls: DataFrame, address) -> DataFrame:
    return calls.where(F.col("caller") == address)


def references_to(references: DataFrame, address, cap: int = 200) -> DataFrame:
    """The first ``cap`` references (target, site, kind) to an address, by site
    and kind, with their exact number: filtered, counted, then cut."""
    hits = references.where(F.col("target") == address)
    return W.capped(hits, ["target"], [F.asc("site"), F.asc("kind")], cap)


def reverse_references(references: DataFrame, cap: int = SITE_CAP) -> DataFrame:
    """Each target's first ``cap`` distinct sites (null last) and their exact
    number. Rows are dealt once, by target, to as many tasks as the tables need;
    equal sites have equal ranks in a sorted run, so no task has a table of all
    pairs. The cut comes before the list is gathered, so no list outgrows the cap."""
    dealt = references.select("target", "site").repartition(tables.tasks_for(references), "target")
    w = Window.partitionBy("target").orderBy(F.asc_nulls_last("site"))
    ranked = dealt.withColumn("_rank", F.dense_rank().over(w)).withColumn("_rn", F.row_number().over(w))
    first = (F.col("_rn") == 1) | ~F.lag("site").over(w).eqNullSafe(F.col("site"))
    counted = ranked.withColumn("_first", first).withColumn("site_total", F.max("_rank").over(Window.partitionBy("target")).cast("long"))
    cut = counted.where(F.col("_first") & (F.col("_rank") <= cap))
    return cut.groupBy("target").agg(F.sort_array(F.collect_list("site")).alias("sites"), F.max("site_total").alias("site_total"))


def select_facts(facts: DataFrame, selection: Column, categories: Column, confidence: Column) -> DataFrame:
    """Facts with the first test they fail (selection, category, confidence),
    null for those that pass. Tests that are null count as failed."""
    fails = lambda test: ~F.coalesce(test, F.lit(False))
    return facts.withColumn("excluded_by", F.when(fails(selection), "selection").when(fails(categories), "category").when(fails(confidence), "confidence"))


def exclusion_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy(F.coalesce("excluded_by", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("facts"))


#: Strength of a confidence, certain first; not its sort order.
STRENGTH = {"certain": 4, "user": 4, "inferred": 3, "probable": 2, "observed": 1}


def strength(confidence: Column) -> Column:
    return F.coalesce(*[F.when(confidence == k, F.lit(v)) for k, v in STRENGTH.items()], F.lit(0))


def function_summaries(facts: DataFrame) -> DataFrame:
    """Facts (owner, kind, target, certain) folded by owner: number of facts and
    calls, distinct callees, sorted kinds, and whether the owner is a leaf: no
    if it calls, unknown (null) if some fact is uncertain, else yes."""
    per = facts.groupBy("owner").agg(
        F.count(F.lit(1)).alias("facts"), F.count(F.when(F.col("kind") == "call", 1)).alias("calls"),
        F.count_distinct(F.when(F.col("kind") == "call", F.col("target"))).alias("callees"),
        F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.bool_and("certain").alias("_certain"),
    )
    leaf = F.when(F.col("calls") > 0, F.lit(False)).when(F.col("_certain"), F.lit(True))
    return per.withColumn("leaf", leaf).drop("_certain")


def resolution(arguments: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Arguments (group, resolved, reason) counted by group: percent resolved (0
    of nothing) and the most frequent reason of the others, ties to the earlier
    in ``order``."""
    totals = arguments.groupBy(group).agg(F.count(F.lit(1)).alias("arguments"), F.count(F.when(F.col("resolved"), 1)).alias("resolved"))
    rank = F.coalesce(*[F.when(F.col("reason") == r, F.lit(i)) for i, r in enumerate(order)], F.lit(len(order)))
    reasons = arguments.where("NOT resolved AND reason IS NOT NULL").groupBy(group, "reason").agg(F.count(F.lit(1)).alias("n"))
    first = reasons.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), rank, "reason"))).where("_rn = 1")
    percent = F.when(F.col("arguments") == 0, F.lit(0.0)).otherwise(F.col("resolved") / F.col("arguments") * 100)
    return totals.withColumn("percent", percent).join(first.select(group, F.col("reason").alias("dominant_reason"), F.col("n").alias("dominant_count")), group, "left")


def covering(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """For points (key, at), the span (start, stop, id) of the key's disjoint
    spans that holds each, null outside: the span begun last, if it has not
    ended. One shuffle, no inequality join."""
    found = W.asof(points, spans, [key], "at", "start", ["start", "stop", "id"])
    inside = F.col("at") < F.col("stop")
    return found.select(*points.columns, F.when(inside, F.col("id")).alias("id"), F.when(inside, F.col("start")).alias("start"))


def region_ends(starts: DataFrame, key: str, size: Column) -> DataFrame:
    """Where each region (key, start) ends: at the next start, or at ``size``."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return starts.withColumn("stop", F.coalesce(following, size))


def backward_slice(uses: DataFrame, seed: list, depth: int) -> DataFrame:
    """What reaches ``seed`` against (used_by, defined_by) edges in up to
    ``depth`` steps: (node, depth), each node once, at its least depth. Nodes
    reached are joined with the edges level by level, and only the newest ones. The plan
    grows with ``depth``: keep it to some tens."""
    spark = uses.sparkSession
    kind = dict(uses.dtypes)["used_by"]
    edges = uses.select("used_by", "defined_by").distinct().persist()
    found = spark.createDataFrame([(s, 0) for s in seed], f"node {kind}, depth int")
    frontier = found
    for level in range(1, depth + 1):
        reached = frontier.join(edges, frontier.node == edges.used_by).select(F.col("defined_by").alias("node")).distinct()
        frontier = reached.join(found.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth")).persist()
        found = found.unionByName(frontier)
    return found
