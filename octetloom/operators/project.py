"""Provenance manifests, inventories and checks of metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(sources: DataFrame) -> DataFrame:
    """Name, size and SHA-256 of each source: (source_id, size, sha256)."""
    return sources.select("source_id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def tree_hash(entries: DataFrame, group: str | None = None) -> DataFrame:
    """A directory's digest over its entries (path, size, sha256) in order of
    path: (files, bytes, tree_sha256). One line an entry, so a directory with
    very many files gathers that many lines in one task."""
    line = F.concat_ws("\t", "path", F.col("size").cast("string"), "sha256")
    keys = [group] if group else []
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda e: e["line"]), "\n"), 256).alias("tree_sha256"),
    )


def dangling(documents: DataFrame, reference: str, targets: DataFrame, target: str, code: str) -> DataFrame:
    """References that name nothing: (code, reference, documents)."""
    known = targets.select(F.col(target).alias(reference)).distinct()
    lost = documents.where(F.col(reference).isNotNull()).join(known, reference, "left_anti")
    return lost.groupBy(reference).agg(F.count(F.lit(1)).alias("documents")).select(F.lit(code).alias("code"), F.col(reference).cast("string").alias("reference"), "documents")


def duplicates(documents: DataFrame, identity: str, code: str) -> DataFrame:
    """Identities given more than once: (code, reference, documents)."""
    again = documents.groupBy(identity).agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")
    return again.select(F.lit(code).alias("code"), F.col(identity).cast("string").alias("reference"), "documents")
