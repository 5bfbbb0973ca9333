"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunking, lm, mixing, oracles, packing, quality, secrets, sharding, simhash, topk, toxicity
from .common import table


def _fold(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _fold(3) == 1
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: Target weights of the mixing query; sources not named weigh 1.
MIX_WEIGHTS = {"src0": 4, "src1": 3, "src2": 2, "src3": 2}


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS).select("doc_id", "source", "mix_slot", "mix_position")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fingerprints(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(spans, s -> s.rank = {i})) AS bigint) AS n_{k}" for i, k in enumerate(secrets.KINDS)],
        f"sha2({secrets.span_list('spans', True)}, 256) AS base_sha256",
        f"{secrets.span_list('spans')} AS spans",
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), _fold(7) == 2)


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: shard counts are at most one apart."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _fold(5) == 0
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pack": op2_pack,
    "op3_mix": op3_mix,
    "op4_fingerprint": op4_fingerprint,
    "op5_secrets": op5_secrets,
    "op6_lm": op6_lm,
    "op7_shard": op7_shard,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_topk": op10_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mix": oracles.mixing_sql(MIX_WEIGHTS),
    "op5_secrets": oracles.secrets_sql(),
    "op10_topk": oracles.TOP_K,
}
