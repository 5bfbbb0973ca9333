"""Formats and codecs as queries: documents are written into a format and
read back by one task, over whole tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import archives, builders, codecs, executables, media, volumes
from ..sources.table import rewritten
from .queries import _sources, query

_SIZE = "octet_length(encode(coalesce(text, '')))"


def _same(df: DataFrame) -> DataFrame:
    return df.select("source_id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


_ROUND_TRIP = f"SELECT doc_id AS source_id, {_SIZE} AS size, sha256(coalesce(text, '')) AS sha256 FROM documents"


@query(_ROUND_TRIP)
def byte_run1_round_trip(spark, sf_dir):
    return _same(rewritten(_sources(spark, sf_dir), lambda c: codecs.byte_run1(codecs.pack_byte_run1(c))))


@query(_ROUND_TRIP)
def rle_xor_decode(spark, sf_dir):
    read = lambda c: codecs.rle_xor(c, 0x65, inline_marker=True, size_bytes=4, size_includes_field=True)[0]
    return _same(rewritten(_sources(spark, sf_dir), lambda c: read(builders.pack_rle_xor(c, 0x65))))


@query(_ROUND_TRIP)
def powerpacker_decode(spark, sf_dir):
    return _same(rewritten(_sources(spark, sf_dir), lambda c: codecs.power_packed(builders.power_pack(c), (9, 10, 11, 12)) if c else c))


@query(f"""SELECT doc_id AS source_id, h.hunk, CASE WHEN h.hunk = 0 THEN 'code' ELSE 'data' END AS kind, CASE WHEN h.hunk = 0 THEN ({_SIZE} + 3) // 4 * 4 ELSE 8 END AS allocation
    FROM documents, (VALUES (0::BIGINT), (1::BIGINT)) AS h(hunk)""")
def hunk_list(spark, sf_dir):
    write = lambda c: builders.load_file([("code", c), ("data", b"12345678")])
    return executables.segments(_sources(spark, sf_dir), write).where("error IS NULL").select("source_id", "hunk", "kind", "allocation")


@query("SELECT doc_id AS source_id, 1::BIGINT AS source_hunk, 4::BIGINT AS source_offset, 0::BIGINT AS target_hunk, doc_id % 65536 AS stored_offset FROM documents")
def hunk_relocations(spark, sf_dir):
    ids = _sources(spark, sf_dir).select("source_id", F.unhex(F.lpad(F.hex(F.col("source_id") % 65536), 8, "0")).alias("content"))
    write = lambda c: builders.load_file([("code", b"\x4e\x75"), ("data", b"head" + c)], {1: [(0, [4])]})
    return executables.relocations(ids, write).where("error IS NULL").drop("error")


@query(f"SELECT doc_id AS source_id, 'texts/document' AS path, '-lh0-' AS method, {_SIZE} AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def lha_extract(spark, sf_dir):
    write = lambda c: builders.archive([("texts/document", c)])
    return archives.contents(_sources(spark, sf_dir), write).where("error IS NULL").select("source_id", "path", "method", "size", F.sha2("content", 256).alias("sha256"))


@query(f"SELECT doc_id AS source_id, p.path, 'file' AS kind, CASE WHEN p.path = 'document' THEN {_SIZE} ELSE 0 END AS size FROM documents, (VALUES ('document'), ('empty')) AS p(path)")
def adf_list(spark, sf_dir):
    write = lambda c: builders.volume([("document", c), ("empty", b"")])
    return volumes.listing(_sources(spark, sf_dir), write).where("error IS NULL").select("source_id", "path", "kind", "size")


@query(_ROUND_TRIP)
def adf_extract(spark, sf_dir):
    write = lambda c: builders.volume([("document", c)])
    return _same(volumes.contents(_sources(spark, sf_dir), write).where("error IS NULL"))


@query("SELECT doc_id AS source_id, 'DOS' AS magic, 0::INTEGER AS flags, true AS checksum_ok FROM documents")
def boot_info(spark, sf_dir):
    write = lambda c: builders.volume([("document", c)])
    return volumes.boots(_sources(spark, sf_dir), write).where("error IS NULL").select("source_id", "magic", "flags", "checksum_ok")


@query(f"SELECT doc_id AS source_id, 'text' AS name, 11025::INTEGER AS sample_rate, {_SIZE} AS one_shot, sha256(coalesce(text, '')) AS sha256 FROM documents")
def sample_decode(spark, sf_dir):
    write = lambda c: builders.sample("text", 11025, c)
    return media.samples(_sources(spark, sf_dir), write).where("error IS NULL").select("source_id", "name", "sample_rate", "one_shot", F.sha2("pcm", 256).alias("sha256"))


@query(f"SELECT doc_id AS source_id, 44 + {_SIZE} + {_SIZE} % 2 AS size FROM documents")
def wav_export(spark, sf_dir):
    return _same(rewritten(_sources(spark, sf_dir), lambda c: media.wav(c, 8000))).select("source_id", "size")


@query(f"SELECT doc_id AS source_id, 16::INTEGER AS width, ({_SIZE} // 16)::INTEGER AS height, 8::INTEGER AS planes, sha256(encode(coalesce(text, ''))[1:{_SIZE} // 16 * 16]) AS sha256 FROM documents WHERE {_SIZE} >= 16")
def ilbm_decode(spark, sf_dir):
    """Bytes as pixels of 8 planes, 16 to a row; a last part of a row is left out."""
    fit = _sources(spark, sf_dir).where(F.octet_length("content") >= 16)
    write = lambda c: builders.picture(16, len(c) // 16, 8, c[: len(c) // 16 * 16], bytes(768))
    return media.pictures(fit, write).where("error IS NULL").select("source_id", "width", "height", "planes", F.sha2("pixels", 256).alias("sha256"))
