"""Results as files (path, content), to be written through a plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import media
from . import project


def read_window(sources: DataFrame, offset: int = 0, length: int = 256) -> DataFrame:
    """Bytes [offset, offset + length) of each source, as far as they go, with
    a hexadecimal listing of 16 bytes a line: (source_id, start, bytes, listing)."""
    piece = F.substring(F.col("content"), F.lit(offset + 1), F.lit(length))
    lines = F.transform(
        F.sequence(F.lit(0), F.greatest(F.expr("(octet_length(bytes) - 1) div 16"), F.lit(0))),
        lambda i: F.concat(F.lower(F.lpad(F.hex((i * 16 + offset).cast("long")), 8, "0")), F.lit("  "),
            F.lower(F.array_join(F.regexp_extract_all(F.hex(F.substring(F.col("bytes"), (i * 16 + 1).cast("int"), F.lit(16))), F.lit("(..)"), F.lit(1)), " "))),
    )
    rows = sources.select("source_id", F.lit(offset).cast("long").alias("start"), piece.alias("bytes"))
    return rows.withColumn("listing", F.when(F.octet_length("bytes") > 0, F.array_join(lines, "\n")).otherwise(F.lit("")))


def carve(sources: DataFrame, path: Column, offset: int, length: int) -> DataFrame:
    """One range of each source as a file; a range that leaves it is an error."""
    inside = F.octet_length("content") >= offset + length
    piece = F.substring(F.col("content"), F.lit(offset + 1), F.lit(length))
    refused = F.raise_error(F.concat(F.lit("range leaves source "), F.col("source_id").cast("string"))).cast("binary")
    return sources.select(path.alias("path"), F.when(inside, piece).otherwise(refused).alias("content"))


def _made(df: DataFrame, columns: list[str], write: Callable[..., bytes]) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [write(*row) for row in zip(*[b[c] for c in columns])]})

    return df.select("path", *columns).mapInPandas(make, "path string, content binary")


def png_files(pictures: DataFrame) -> DataFrame:
    """Pictures (path, width, height, pixels, palette) as indexed PNGs."""
    return _made(pictures, ["width", "height", "pixels", "palette"], lambda w, h, p, c: media.png(int(w), int(h), bytes(p), bytes(c)))


def wav_files(samples: DataFrame) -> DataFrame:
    """Samples (path, pcm, sample_rate) as WAV files."""
    return _made(samples, ["pcm", "sample_rate"], lambda p, r: media.wav(bytes(p), int(r)))


def swatch_files(palettes: DataFrame, block: int = 16, columns: int = 8) -> DataFrame:
    """Palettes (path, words: array of $0RGB) as PNGs of coloured squares."""

    def draw(words) -> bytes:
        words = [int(w) for w in words]
        across, down = min(columns, len(words)), -(-len(words) // columns)
        rows = []
        for y in range(down):
            line = b"".join(bytes([min(y * columns + x, len(words) - 1)]) * block for x in range(across))
            rows.append(line * block)
        colours = b"".join(bytes([(w >> s & 15) * 17 for s in (8, 4, 0)]) for w in words)
        return media.png(across * block, down * block, b"".join(rows), colours)

    return _made(palettes, ["words"], draw)


def heatmap_files(differences: DataFrame, path: Column, width: int, height: int) -> DataFrame:
    """Pixels (x, y) that differ, as a PNG of white on black. One image's pixels
    meet in one task."""
    rows = differences.where(f"x >= 0 AND y >= 0 AND x < {width} AND y < {height}").groupBy("y").agg(F.sort_array(F.collect_set("x")).alias("xs"))
    image = rows.agg(F.collect_list(F.struct("y", "xs")).alias("rows")).select(path.alias("path"), "rows")

    def draw(found) -> bytes:
        pixels = bytearray(width * height)
        for r in found:
            for x in r["xs"]:
                pixels[r["y"] * width + x] = 1
        return media.png(width, height, bytes(pixels), b"\0\0\0\xff\xff\xff")

    return _made(image, ["rows"], draw)


def manifest_file(sources: DataFrame, path: str = "manifest.json") -> DataFrame:
    """All sources' manifest as one JSON file, in order of name."""
    entry = F.struct("source_id", "size", "sha256")
    gathered = project.manifest(sources).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("json"))
    return gathered.select(F.lit(path).alias("path"), F.encode("json", "UTF-8").alias("content"))


def json_file(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """A result as one JSON Lines file, in the order given."""
    line = F.struct(*order, F.to_json(F.struct(*rows.columns)).alias("_json"))
    gathered = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["_json"]), "\n").alias("json"))
    return gathered.select(F.lit(path).alias("path"), F.encode("json", "UTF-8").alias("content"))
