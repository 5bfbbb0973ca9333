"""Rasters as pixel tables (image, x, y, index), and planar bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import cut
from ..functions.windows import islands


def planar_to_chunky(planes: list[Column], bit: Column) -> Column:
    """Pixel index from one bit of each plane's byte, most significant first."""
    out = F.lit(0).cast("long")
    for p, plane in enumerate(planes):
        out = out + F.shiftleft(F.getbit(plane.cast("long"), (F.lit(7) - bit).cast("int")).cast("long"), p)
    return out


def decode_planar(sources: DataFrame, width: int, height: int, planes: int, offset: int = 0, interleaved: bool = False) -> DataFrame:
    """Pixels of planar bitmaps: (source_id, width, height, pixels), pixels one
    byte each. Rows are byte aligned; planes follow each other, or, interleaved,
    alternate row by row. A source too short gives null pixels."""
    row = (width + 7) // 8

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, content in zip(b["source_id"], b["content"]):
                data = np.frombuffer(content or b"", dtype=np.uint8)[offset : offset + row * height * planes]
                pixels = None
                if len(data) == row * height * planes:
                    shape = (height, planes, row) if interleaved else (planes, height, row)
                    grid = data.reshape(shape).transpose(1, 0, 2) if interleaved else data.reshape(shape)
                    bits = np.unpackbits(grid, axis=2)[:, :, :width]
                    pixels = (bits << np.arange(planes, dtype=np.uint8)[:, None, None]).sum(axis=0, dtype=np.uint8).tobytes()
                out.append((key, width, height, pixels))
            yield pd.DataFrame(out, columns=["source_id", "width", "height", "pixels"])

    kind = dict(sources.dtypes)["source_id"]
    return sources.select("source_id", "content").mapInPandas(scan, f"source_id {kind}, width int, height int, pixels binary")


def pixel_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels (x, y) whose index is not the same; one outside a side's image has
    no index there: (x, y, a, b)."""
    left, right = a.select("x", "y", F.col("index").alias("a")), b.select("x", "y", F.col("index").alias("b"))
    return left.join(right, ["x", "y"], "full_outer").where("NOT (a <=> b)")


def substitutions(differences: DataFrame) -> DataFrame:
    """How often each index became another; outside counts as index 0."""
    pair = [F.coalesce(c, F.lit(0)).alias(n) for c, n in (("a", "from_index"), ("b", "to_index"))]
    return differences.groupBy(*pair).agg(F.count(F.lit(1)).alias("pixels"))


def bounds(differences: DataFrame) -> DataFrame:
    return differences.agg(
        F.count(F.lit(1)).alias("pixels"), F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom")
    )


def connected_regions(points: DataFrame) -> DataFrame:
    """4-connected regions of points (x, y): (region, pixels, left, top, right,
    bottom), region being the number of its first run in reading order.

    Runs of a row are found first; runs of neighbouring rows that overlap are
    linked, and links contract to stars, in rounds that grow with the logarithm
    of a region's runs. Runs are far fewer than points, and their links at most
    twice as many. Each round is checkpointed.
    """
    runs = islands(points.select("x", "y").distinct(), ["y"], "x").groupBy("y", "island").agg(F.min("x").alias("a"), F.max("x").alias("z"), F.count(F.lit(1)).alias("n"))
    runs = cut(runs.withColumn("run", F.col("y").cast("long") * (1 << 31) + F.col("a")).drop("island"))
    # Overlap of x in neighbouring rows, met on the row: buckets of 64 columns keep it an equi-join.
    split = runs.withColumn("bucket", F.explode(F.sequence(F.expr("a div 64"), F.expr("z div 64"))))
    below = split.select((F.col("y") - 1).alias("y"), "bucket", F.col("a").alias("a2"), F.col("z").alias("z2"), F.col("run").alias("q"))
    links = split.join(below, ["y", "bucket"]).where("a <= z2 AND a2 <= z").select(F.col("run").alias("p"), "q").distinct()
    roots = _roots(links)
    label = runs.join(roots, "run", "left").withColumn("region", F.coalesce("root", "run"))
    return label.groupBy("region").agg(
        F.sum("n").alias("pixels"), F.min("a").alias("left"), F.min("y").alias("top"), F.max("z").alias("right"), F.max("y").alias("bottom")
    )


def _roots(links: DataFrame) -> DataFrame:
    """(run, root) of linked runs (p < q): root is the least that links reach.

    Two kinds of steps take turns: every run hands its larger neighbours, then
    its smaller ones and itself, to the least of its neighbourhood. That ends
    in stars around the roots, which are unchanged by both.
    """
    links, before = cut(links), None
    while True:
        for larger in (True, False):
            back = links.select(F.col("q").alias("p"), F.col("p").alias("q"))
            near = links.unionByName(back) if larger else back
            least = near.groupBy("p").agg(F.min("q").alias("m")).select("p", F.least("p", "m").alias("m"))
            out = near.join(least, "p").where("q > p" if larger else "q > m").select(F.col("m").alias("p"), "q")
            if not larger:
                out = out.unionByName(least.where("p > m").select(F.col("m").alias("p"), F.col("p").alias("q")))
            links = cut(out.where("p < q").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("p", "q").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("q").alias("run"), F.col("p").alias("root"))
        before = now


def follows(df: DataFrame, key: str, order: str, columns: list[str], distance: int = 1) -> DataFrame:
    """The row ``distance`` later in each key, as columns next_<c>."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select("*", *[F.lead(c, distance).over(w).alias(f"next_{c}") for c in columns])
