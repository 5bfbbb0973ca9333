"""Scans of byte sources. ``content`` columns are binary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import windows as W
from ..sources import media
from ..sources.table import parse

#: Entropy, in bits a byte, from which a block looks packed, and up to which sparse.
PACKED_BITS, SPARSE_BITS = 7.5, 2.0
MERGE_GAP = 8


def strings_scan(sources: DataFrame, minimum: int = 4, contains: str | None = None, cap: int | None = None) -> DataFrame:
    """Printable runs of at least ``minimum`` bytes: one row a run, (source_id,
    start, stop, text, string_total, string_truncated). ``contains`` filters
    before ``cap`` cuts; the total counts all that pass the filter."""
    spans = B.pattern_spans(F.col("content"), B.PRINTABLE + "{%d,}" % max(minimum, 1))
    if contains is not None:
        spans = F.filter(spans, lambda s: F.contains(s["text"], F.lit(contains)))
    rows = sources.select("source_id", spans.alias("spans")).withColumn("string_total", F.size("spans").cast("long"))
    kept = F.col("spans") if cap is None else F.slice("spans", 1, cap)
    rows = rows.withColumn("string_truncated", F.col("string_total") > (cap if cap is not None else F.col("string_total")))
    return rows.select("source_id", "string_total", "string_truncated", F.explode(kept).alias("s")).select(
        "source_id", "s.start", "s.stop", "s.text", "string_total", "string_truncated"
    )


def merged_strings(sources: DataFrame, minimum: int = 6, gap: int = MERGE_GAP) -> DataFrame:
    """Printable runs, neighbours up to ``gap`` bytes apart made one: (source_id,
    start, stop, strings)."""
    spans = B.pattern_spans(F.col("content"), B.PRINTABLE + "{%d,}" % minimum)

    def step(acc, s):
        near = (F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["stop"] + gap)
        grown = F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), s["stop"].alias("stop"), (F.try_element_at(acc, F.lit(-1))["strings"] + 1).alias("strings"))
        fresh = F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(1).cast("long").alias("strings"))
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    zero = F.expr("cast(array() AS array<struct<start: bigint, stop: bigint, strings: bigint>>)")
    return sources.select("source_id", F.explode(F.aggregate(spans, zero, step)).alias("m")).select("source_id", "m.*")


#: Blocks of a source that are counted together.
BLOCKS = 1024


def entropy_map(sources: DataFrame, block: int = 256) -> DataFrame:
    """Entropy of fixed blocks with a class: (source_id, block, size, entropy, kind)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out() -> pd.DataFrame:
            keys = [k for k, part in found for _ in part[0]]
            return pd.DataFrame({"source_id": keys, **{c: np.concatenate(x) for c, x in zip(("block", "size", "entropy"), zip(*(part for _, part in found)))}})

        for b in batches:
            found = []
            for key, content in zip(b["source_id"], b["content"]):
                data = np.frombuffer(content or b"", dtype=np.uint8)
                for at in range(0, len(data), block * BLOCKS):
                    part = data[at : at + block * BLOCKS].astype(np.int64)
                    own = np.arange(len(part)) // block
                    size = np.bincount(own)
                    count = np.bincount(own * 256 + part, minlength=len(size) * 256).reshape(-1, 256)
                    some = count[count > 1]
                    sums = np.bincount(np.nonzero(count > 1)[0], some * np.log2(some), minlength=len(size))
                    found.append((key, (at // block + np.arange(len(size)), size, np.log2(size) - sums / size)))
                    if len(found) >= BLOCKS:
                        yield out()
                        found = []
            if found:
                yield out()

    kept = dict(sources.dtypes)["source_id"]
    scored = sources.select("source_id", "content").mapInPandas(scan, f"source_id {kept}, block long, size long, entropy double")
    kind = F.when(F.col("entropy") >= PACKED_BITS, "packed").when(F.col("entropy") <= SPARSE_BITS, "sparse").otherwise("mixed")
    return scored.withColumn("kind", kind)


def autocorrelation(sources: DataFrame, strides: int = 8) -> DataFrame:
    """Share of bytes equal to the one ``stride`` before, for strides shorter
    than the source: (source_id, stride, compared, equal, score)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, content in zip(b["source_id"], b["content"]):
                data = np.frombuffer(content or b"", dtype=np.uint8)
                for s in range(1, min(strides, len(data) - 1) + 1):
                    out.append((key, s, len(data) - s, int((data[s:] == data[:-s]).sum())))
            yield pd.DataFrame(out, columns=["source_id", "stride", "compared", "equal"])

    kind = dict(sources.dtypes)["source_id"]
    rows = sources.select("source_id", "content").mapInPandas(scan, f"source_id {kind}, stride int, compared long, equal long")
    return rows.withColumn("score", F.col("equal") / F.col("compared"))


def geometry_candidates(strides: DataFrame, best: int = 1) -> DataFrame:
    """For each source's best strides (score, then the shorter), the plane
    counts 1 to 8 that divide the stride and the row width they mean."""
    top = W.capped(strides, ["source_id"], [F.desc("score"), F.asc("stride")], best).drop("total", "total_truncated")
    planes = top.withColumn("planes", F.explode(F.sequence(F.lit(1), F.lit(8)))).where("stride % planes = 0")
    return planes.withColumn("row_pixels", F.expr("cast(stride div planes AS bigint) * 8"))


def palette_runs(words: DataFrame, minimum: int = 8, key: str = "source_id") -> DataFrame:
    """Runs of 16-bit words (key, pos, word) whose top nibble is 0, of at least
    max(``minimum``, 2) words, two of them different: (key, first, colours, distinct_colours)."""
    hits = W.islands(words.where(F.col("word").bitwiseAND(0xF000) == 0), [key], "pos")
    runs = hits.groupBy(key, "island").agg(
        F.min("pos").alias("first"), F.count(F.lit(1)).alias("colours"), F.count_distinct("word").alias("distinct_colours")
    )
    return runs.where((F.col("colours") >= max(minimum, 2)) & (F.col("distinct_colours") >= 2)).drop("island")


def palette_tables(sources: DataFrame, minimum: int = 8) -> DataFrame:
    """Palette tables in byte sources: (source_id, start, stop, colours). Found
    in the row: on the grid of even offsets, words 0x0000 to 0x0FFF."""
    return parse(sources, lambda c: _palettes(c, minimum), "start long, stop long, colours long").drop("error")


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of at least ``least`` true places."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    start, stop = edges[::2], edges[1::2]
    long = stop - start >= least
    return start[long], stop[long]


def _palettes(content: bytes, minimum: int) -> list[tuple]:
    w = np.frombuffer(content[: len(content) // 2 * 2], dtype=">u2")
    found = zip(*(x.tolist() for x in _runs(w < 0x1000, max(minimum, 2))))
    return [(2 * a, 2 * z, z - a) for a, z in found if (w[a:z] != w[a]).any()]


#: Ranges of registers that a display list sets up: fixed values of the chip set.
DISPLAY_REGISTERS = ((0x080, 0x096), (0x0E0, 0x13E), (0x180, 0x1BE))
LONGEST_LIST = 4096


def copper_lists(sources: DataFrame) -> DataFrame:
    """Plausible display lists on the grid of 4 bytes: (source_id, start, stop,
    instructions, moves). Each ends with FFFF FFFE and is the longest run of
    instructions up to there (LONGEST_LIST at most): waits, skips and moves to
    registers 0x080 to 0x1FE; three moves at least, one to a display register.
    A longer run has all moves of a shorter one, so the earliest start decides."""
    return parse(sources, _display_lists, "start long, stop long, instructions long, moves long").drop("error")


def _display_lists(content: bytes) -> list[tuple]:
    if b"\xff\xff\xff\xfe" not in content:
        return []
    w = np.frombuffer(content[: len(content) // 4 * 4], dtype=">u2").reshape(-1, 2).astype(np.int64)
    first = w[:, 0]
    end = (first == 0xFFFF) & (w[:, 1] == 0xFFFE)
    move = first % 2 == 0
    sound = ~move | (first >= 0x80) & (first <= 0x1FE)
    shown = move & np.logical_or.reduce([(first >= a) & (first <= z) for a, z in DISPLAY_REGISTERS])
    moves, shows = np.concatenate([[0], (move & sound).cumsum()]), np.concatenate([[0], shown.cumsum()])
    breaks = np.flatnonzero(~sound | end)
    ends = np.flatnonzero(end)
    at = np.searchsorted(breaks, ends)
    before = np.where(at > 0, breaks[np.maximum(at - 1, 0)] + 1, 0)
    out = []
    for s, e in zip(np.maximum(before, ends - LONGEST_LIST + 1).tolist(), ends.tolist()):
        if moves[e] - moves[s] >= 3 and shows[e] > shows[s]:
            out.append((4 * s, 4 * e + 4, e - s + 1, int(moves[e] - moves[s])))
    return out


def pointer_runs(words: DataFrame, low: int, high: int, minimum: int = 3, key: str = "source_id") -> DataFrame:
    """Runs of at least ``minimum`` words (key, pos, word) that are not 0 and lie
    in [low, high): (key, first, entries, lowest, highest, seeds), seeds being
    the distinct even targets less ``low``."""
    hits = W.islands(words.where((F.col("word") != 0) & (F.col("word") >= low) & (F.col("word") < high)), [key], "pos")
    runs = hits.groupBy(key, "island").agg(
        F.min("pos").alias("first"), F.count(F.lit(1)).alias("entries"), F.min("word").alias("lowest"), F.max("word").alias("highest"),
        F.count_distinct(F.when((F.col("word") - low) % 2 == 0, F.col("word"))).alias("seeds"),
    )
    return runs.where(F.col("entries") >= minimum).drop("island")


def pcm_regions(
    sources: DataFrame, block: int = 1024, minimum: int = 2048, least_amplitude: float = 6.0,
    smoothness: float = 0.85, bias: float = 0.5, dominant: float = 0.5,
) -> DataFrame:
    """Runs of blocks that score like signed 8-bit samples, at least ``minimum``
    bytes long and scored again as a whole: (source_id, start, stop, amplitude,
    smoothness)."""

    def stats(x: np.ndarray) -> tuple[float, float, float, float] | None:
        if len(x) < 2:
            return None
        x = x.astype(np.int64)
        amplitude = np.abs(x).sum() / len(x)
        below = amplitude + 1
        return amplitude, np.abs(np.diff(x)).sum() / (len(x) - 1) / below, abs(x.sum() / len(x)) / below, np.bincount(x + 128).max() / len(x)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, content in zip(b["source_id"], b["content"]):
                data = np.frombuffer(content or b"", dtype=np.int8)
                start = None
                for at in range(0, len(data) + block, block):
                    s = stats(data[at : at + block]) if at < len(data) else None
                    fine = s is not None and s[0] >= least_amplitude and s[1] <= smoothness and s[2] <= bias and s[3] <= dominant
                    if fine and start is None:
                        start = at
                    elif not fine and start is not None:
                        end = min(at, len(data))
                        if end - start >= minimum:
                            whole = stats(data[start:end])
                            out.append((key, start, end, float(whole[0]), float(whole[1])))
                        start = None
            yield pd.DataFrame(out, columns=["source_id", "start", "stop", "amplitude", "smoothness"])

    if block < 2:
        block, minimum = 2, 1 << 62
    kind = dict(sources.dtypes)["source_id"]
    return sources.select("source_id", "content").mapInPandas(scan, f"source_id {kind}, start long, stop long, amplitude double, smoothness double")


def envelope(samples: DataFrame, key: str, position: str, value: str, buckets: int) -> DataFrame:
    """At most ``buckets`` (lowest, highest) pairs of each key's values in order
    of position: the buckets are equal runs of ceil(n / min(buckets, n))."""
    ordered = samples.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(position)) - 1)
    sized = ordered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    per = F.ceil(F.col("_n") / F.least(F.lit(buckets), F.col("_n")))
    bucket = F.floor(F.col("_i") / per).cast("long").alias("bucket")
    return sized.groupBy(key, bucket).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"))


def survey(sources: DataFrame, minimum_string: int = 6, minimum_colours: int = 8) -> DataFrame:
    """An ordered, gapless map of each source: (source_id, start, stop, kind,
    detail_count, entropy). Strings (merged), palettes, display lists and
    tracker modules are located, swept so that none overlap, and what is left
    is scored by entropy: all in the row that has the bytes."""
    return parse(sources, lambda c: regions(c, minimum_string, minimum_colours), "start long, stop long, kind string, detail_count long, entropy double").drop("error")


def regions(content: bytes, minimum_string: int = 6, minimum_colours: int = 8) -> list[tuple]:
    """``survey`` of one source: (start, stop, kind, detail_count, entropy)."""
    found = [(a, -1, -z, "strings", n) for a, z, n in _merged(content, minimum_string)]
    found += [(a, -2, -z, "palette", n) for a, z, n in _palettes(content, minimum_colours)]
    found += [(a, -3, -z, "copper", n) for a, z, n, _ in _display_lists(content)]
    found += [(a, -4, -a - total, "module", channels) for a, _, _, channels, *_, total in media.find_modules(content)]
    out, at = [], 0
    for start, _, stop, kind, count in sorted(found):
        if -stop > at:
            if start > at:
                out.append(_scored(content, at, start))
            out.append((max(start, at), -stop, kind, count, None))
            at = -stop
    if at < len(content):
        out.append(_scored(content, at, len(content)))
    return out


def _merged(content: bytes, minimum: int, gap: int = MERGE_GAP) -> list[tuple]:
    """Printable runs of at least ``minimum`` bytes, near ones made one: (start, stop, strings)."""
    start, stop = _runs((np.frombuffer(content, np.uint8) - np.uint8(0x20)) <= 0x5E, max(minimum, 1))
    fresh = np.flatnonzero(start[1:] > stop[:-1] + gap) + 1
    first = np.concatenate([[0], fresh]) if len(start) else fresh
    last = np.concatenate([fresh, [len(start)]]) if len(start) else fresh
    return list(zip(start[first].tolist(), stop[last - 1].tolist(), (last - first).tolist()))


def _scored(content: bytes, start: int, stop: int) -> tuple:
    count = np.bincount(np.frombuffer(content, np.uint8, stop - start, start))
    some = count[count > 1]
    entropy = float(np.log2(stop - start) - (some * np.log2(some)).sum() / (stop - start))
    kind = "packed" if entropy >= PACKED_BITS else "sparse" if entropy <= SPARSE_BITS else "code-or-bitmap"
    return start, stop, kind, 0, entropy
