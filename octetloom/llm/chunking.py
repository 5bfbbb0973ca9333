"""Document fingerprints by content-defined chunking."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least, normal and largest bytes of a chunk.
LEAST, NORMAL, MOST = 12, 32, 128
#: A cut needs this many zero bits before, and after, the normal size.
STRICT_BITS, LOOSE_BITS = 6, 3
#: Bytes that the rolling hash looks back on.
WINDOW = 32
#: Hexadecimal digits kept of a chunk's digest.
DIGITS = 12
#: Most ranges of document ids.
MAX_RANGES = 4096
RANGE_ROWS = 100


@cache
def _gear() -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], dtype=np.uint32)


def _rolled(data: bytes) -> np.ndarray:
    """The gear hash after each byte: sum of gear[byte k back] << k, mod 2**32,
    built for windows of 1, 2, 4 ... 32 bytes."""
    h = _gear()[np.frombuffer(data, dtype=np.uint8)]
    w = 1
    while w < WINDOW and w < len(h):
        longer = h.copy()
        longer[w:] += h[:-w] << np.uint32(w)
        h, w = longer, 2 * w
    return h


def chunk_ends(data: bytes, start: int = 0) -> list[int]:
    """Where chunks end, from a chunk boundary ``start`` on. Cuts depend on
    content alone: the first place past LEAST where the hash's top STRICT_BITS
    are zero, past NORMAL its top LOOSE_BITS, and at MOST in any case."""
    back = max(0, start - WINDOW)
    top = _rolled(data[back:]) >> np.uint32(32 - STRICT_BITS)
    loose_at = np.flatnonzero((top >> np.uint32(STRICT_BITS - LOOSE_BITS)) == 0)
    strict = (loose_at[top[loose_at] == 0] + back + 1).tolist()
    loose = (loose_at + back + 1).tolist()
    n, ends, at, i, j = len(data), [], start, 0, 0
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST, i)
        if i < len(strict) and strict[i] < at + NORMAL:
            at = strict[i]
        else:
            j = bisect_left(loose, at + NORMAL, j)
            at = loose[j] if j < len(loose) and loose[j] < at + MOST else min(at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunk_weights(data: bytes, ends: list[int]) -> dict[str, int]:
    """Chunk digest -> bytes of the text in that chunk, over all its repeats."""
    digest, out, a = xxhash.xxh64_hexdigest, {}, 0
    for b in ends:
        key = digest(data[a:b])[:DIGITS]
        out[key] = out.get(key, 0) + b - a
        a = b
    return out


def encode(weights: dict[str, int]) -> str:
    return ",".join([f"{k}:{w}" for k, w in sorted(weights.items())])


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """The share of a's bytes whose chunks b holds too; two empty ones are alike."""
    if not a or not b:
        return float(not a and not b)
    return sum([min(w, b[k]) for k, w in a.items() if k in b]) / sum(a.values())


class Fingerprint:
    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode()
        self.ends = chunk_ends(self.data)
        self.weights = chunk_weights(self.data, self.ends)

    def edited(self, other: str) -> tuple[bytes, dict[str, int]]:
        """The text with its last quarter replaced by the head of ``other``;
        chunks before the edit are taken over."""
        k = len(self.text) // 4
        if not k:
            return self.data, self.weights
        kept = self.text[: len(self.text) - k].encode()
        data = kept + other[:k].encode()
        same = self.ends[: max(0, bisect_left(self.ends, len(kept) - LEAST))]
        return data, chunk_weights(data, same + chunk_ends(data, same[-1] if same else 0))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by range, then id; a range's last row only follows another."""
    waiting: tuple[int, object, Fingerprint] | None = None
    for b in batches:
        out = []
        for k, doc_id, text, extra in zip(b["_range"], b["doc_id"].astype("Int64"), b["text"], b["_extra"]):
            now = Fingerprint(text)
            if waiting and waiting[0] == k:
                own = waiting[2]
                data, weights = own.edited(now.text)
                out.append((
                    waiting[1], len(own.text), hashlib.sha256(data).hexdigest(), encode(own.weights), encode(weights),
                    containment(own.weights, weights), containment(own.weights, now.weights),
                ))
            waiting = None if extra else (k, doc_id, now)
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def _range_of(bounds: list[int]):
    """The number of ``bounds`` (ascending) up to the id, looked up in two levels."""
    from math import isqrt

    step = isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.expr("array()").cast("array<long>")
    firsts, members = longs([g[0] for g in groups if g][1:]), F.array(*[longs(g) for g in groups])
    group = F.size(F.filter(firsts, lambda x: x <= F.col("_id")))
    return (group * step + F.size(F.filter(F.get(members, group), lambda x: x <= F.col("_id")))).cast("int")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, and its edited text, of ``docs``.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). A fingerprint lists the text's chunk digests in
    order with the bytes each covers; likeness is the share of a document's
    bytes in chunks that the other has too. The next document is the one with
    the next larger doc_id, the first after the last (itself when alone).

    Null texts count as empty (fingerprint empty; two empty texts are alike to
    1, an empty and another to 0); null ids come before all others; rows of one
    id are ordered by text; an empty table gives an empty result; other columns
    are ignored.

    Ids are cut into ranges of about equal counts by a quantile sketch. Texts
    travel once, by range, and each range also gets the first document of the
    next, so that no order over all rows is needed.
    """
    low = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_id", F.coalesce("doc_id", low))
    n = rows.count()
    wanted = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    bounds: list[int] = []
    if wanted > 1:
        at = [i / wanted for i in range(1, wanted)]
        bounds = sorted(set(rows.agg(F.percentile_approx("_id", at, 20_000)).first()[0]))
    rows = rows.withColumn("_range", _range_of(bounds))
    # One row a range, MAX_RANGES at most.
    heads = sorted((r["_range"], r["first"]) for r in rows.groupBy("_range").agg(F.min("_id").alias("first")).collect())
    after = [(first, heads[i - 1][0]) for i, (_, first) in enumerate(heads)]
    spark = docs.sparkSession
    following = spark.createDataFrame(after, "_id long, _before int")
    extra = (
        rows.join(F.broadcast(following), "_id").groupBy("_id", "_before").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", "_id", F.col("_before").alias("_range"), F.lit(True).alias("_extra"))
    )
    dealt = rows.withColumn("_extra", F.lit(False)).unionByName(extra).repartition("_range")
    ordered = dealt.sortWithinPartitions("_range", "_extra", "_id", "text")
    return ordered.select("_range", "doc_id", "text", "_extra").mapInPandas(_pairs, SCHEMA)
