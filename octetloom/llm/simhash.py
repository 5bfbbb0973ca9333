"""SimHash near-duplicates found with Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import smallest_reachable

SEED = 42
#: Up to this many fingerprints of one key are compared pair by pair; larger
#: keys are linked through shared neighbours instead, also exactly.
PAIRS_UP_TO = 24
#: Fingerprints of at least 1/HOT_SHARE of all rows are joined by broadcast.
HOT_SHARE = 1000


# -- fingerprints -----------------------------------------------------------

def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included.

    A-Z are lower-cased; words are runs of anything but space and 0x09-0x0D.
    With fewer words than a shingle needs, all of them are the one shingle;
    without words the fingerprint is 0.
    """
    # bytes.lower and bytes.split know ASCII only, which is the contract.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), words_per_shingle
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        n = len(words) - k + 1
        spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is in over half the hashes."""
    set_in = np.zeros(64, dtype=np.int64)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(octets), 65536):
        set_in += np.unpackbits(octets[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes)).tobytes(), "big")


def fingerprints(words_per_shingle: int = 3):
    """A pandas UDF of whole texts' fingerprints, as signed longs."""

    def of(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, words_per_shingle) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(values.view(np.int64))

    return F.pandas_udf(of, T.LongType())


# -- the Golay code ---------------------------------------------------------

#: Generator polynomial of the perfect binary [23,12,7] Golay code.
GENERATOR = 0b101011100011
LENGTH, MESSAGE_BITS = 23, 12
CHECK_BITS = LENGTH - MESSAGE_BITS


def _remainder(word: np.ndarray) -> np.ndarray:
    word = word.copy()
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        word ^= np.where((word >> bit) & 1, GENERATOR << (bit - CHECK_BITS), 0)
    return word


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(error of each syndrome, its weight, the 253 codewords of weight 7)."""
    one = [1 << i for i in range(LENGTH)]
    errors = [0, *one]
    errors += [a | b for i, a in enumerate(one) for b in one[:i]]
    errors += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    errors = np.array(errors, dtype=np.int64)
    leader = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    leader[_remainder(errors)] = errors  # perfect: one error of weight <= 3 a syndrome
    messages = np.arange(1 << MESSAGE_BITS, dtype=np.int64) << CHECK_BITS
    words = messages | _remainder(messages)
    weight = np.bitwise_count(words)
    return leader, np.bitwise_count(leader), words[weight == 7]


@cache
def _continuations() -> np.ndarray:
    """For each syndrome whose error has weight 3, the five weight-7 codewords
    that cover that error (zeros elsewhere)."""
    leader, weight, sevens = golay_tables()
    out = np.zeros((len(leader), 5), dtype=np.int64)
    for s in np.flatnonzero(weight == 3):
        out[s] = sevens[(sevens & leader[s]) == leader[s]]
    return out


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """All codewords within distance 4 of each 23-bit word, as 12-bit indices:
    one, or six where the nearest is 3 away. Rows of six; repeats pad.

    Two words at most 2 bits apart share one: a word between them is within 3
    of its codeword (the code is perfect), so both are within 4 of that.
    """
    leader, _, _ = golay_tables()
    syndrome = _remainder(segment)
    nearest = segment ^ leader[syndrome]
    near = np.concatenate([nearest[:, None], nearest[:, None] ^ _continuations()[syndrome]], axis=1)
    return near >> CHECK_BITS


#: First bit and width of the three segments of a fingerprint.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def golay_keys(values: np.ndarray) -> np.ndarray:
    """Keys (rows of 18, repeats pad) of uint64 fingerprints. Two fingerprints
    at most 2 bits apart share a key.

    Each key joins one segment taken exactly with the codeword index of the
    next segment (cyclically). Of two errors over three segments, some segment
    without an error is followed by one with both, one or none of them: if one
    segment has all errors, its predecessor is clean; if two have one each, the
    third is clean and its successor has one.
    """
    value = values.astype(np.uint64)
    parts = [((value >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    keys = []
    for i in range(3):
        index = codeword_indices(parts[(i + 1) % 3])
        keys.append((((i << 22) | parts[i])[:, None] << MESSAGE_BITS) | index)
    return np.concatenate(keys, axis=1)


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = b["fp"].to_numpy(dtype=np.int64)
        keys = np.sort(golay_keys(fps.view(np.uint64)), axis=1)
        fresh = np.ones(keys.shape, dtype=bool)
        fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
        rows, _ = np.nonzero(fresh)
        yield pd.DataFrame({"key": keys[fresh], "fp": fps[rows]})


def _flips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    masks = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    for b in batches:
        fps = b["fp"].to_numpy(dtype=np.int64)
        for i in range(0, len(fps), 4096):
            part = fps[i : i + 4096]
            near = (part.view(np.uint64)[:, None] ^ masks[None, :]).view(np.int64)
            yield pd.DataFrame({"near": near.ravel(), "fp": np.repeat(part, 65)})


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column ``fp``) that join just
    those whose chains of links of at most 2 differing bits meet.

    Fingerprints meet on a Golay key. Keys with up to PAIRS_UP_TO members give
    pairs, which are verified bit by bit. The members of larger keys go another
    exact way, without pairs: two fingerprints differ in at most 2 bits just if
    some value is within 1 bit of both, so each sends itself and its 64 one-bit
    neighbours, and all that send a value are linked to the smallest of them.
    """
    keys = materialize(distinct.mapInPandas(_key_rows, "key long, fp long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(keys.join(sizes, "key"), "golay-met")
    small = met.where(F.col("n") <= PAIRS_UP_TO).select("key", "fp")
    pairs = (
        small.alias("x").join(small.alias("y"), "key")
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .where("a < b AND bit_count(a ^ b) <= 2")
    )
    hubs = met.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct().mapInPandas(_flips, "near long, fp long")
    first = hubs.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("near", "a")
    stars = hubs.join(first, "near").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """Return (doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits. Fingerprints at most 2 bits
    apart are linked, and ``component_id`` is the smallest doc_id that links
    reach. Null and wordless texts have fingerprint 0 and link like others;
    a null doc_id counts as larger than any; repeated rows stay, each with its
    class; an empty table gives an empty result. Other columns are ignored.

    Copies are merged before any join (one row per fingerprint, partial sums
    first), so a class's size never shows in the join on keys.
    """
    prints = materialize(docs.select("doc_id", fingerprints(words_per_shingle)("text").alias("fp")), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    edges = materialize(links(distinct.select("fp")), "simhash-links")
    reached = smallest_reachable(edges)
    # Only linked fingerprints need a class: (fp -> its component's root).
    roots = reached.join(distinct, reached.node == distinct.fp).select("node", "root", "first")
    smallest = roots.groupBy("root").agg(F.min("first").alias("component"))
    linked = roots.join(smallest, "root").select(F.col("node").alias("fp"), "component")
    classes = materialize(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"), "n"), "simhash-classes")
    # A fingerprint of a thousandth of all rows or more would make a large task
    # of the join; there are a thousand of these at most, so they are broadcast.
    rows = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.col("n") * HOT_SHARE >= max(rows, 1)
    hot = classes.where(common).select("fp", "component_id")
    known = prints.join(F.broadcast(hot), "fp", "left").withColumnRenamed("component_id", "known")
    near = known.where("known IS NOT NULL").select("doc_id", "fp", F.col("known").alias("component_id"))
    # A class of null ids alone has a null component and stays with the others.
    rest = known.where("known IS NULL").drop("known").join(classes.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    return near.unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
