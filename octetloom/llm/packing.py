"""Best-fit packing of tokenised documents by minimum bin slack."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, materialize, unclashing, with_rank
from .word_bpe import Encoder

def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(batches: Iterator[pd.DataFrame], path: str, capacity: int, end_id: int, ordered: bool) -> Iterator[pd.DataFrame]:
    encoder = Encoder(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity
    for b in batches:
        out = []
        for row, text in enumerate(b["text"]):
            ids = encoder.encode(text or "") + end
            for k, a in enumerate(range(0, len(ids), step)):
                piece = ids[a : a + step]
                out.append((row, k, a // 4, len(piece) // 4, zlib.crc32(piece)))
        frame = pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32"])
        row = frame.pop("row").to_numpy(dtype=np.int64)
        frame.insert(0, "doc_id", b["doc_id"].astype("Int64").array[row])
        if ordered:
            frame["_place"] = b["_place"].to_numpy()[row]
        yield frame


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, order: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces, and
    _place, the document's ``order`` (a long column), if one is given."""
    place = [F.col(order).cast("long").alias("_place")] if order else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *place).mapInPandas(
        lambda batches: _pieces(batches, path, capacity, end_id, bool(order)),
        "doc_id long, piece int, start long, length long, ids_crc32 long" + (", _place long" if order else ""),
    )


# -- minimum bin slack ------------------------------------------------------

def _fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of available lengths with the largest sum up to ``room``:
    subset sums held as bits of an integer, one step a (length, power of two
    copies), then traced back."""
    reach, steps, mask = 1, [], (2 << room) - 1
    for length in lengths:
        if length > room:
            continue
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            total -= length * copies
            taken[length] = taken.get(length, 0) + copies
    return list(taken.items())


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (number of equal bins, [(length, copies in each)]).

    Each step seeds a bin with the longest length left and fills it as full as
    the available lengths allow; that combination is then taken as often as its
    lengths last. Each step uses up a length, so there are at most ``capacity``
    steps however many pieces there are.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    order = [-k for k in counts]
    heapq.heapify(order)
    bins = []
    while counts:
        while -order[0] not in counts:
            heapq.heappop(order)
        longest = -order[0]
        counts[longest] -= 1
        combo = dict(_fullest(sorted((k for k in counts if counts[k]), reverse=True), counts, capacity - longest)) if longest < capacity else {}
        counts[longest] += 1
        combo[longest] = combo.get(longest, 0) + 1
        times = min(counts[k] // c for k, c in combo.items())
        for k, c in combo.items():
            counts[k] -= c * times
            if not counts[k]:
                del counts[k]
        bins.append((times, sorted(combo.items(), reverse=True)))
    return bins


def layout(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, runs of its pieces' ranks: the rank at which the run
    starts, the first sequence of the run, copies in each, offset of the first."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for times, combo in bins:
        offset = 0
        for length, copies in combo:
            runs.setdefault(length, []).append((rank.get(length, 0), sequence, copies, offset))
            rank[length] = rank.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    return {k: dict(zip(("rank", "sequence", "copies", "offset"), np.array(v, dtype=np.int64).T)) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, order: str | None = None) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Returns, per piece, (doc_id, piece, start, length, ids_crc32, sequence_id,
    offset). A document's ids are its text's and then ``end_id``; only longer
    ones are cut, into pieces of ``capacity``, the last of which may be shorter.
    A null or empty text is ``end_id`` alone; a null doc_id stays null; repeated
    rows are packed one by one; an empty table gives an empty result; other
    columns are ignored.

    Only the histogram of piece lengths (``capacity`` numbers at most) reaches
    the driver, where minimum bin slack plans the bins: per bin, bitset
    subset-sum dynamic programming finds the fullest combination. The plan goes
    back as runs of ranks within each length. Ranks are exact and dealt by
    hashed bucket, so one frequent length is no hot task.

    With ``order`` (a column of numbers from 0, not null, such as a mixture's
    position) the packing follows it: of the pieces of one length, those that
    come first take the places that are planned first, and sequences are
    numbered by the first in order of their pieces.
    """
    path = tokenizer or default_tokenizer()
    cut = materialize(pieces(docs, path, capacity, end_id, order), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = layout(minimum_bin_slack(histogram, capacity))
    n = sum(histogram.values())
    buckets = buckets_for(n)
    if order:
        last = cut.agg(F.max("_place")).first()[0] or 0
        along = F.expr(f"_place div {last // buckets + 1}")
        bucket, ties = along, [F.col("_place")]
    else:
        bucket, ties = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)), []
    ranked = with_rank(
        unclashing(cut, ["_rank"]), ["length"], bucket, [*ties, F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank"
    ).drop("_rank_total")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            sequence, offset = np.empty(len(b), dtype=np.int64), np.empty(len(b), dtype=np.int64)
            for k in np.unique(length):
                at, run = np.flatnonzero(length == k), runs[int(k)]
                i = np.searchsorted(run["rank"], rank[at], side="right") - 1
                nth = rank[at] - run["rank"][i]
                sequence[at] = run["sequence"][i] + nth // run["copies"][i]
                offset[at] = run["offset"][i] + nth % run["copies"][i] * k
            yield b.drop(columns="_rank").assign(doc_id=b["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    made = "doc_id long, piece int, start long, length long, ids_crc32 long"
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if not order:
        return ranked.select(*own, "_rank").mapInPandas(place, f"{made}, sequence_id long, offset long")
    placed = materialize(
        ranked.select(*own, "_place", "_rank").mapInPandas(place, f"{made}, _place long, sequence_id long, offset long"), "placed"
    )
    first = placed.groupBy("sequence_id").agg(F.min("_place").alias("_place")).withColumn("_all", F.lit(0))
    numbered = with_rank(first, ["_all"], along, [F.col("_place"), F.col("sequence_id")], "_number").select("sequence_id", "_number")
    return placed.join(numbered, "sequence_id").select(*own, F.col("_number").alias("sequence_id"), "offset")
