"""Quality classifier: supervised subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash buckets of each kind of feature: words, word pairs, character n-grams.
BUCKET_BITS = 18
CHAR_ORDERS = (3, 5)
KINDS = 2 + len(CHAR_ORDERS)
#: Most labelled documents that the classifier is fitted on (a seeded sample).
SAMPLE_ROWS = 3000
#: Texts hashed together, in bytes.
CHUNK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, dtype=np.uint64)
    up = np.concatenate([one, np.full(n - 1, _BASE, dtype=np.uint64)]).cumprod(dtype=np.uint64)
    down = np.concatenate([one, np.full(n - 1, inverse, dtype=np.uint64)]).cumprod(dtype=np.uint64)
    return up, down


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return ((h * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature, (buckets, number of each text's features).

    Kinds: words, pairs of neighbouring words, byte n-grams of CHAR_ORDERS.
    No feature spans two texts.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = sizes.cumsum()
    starts = ends - sizes
    n = len(data)
    if not n:
        return [(np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64))] * KINDS
    up, down = _powers(1 << max(16, int(n).bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    own = np.repeat(np.arange(len(texts)), sizes)
    inside = ~_IS_SPACE[data]
    first = np.zeros(n, dtype=bool)
    first[starts[sizes > 0]] = True
    begin = inside & np.concatenate([[True], ~inside[:-1]]) | inside & first
    stop = inside & np.concatenate([~inside[1:] | first[1:], [True]])
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    word = (sums[b] - sums[a]) * down[a]
    of = own[a]
    out = [(_bucket(word), np.bincount(of, minlength=len(texts)))]
    near = of[1:] == of[:-1]
    pair = (word[:-1] * np.uint64(31) ^ (word[1:] + _BASE))[near]
    # Repeats look alike whatever the word is.
    pair[(word[1:] == word[:-1])[near]] = np.uint64(7)
    out.append((_bucket(pair), np.bincount(of[1:][near], minlength=len(texts))))
    for k in CHAR_ORDERS:
        at = np.flatnonzero(np.arange(n) + k <= ends[own])
        out.append((_bucket((sums[at + k] - sums[at]) * down[at]), np.maximum(sizes - k + 1, 0)))
    return out


def _text_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each text's sum, the same whatever texts stand beside it."""
    out, some = np.zeros(len(counts)), counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (counts.cumsum() - counts)[some], dtype=np.float64)
    return out


@dataclass
class Model:
    """``logit`` has, for each kind and bucket, the bucket's vector times the
    difference of the two softmax rows: what it adds to the log odds."""

    logit: np.ndarray
    bias: float

    def log_odds(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for table, (buckets, counts) in zip(self.logit, features(texts)):
            total += _text_sums(table[buckets], counts) / np.maximum(counts, 1)
        return total


def train(texts: list[bytes], labels: list[int], dim: int = 8, epochs: int = 4, rate: float = 4.0, batch: int = 32, seed: int = 1) -> Model:
    """Fit bucket vectors and a two-way softmax by stochastic gradient descent.

    A text's vector is the sum over kinds of the mean of its features' vectors.
    With one class only (or no text) the model answers with its share, smoothed.
    """
    y = np.array(labels, dtype=np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    size = 1 << BUCKET_BITS
    if len(set(labels)) < 2:
        return Model(np.zeros((KINDS, size), dtype=np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    rows = []
    for text in texts:
        ids, weights = [], []
        for kind, (buckets, _) in enumerate(features([text])):
            if len(buckets):
                u, c = np.unique(buckets, return_counts=True)
                ids.append(u + kind * size)
                weights.append(c / len(buckets))
        rows.append((np.concatenate(ids).astype(np.int32), np.concatenate(weights).astype(np.float32)) if ids else (np.empty(0, np.int32), np.empty(0, np.float32)))
    vectors = rng.uniform(-1 / dim, 1 / dim, (KINDS * size, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), dtype=np.float32), np.log([1 - share, share])
    steps, step = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            lr = rate * (1 - step / steps)
            step += 1
            ids = np.concatenate([rows[i][0] for i in some])
            weights = np.concatenate([rows[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            used, place = np.unique(ids, return_inverse=True)
            v = vectors[used]
            hidden = np.zeros((len(some), dim))
            for d in range(dim):
                hidden[:, d] = np.bincount(owner, v[place, d] * weights, minlength=len(some))
            z = hidden @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            back = p @ out
            for d in range(dim):
                vectors[used, d] -= lr * np.bincount(place, back[owner, d] * weights, minlength=len(used))
            out -= (lr / len(some)) * (p.T @ hidden)
            bias -= 0.1 * (lr / len(some)) * p.sum(axis=0)
    logit = (vectors @ (out[1] - out[0])).reshape(KINDS, size)
    seen = np.zeros(KINDS * size, dtype=bool)
    for ids, _ in rows:
        seen[ids] = True
    logit[~seen.reshape(KINDS, size)] = 0  # never trained: random starts say nothing
    return Model(logit.astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, seed: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` labelled documents, chosen by a seeded
    hash of doc_id among those for which ``usable`` holds. Ids labelled twice
    count once, with the larger label, and ids of several texts with the first of
    these; null labels count as none."""
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
    kept = kept.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = kept.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers are broadcast.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    once = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r["text"] or "", r["label"]) for r in once.orderBy("doc_id").collect()]


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        some.append((t or "").encode())
        size += len(some[-1])
        if size >= CHUNK_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def score(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """Return ``docs`` with ``score`` (double, 0 to 1: how likely the label is
    1) and ``predicted`` (int).

    The classifier is fitted on at most ``rows`` labelled documents for which
    ``usable`` (an expression over doc_id) holds, and sees their text alone.
    Whole texts are scored. Null texts count as empty; an empty text, and any
    text when nothing was labelled, gets the score of the share of labels;
    rows with null or repeated ids are scored like others; columns named
    ``score`` or ``predicted`` are replaced. Nothing is shuffled to score: the
    model (BUCKET_BITS and KINDS bound it to 4 MB) goes to every executor.
    """
    sample = labelled_sample(docs, labels, label, usable, rows, seed)
    model = train([t.encode() for t, _ in sample], [int(y > 0) for _, y in sample])
    shared = docs.sparkSession.sparkContext.broadcast((model.logit, model.bias))

    def odds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logit, bias = shared.value
        own = Model(logit, bias)
        for s in batches:
            parts = [own.log_odds(c) for c in _chunks(s.tolist())]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(parts) if parts else np.empty(0), -30, 30))))

    columns = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    udf = F.pandas_udf(odds, T.DoubleType(), functionType=F.PandasUDFType.SCALAR_ITER)
    scored = docs.select(*columns, udf(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
