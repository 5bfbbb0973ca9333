"""Toxicity by class-conditional Kneser-Ney language models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import _BASE, _MIX, CHUNK_BYTES, _chunks, _powers, _text_sums, labelled_sample

#: Most labelled documents that the models are fitted on (a seeded sample).
SAMPLE_ROWS = 3000
FOLDS = 3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, number of words of each text). Words are
    runs of ASCII letters (lower-cased), digits and bytes above 0x7F."""
    some, size, words, counts = [], 0, [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for i, t in enumerate(texts):
        some.append(t)
        size += len(t)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            w, n = _hashed(some)
            words.append(w)
            counts.append(n)
            some, size = [], 0
    return np.concatenate(words), np.concatenate(counts)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = _FOLD[np.frombuffer(b"".join([t + b" " for t in texts]), dtype=np.uint8)]
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    inside = _LETTER[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a space ends each text
    h = (sums[b] - sums[a]) * down[a]
    own = np.searchsorted(sizes.cumsum(), a, side="right")
    return h ^ (h >> np.uint64(31)), np.bincount(own, minlength=len(texts))


def _pairs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with the one before it, that one's hash); 0 starts a text."""
    before = np.concatenate([np.zeros(1, dtype=np.uint64), words[:-1]])[: len(words)]
    starts = counts.cumsum() - counts
    before[starts[counts > 0]] = 0
    return (before * _MIX) ^ (words + _BASE), before


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


@dataclass
class Ratios:
    """Log ratios, toxic over ordinary, that scoring needs: of words at the
    lower order (all others: ``other``), of the backoff weight of contexts, and
    of pairs that were seen."""

    words: np.ndarray
    word_ratio: np.ndarray
    other: float
    contexts: np.ndarray
    context_ratio: np.ndarray
    pairs: np.ndarray
    pair_ratio: np.ndarray

    def means(self, texts: list[bytes]) -> np.ndarray:
        """Each text's log-likelihood ratio per word; 0 without words."""
        words, counts = word_hashes(texts)
        if not len(words):
            return np.zeros(len(texts))
        pair, before = _pairs(words, counts)
        backed_off = _look(self.words, self.word_ratio, words, self.other) + _look(self.contexts, self.context_ratio, before)
        known = _look(self.pairs, self.pair_ratio, pair, np.nan)
        return _text_sums(np.where(np.isnan(known), backed_off, known), counts) / np.maximum(counts, 1)


def _discounted(count: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Counts less their discount: what each class would have by this split of
    the shared counts, and the largest deviation that chance gives among so many.
    Counts of one or a few are discounted whole unless next to nothing was expected."""
    shared = count.sum(axis=0)
    largest = np.sqrt(2 * np.log(max(count.shape[1], 2)))
    return np.maximum(count - shared * split - largest * np.sqrt(shared * split * (1 - split)), 0)


def fit(texts: list[bytes], toxic: np.ndarray) -> Ratios:
    """Interpolated Kneser-Ney models of both classes, as ratios. Copies of a
    text count once, and so do a document's repeats of a word pair.

    Orders: word pairs by the number of documents of the class; words by how
    many the class has them in; then words by continuation counts (distinct
    words before them) of both classes together, with one for a word never
    seen. Each order is discounted and gives the rest to the next. The discount
    is not one number for all counts but what the class would have if it shared
    its counts with the other by chance, so rare expressions, and common ones
    that both use alike, lean on the shared counts and favour no class; an
    expression that one class has far more than its share of keeps its counts.
    """
    once = sorted({t: i for i, t in enumerate(texts)}.values())
    toxic = np.asarray(toxic).astype(np.int64)[once]
    words, counts = word_hashes([texts[i] for i in once])
    docs = np.repeat(np.arange(len(once)), counts)
    pair, before = _pairs(words, counts)
    keys, first, place = np.unique(pair, return_index=True, return_inverse=True)
    word_of, context_of = words[first], before[first]
    # Each class's documents of a pair, and of a word.
    in_doc = np.unique(place * len(once) + docs)
    own_pair, cls = in_doc // len(once), toxic[in_doc % len(once)]
    count = np.stack([np.bincount(own_pair[cls == c], minlength=len(keys)) for c in (0, 1)]).astype(np.float64)
    vocab, w_place = np.unique(word_of, return_inverse=True)
    in_doc = np.unique(w_place[place] * len(once) + docs)
    own_word, cls = in_doc // len(once), toxic[in_doc % len(once)]
    alone = np.stack([np.bincount(own_word[cls == c], minlength=len(vocab)) for c in (0, 1)]).astype(np.float64)
    # Shared continuation counts, then each class's words.
    shared = np.bincount(w_place, minlength=len(vocab)).astype(np.float64)
    new = 1 / (shared.sum() + 1)
    shared *= (1 - new) / max(shared.sum(), 1)
    sums = np.maximum(alone.sum(axis=1, keepdims=True), 1)
    own = _discounted(alone, sums / sums.sum()) / sums
    rest = 1 - own.sum(axis=1, keepdims=True)
    low = own + rest * shared
    # Pairs: what is expected is how the second word alone is split, its rate
    # in each class being that of the lower order.
    split = low * sums
    split = (split / split.sum(axis=0))[:, w_place]
    contexts, c_place = np.unique(context_of, return_inverse=True)
    total = np.stack([np.bincount(c_place, c, minlength=len(contexts)) for c in count])
    taken = _discounted(count, split) / np.maximum(total[:, c_place], 1)
    back = 1 - np.stack([np.bincount(c_place, t, minlength=len(contexts)) for t in taken])
    high = taken + back[:, c_place] * low[:, w_place]
    ratio = lambda p: np.log(p[1]) - np.log(p[0])
    # Words and pairs that come out as any other would are left out.
    seen, strong, kept = own.any(axis=0), np.abs(ratio(back)) > 0, taken.any(axis=0)
    return Ratios(vocab[seen], ratio(low)[seen], float(ratio(rest[:, 0])), contexts[strong], ratio(back)[strong], keys[kept], ratio(high)[kept])


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps with a slight pull to 0."""
    scale = x.std() or 1.0
    mid = x.mean()
    z = (x - mid) / scale
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 1e-2 * a, (p - y).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return a / scale, b - a * mid / scale


def train(texts: list[bytes], labels: list[int]) -> tuple[Ratios | None, float, float]:
    """(ratios, slope, intercept). The slope is fitted on texts that the ratios
    of their fold have not seen. With one class only, no ratios and the
    smoothed share of labels."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2 or min(y.sum(), len(y) - y.sum()) < FOLDS:
        share = (y.sum() + 1) / (len(y) + 2)
        return None, 0.0, float(np.log(share / (1 - share)))
    fold = np.zeros(len(y), dtype=np.int64)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    x = np.zeros(len(y))
    for k in range(FOLDS):
        inner = [t for t, f in zip(texts, fold) if f != k]
        x[fold == k] = fit(inner, y[fold != k]).means([t for t, f in zip(texts, fold) if f == k])
    return fit(texts, y), *calibrate(x, y)


def score(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", rows: int = SAMPLE_ROWS, seed: int = 13) -> DataFrame:
    """Return ``docs`` with ``score`` (double, 0 to 1: how likely the label is
    1) and ``predicted`` (int).

    Models are fitted on at most ``rows`` labelled documents for which
    ``usable`` (an expression over doc_id) holds, and see their text alone.
    Whole texts are scored, by log-likelihood ratio per word. Null and wordless
    texts have ratio 0, and when only one class was labelled all texts get the
    share of labels; rows with null or repeated ids are scored like others;
    columns named ``score`` or ``predicted`` are replaced. Nothing is shuffled
    to score: the ratios, bounded by the sample, go to every executor.
    """
    sample = labelled_sample(docs, labels, label, usable, rows, seed)
    ratios, slope, intercept = train([t.encode() for t, _ in sample], [int(y > 0) for _, y in sample])
    arrays = {f.name: getattr(ratios, f.name) for f in fields(Ratios)} if ratios else None
    shared = docs.sparkSession.sparkContext.broadcast((arrays, slope, intercept))

    def odds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        arrays, slope, intercept = shared.value
        own = Ratios(**arrays) if arrays else None
        for s in batches:
            parts = [own.means(c) for c in _chunks(s.tolist())] if own else [np.zeros(len(s))]
            x = np.concatenate(parts) if parts else np.empty(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30))))

    udf = F.pandas_udf(odds, T.DoubleType(), functionType=F.PandasUDFType.SCALAR_ITER)
    columns = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*columns, udf(F.col("text").cast("string")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
