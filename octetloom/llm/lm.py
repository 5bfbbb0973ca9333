"""Language-model scores of documents."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmodel import Code, Learner, Model, Predictor, Shape, add_part, bytes_of, finish_part, words_in
from .common import materialize, unclashing

#: Most words that have a symbol of their own and go to every executor; the
#: counts of the others are joined.
COMMON_WORDS = 100_000
#: Distinct words that a task gathers before it passes their counts on.
GATHERED_WORDS = 150_000
#: Most frequent words, one of which is each text's hub.
HUBS = 31
#: Words before that are a context by themselves, and classes of the others by their last two bytes.
BEFORE, ENDINGS = 4096, 4096
#: Slots (a power of two) of the predictor by the word before: as many as
#: training tokens, between these bounds.
LEAST_BITS, MOST_BITS = 12, 21
#: Bytes of texts, and number of words to spell, that one learner takes.
SHARD_BYTES, SHARD_WORDS = 16 << 20, 200_000
#: Characters of texts that are scored together.
TOGETHER = 1_000_000
#: Bytes before a byte that predict it in a word, and bits of the slots.
ORDERS, SPELLING_BITS = (2, 3, 5), (18, 20, 20)
MARK = b"\n"  # begins and ends a word; no word holds it


class Reader:
    """Turns texts into symbols: common words by frequency, one symbol for all
    rare ones, and the text's end."""

    def __init__(self, common: list[tuple[bytes, int]], rare: int, texts: int, bits: int):
        self.common = pa.array([w for w, _ in common], pa.binary())
        self.rare, self.end = len(common), len(common) + 1
        n = np.array([n for _, n in common], dtype=np.float64)
        self.base = np.log10(np.concatenate([n + 1, [1, texts + 1]]))
        self.after = np.array([i if i < BEFORE else _ending(w) for i, (w, _) in enumerate(common)] + [0, 0], dtype=np.int32)
        code = Code([n for _, n in common] + [max(rare, 1), max(texts, 1)])
        self.words = Shape(code, [Predictor(contexts=HUBS + 1), Predictor(bits=bits), Predictor(bits=bits)])
        seen = Counter(MARK * max(len(common), 1))
        for w, _ in common:
            seen.update(w)
        self.letters = Shape(Code([1 + seen[b] for b in range(256)]), [Predictor(bits=b) for b in SPELLING_BITS])

    def read(self, each: np.ndarray, words: pa.Array) -> tuple[tuple, np.ndarray, np.ndarray, pa.Array]:
        """((symbols, contexts, key), text of each symbol, hub of each text, rare
        words in order) of texts with so many of these words each."""
        texts, sizes = len(each), each + 1
        ends = sizes.cumsum() - 1
        symbols = np.full(int(sizes.sum()), self.end, dtype=np.int32)
        inner = np.ones(len(symbols), dtype=bool)
        inner[ends] = False
        which = pc.index_in(words, value_set=self.common)
        symbols[inner] = which.fill_null(self.rare).to_numpy()
        own = np.repeat(np.arange(texts, dtype=np.int32), sizes)
        rare = words.filter(which.is_null())
        after = self.after[symbols]
        after[symbols == self.rare] = _endings(rare)
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[ends - sizes + 1] = BEFORE + ENDINGS
        some = symbols < min(HUBS, self.rare)
        often = np.bincount(own[some] * HUBS + symbols[some], minlength=texts * HUBS).reshape(-1, HUBS)
        hub = np.where(often.any(axis=1), often.argmax(axis=1), HUBS).astype(np.int32)
        hubs = hub[own]
        key = (hubs * np.int64(self.end + 1) + symbols) * (BEFORE + ENDINGS + 1) + before
        return (symbols, [hubs, before, before * (HUBS + 1) + hubs], key), own, hub, rare

    @staticmethod
    def spelled(words: pa.Array) -> tuple[tuple, np.ndarray]:
        """((bytes with the mark behind each word, contexts, key), word of each byte)."""
        pad = max(ORDERS)
        letters, starts = bytes_of(words)
        sizes = np.diff(starts) + 1
        own = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(own)) + pad * (own + 1)
        inner = np.ones(len(own), dtype=bool)
        inner[sizes.cumsum() - 1] = False
        data = np.full(len(own) + pad * len(words), ord(MARK), dtype=np.int64)
        data[at[inner]] = letters
        value, contexts = np.zeros_like(at), []
        for back in range(1, pad + 1):
            value = (value << 8) | data[at - back]
            if back in ORDERS:
                contexts.append(value)
        return (data[at], contexts, (value << 8) | data[at]), own


class _Endings(dict):
    """The class of a word's last two bytes, remembered: there are 65,792 at most."""

    def __missing__(self, last: bytes) -> int:
        got = self[last] = BEFORE + zlib.crc32(last) % ENDINGS
        return got


_ENDINGS = _Endings()


def _ending(word: bytes) -> int:
    return _ENDINGS[word[-2:]]


def _endings(words: pa.Array) -> np.ndarray:
    """``_ending`` of each word."""
    data, at = bytes_of(words)
    last = data[at[1:] - 1].astype(np.int32)
    long = np.flatnonzero(np.diff(at) > 1)
    last[long] += (data[at[1:][long] - 2].astype(np.int32) + 1) << 8
    some, which = np.unique(last, return_inverse=True)
    return np.array([_ENDINGS[bytes([x]) if x < 256 else (x - 256).to_bytes(2)] for x in some.tolist()], dtype=np.int32)[which]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they come in texts that are not held out (0: never)."""
    gathered: list[pa.Table] = []
    for b in batches:
        for some in _chunks(b):
            each, words = words_in(some["text"])
            words = words.dictionary_encode()
            learnt = np.repeat(~some["held_out"].to_numpy(zero_copy_only=False), each)
            n = np.bincount(words.indices.to_numpy()[learnt], minlength=len(words.dictionary))
            gathered.append(pa.table({"word": words.dictionary, "n": pa.array(n, pa.int64())}))
            if sum(map(len, gathered)) > 2 * GATHERED_WORDS:
                gathered = [_added(gathered)]
                if len(gathered[0]) > GATHERED_WORDS:
                    yield from gathered.pop().to_batches()
    if gathered:
        yield from _added(gathered).to_batches()


def _added(counts: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return added.rename_columns({"n_sum": "n"}).select(["word", "n"])


def _chunks(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have TOGETHER characters or a little more."""
    ends = (pc.utf8_length(rows["text"]).fill_null(0).to_numpy().astype(np.int64) + 1).cumsum()
    at = 0
    while at < len(ends):
        cut = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER)) + 1
        yield rows.slice(at, cut - at)
        at = cut


PARTS = "model int, part int, data binary"


def _parts(model: int, learner: Learner, hubs: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    def out(number: int, data: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([model], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary())], ["model", "part", "data"])

    for number, data in learner.parts():
        yield out(number, data)
    if hubs is not None and hubs.any():
        yield out(-3, hubs.tobytes())


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(shard, rows of it), of rows in order of their shards."""
    for b in batches:
        shard = b["shard"].to_numpy()
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        for i, j in zip(starts, [*starts[1:], len(shard)]):
            yield shard[i], b.slice(i, j - i)


def _learn_words(shared):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shard = shared.value, None
        learner = hubs = None
        for number, rows in _by_shard(batches):
            if number != shard:
                if learner:
                    yield from _parts(0, learner, hubs)
                shard, learner, hubs = number, Learner(reader.words), np.zeros(HUBS + 1, dtype=np.int64)
            for some in _chunks(rows):
                seen, _, hub, _ = reader.read(*words_in(some["text"]))
                hubs += np.bincount(hub, minlength=HUBS + 1)
                learner.add(*seen)
        if learner:
            yield from _parts(0, learner, hubs)

    return learn


def _learn_spelling(shared):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = learner = None
        for number, rows in _by_shard(batches):
            if number != shard:
                if learner:
                    yield from _parts(1, learner)
                shard, learner = number, Learner(shared.value.letters)
            learner.add(*Reader.spelled(rows["word"])[0])
        if learner:
            yield from _parts(1, learner)

    return learn


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up parts that come in order of their numbers, one at a time."""
    def out() -> pd.DataFrame:
        return pd.DataFrame({"model": [key[0]], "part": [key[1]], "data": [finish_part(key[1], total)]})

    key, total = None, None
    for b in batches:
        for m, k, data in zip(b["model"], b["part"], b["data"]):
            if (m, k) != key and total is not None:
                yield out()
                total = None
            key, total = (m, k), add_part(total, k, data)
    if total is not None:
        yield out()


def _sharded(rows: DataFrame, size: int, largest: int, *by: str) -> DataFrame:
    """``rows`` dealt by their hash to so many shards that each has about
    ``largest`` of ``size``, in an order of their own."""
    shards = max(1, -(-size // largest))
    key = F.xxhash64(*by)
    dealt = rows.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int"))
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", key, *by)


def train(learning: DataFrame, size: int, words: DataFrame, number: int, shared) -> dict[tuple[int, int], bytes]:
    """The models of all texts (doc_id, text; ``size`` bytes) and of the spelling
    of all their distinct words (``number``). Learners take fixed shards of them, in a fixed order, so the result
    does not depend on partitions; counts, weights (by what they were learnt
    on) and maps are then added up, slice by slice."""
    texts = _sharded(learning, size, SHARD_BYTES, "doc_id", "text").select("shard", "text")
    spelt = _sharded(words, number, SHARD_WORDS, "word").select("shard", "word")
    learnt = texts.mapInArrow(_learn_words(shared), PARTS).unionByName(spelt.mapInArrow(_learn_spelling(shared), PARTS))
    # Sums of weights are of floats, so their order is fixed too.
    merged = learnt.repartition("model", "part").sortWithinPartitions("model", "part", "data").mapInPandas(_merge, PARTS)
    return {(r["model"], r["part"]): bytes(r["data"]) for r in merged.toLocalIterator()}


class Scorer:
    """Log10 probabilities of texts, but for what counts tell of rare words."""

    def __init__(self, reader: Reader, parts: dict[tuple[int, int], bytes]):
        self.reader = reader
        self.words, self.letters = (Model(shape, {k: v for (m, k), v in parts.items() if m == i}) for i, shape in enumerate((reader.words, reader.letters)))
        hubs = np.frombuffer(parts.get((0, -3), bytes(8 * (HUBS + 1))), dtype=np.int64)
        self.hub = np.log10((hubs + 1) / (hubs.sum() + HUBS + 1))

    def spelling(self, words: pa.Array) -> np.ndarray:
        """Log10 probabilities of the words' bytes."""
        letters, word = self.reader.spelled(words)
        return np.bincount(word, self.letters.logs(*letters), minlength=len(words))

    def measure(self, each: np.ndarray, words: pa.Array) -> dict[str, pa.Array]:
        """For each of the texts with so many of these words: its common words and
        their sum of log10 counts; log10 of the text's probability but for which
        rare words it has; and these words and how often they come."""
        read, own, hub, rare = self.reader.read(each, words)
        (symbols, contexts, _), n = read, len(each)
        # In order of the contexts, as the hashed slots of a context lie far from those of others.
        key = contexts[-1] * np.int64(self.reader.end + 1) + symbols
        logs = np.bincount(own, self.words.logs(symbols, contexts, key), minlength=n) + self.hub[hub]
        known = symbols != self.reader.rare
        base = np.bincount(own[known], self.reader.base[symbols[known]], minlength=n)
        rare = rare.dictionary_encode()
        many = max(1, len(rare.dictionary))
        pair, often = np.unique(own[~known].astype(np.int64) * many + rare.indices.to_numpy(), return_counts=True)
        cut = pa.array(np.searchsorted(pair, np.arange(n + 1) * many), pa.int32())
        return {
            "sure": pa.array(np.bincount(own[known], minlength=n) - 1, pa.int64()), "base": pa.array(base), "log": pa.array(logs),
            "rare": pa.ListArray.from_arrays(cut, rare.dictionary.take(pa.array(pair % many))),
            "rare_n": pa.ListArray.from_arrays(cut, pa.array(often, pa.int32())),
        }


#: The scorer that this worker used last.
_last: tuple[str, Scorer] | None = None


def _scorer(name: str, shared, trained) -> Scorer:
    global _last
    if _last is None or _last[0] != name:
        _last = name, Scorer(shared.value, trained.value)
    return _last[1]


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Return (doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte) of every row of ``docs``, learning from rows not
    ``held_out`` (an expression over doc_id; null counts as not held out).

    Tokens are words (A-Z lower-cased) and one end a text. ``base_score`` is the
    add-one unigram log10 probability; ``score`` is that of online logistic
    context mixing over the text's words with single spaces between and an end,
    ``bits_per_byte`` the same in bits a byte of these.

    Words are spelled in the bits of a Huffman code. Each bit is predicted from
    the bits before it and a context: the text's hub (its most frequent word among
    the HUBS most frequent of all; it is coded first), the word before, and both.
    Log odds are combined by weights gated by depth and
    experience, then refined by an adaptive map. Words that come once, or are
    not among the COMMON_WORDS most frequent, share a symbol. Behind it a rare
    word is drawn from the exact counts of all rare words, or is new and
    spelled in bits of bytes, by the last bytes, in the same way; new ones have
    the probability that words seen once have among the rare.

    Learners take all rows, in fixed shards by hash, and predict each block
    before it is counted; scores do not depend on partitions or on other rows
    that are scored. Null and empty texts are their end alone; rows with
    repeated ids are scored row by row; with nothing to learn from, counts are
    0; an empty table gives an empty result; other columns are ignored.

    What is broadcast is bounded: COMMON_WORDS words and the slots' log odds
    (at most 35 MB). Less common words are joined with their counts: one row
    for each of them in each document.
    """
    spark = docs.sparkSession
    rows = unclashing(docs, ["held_out"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    learning = rows.where(~F.col("held_out")).select("doc_id", "text")
    # Words of held-out texts alone count 0.
    counts = materialize(rows.select("text", "held_out").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    seen = learning.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    # The least count that COMMON_WORDS words reach or pass, from a histogram by powers of 2**(1/4).
    step = F.floor(4 * F.log2("n"))
    steps = counts.where("n > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    bound, room = None, COMMON_WORDS
    for r in steps:
        if r["words"] > room or not r["step"]:
            break
        bound, room = r["step"], room - r["words"]
    few = F.lit(True) if bound is None else (F.col("n") == 0) | (step < bound)
    common = [] if bound is None else sorted(((bytes(r["word"]), r["n"]) for r in counts.where(~few).toLocalIterator()), key=lambda x: (-x[1], x[0]))
    rest = [r for r in steps if bound is None or r["step"] < bound]
    rare_n = sum(r["n"] for r in rest)
    once = sum(r["words"] for r in rest if not r["step"])
    total, distinct_words = sum(r["n"] for r in steps) + seen["texts"], sum(r["words"] for r in steps) + (seen["texts"] > 0)
    bits = min(max(int(total).bit_length(), LEAST_BITS), MOST_BITS)
    shared = spark.sparkContext.broadcast(Reader(common, rare_n, seen["texts"], bits))
    trained = spark.sparkContext.broadcast(train(learning, seen["size"], counts.where("n > 0").select("word"), sum(r["words"] for r in steps), shared))
    name = uuid.uuid4().hex

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared, trained)
        for b in batches:
            for some in _chunks(b):
                each, words = words_in(some["text"])
                size = np.diff(bytes_of(words)[1][np.concatenate([[0], each.cumsum()])])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": some["doc_id"], "held_out": some["held_out"],
                    "n_tokens": pa.array(each + 1, pa.int64()), "n_bytes": pa.array(size + np.maximum(each, 1), pa.int64()),
                    **scorer.measure(each, words),
                })

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared, trained)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"word": b["word"], "n": b["n"], "s": pa.array(scorer.spelling(b["word"]))})

    measured = rows.mapInArrow(
        measure, "doc_id long, held_out boolean, n_tokens long, n_bytes long, sure long, base double, log double, rare array<binary>, rare_n array<int>"
    ).withColumn("row", F.monotonically_increasing_id())
    measured = materialize(measured, "measured")  # from here on a row's number is fixed
    new = (once + 1) / (rare_n + 2)  # of the rare, the share of new ones
    spelled = F.col("s") + F.lit(float(np.log10(new)))
    drawn = F.log10(F.col("n") * F.lit((1 - new) / max(rare_n, 1)))
    both = F.greatest(spelled, drawn) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(spelled - drawn)))
    words = counts.where(few).mapInArrow(spell, "word binary, n long, s double").select("word", "n", F.when(F.col("n") == 0, spelled).otherwise(both).alias("s"))
    zipped = measured.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
    more = zipped.select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("k")).join(words, "word").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("too"),
        F.sum(F.col("k") * F.col("s")).alias("rare_score"),
    )
    out = measured.drop("rare", "rare_n").join(more, "row", "left")
    texts_known = int(seen["texts"] > 0)
    full = F.col("log") + F.coalesce("rare_score", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("sure") + F.coalesce("too", F.lit(0)) + F.lit(texts_known)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct_words + 1)))).alias("base_score"),
        full.alias("score"),
        (-full / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
