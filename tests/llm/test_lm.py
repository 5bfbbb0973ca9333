import heapq
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from octetloom.llm import bitmodel, lm
from octetloom.llm.bitmodel import Code, Learner, Model, Predictor, Shape, add_part, finish_part, words_of
from octetloom.llm.queries import op6_lm


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def base_rows(docs):
    train = [words_of(t) for i, t in docs if not held(i)]
    c = Counter(w for t in train for w in t)
    c[None] = len(train)
    n, v = sum(c.values()), sum(x > 0 for x in c.values())
    for i, t in docs:
        tokens = [*words_of(t), None]
        yield i, len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in op6_lm(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, tokens, known, n, base in base_rows(docs):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        size = sum(len(w) for w in words_of(docs[i][1])) + max(tokens - 1, 1)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / size)


def paths(weights):
    """Huffman's code by pairs of trees: symbol -> [(node, bit)]."""
    heap = [(w, i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    n = len(weights)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, n, (n - len(weights), x, y)))
        n += 1
    out = {}

    def walk(tree, path):
        if isinstance(tree, int):
            out[tree] = path
        else:
            walk(tree[1], path + [(tree[0], 0)])
            walk(tree[2], path + [(tree[0], 1)])

    walk(heap[0][2], [])
    return out


def hashed(context, node, bits):
    mask = (1 << 32) - 1
    a, b = (int(x) for x in bitmodel._ODD_32)
    h = (((context + 1) * int(bitmodel._ODD)) & ((1 << 64) - 1)) >> 32
    h ^= (node * b) & mask
    h = ((h ^ (h >> 15)) * a) & mask
    return h >> (32 - bits)


class Plain:
    """A model of so few symbols that all are one block: weights stay as they
    begin, and the map learns at even odds only."""

    def __init__(self, weights, slots):
        self.code, self.slots, self.counts, self.even = paths(weights), slots, defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])

    def learn(self, symbol, contexts):
        for depth, (node, bit) in enumerate(self.code[symbol]):
            for k, c in enumerate(contexts):
                self.counts[k, self.slots[k](c, node)][bit] += 1

    def learn_even(self, rows):
        for symbol, contexts in set(rows):
            for depth, (_, bit) in enumerate(self.code[symbol]):
                self.even[min(depth, bitmodel.DEPTHS - 1)][bit] += 1

    def log10(self, symbol, contexts):
        total = 0
        for depth, (node, bit) in enumerate(self.code[symbol]):
            seen = [self.counts.get((k, self.slots[k](c, node)), [0, 0]) for k, c in enumerate(contexts)]
            dot = sum(1.2 / len(seen) * math.log((one + 0.4) / (zero + 0.4)) for zero, one in seen)
            level = sum(x <= sum(seen[-1]) for x in bitmodel.LEVELS)
            step = min(max(int(dot * 1.5 + bitmodel.STEPS // 2 + 0.5), 0), bitmodel.STEPS - 1)
            start = 1 / (1 + math.exp(-(step - bitmodel.STEPS // 2) / 1.5))
            zero, one = self.even[min(depth, bitmodel.DEPTHS - 1)] if level == 0 and step == bitmodel.STEPS // 2 else (0, 0)
            p = (1 / (1 + math.exp(-dot)) + (one + 8 * start) / (zero + one + 8)) / 2
            total += math.log10(p if bit else 1 - p)
        return total


def test_score_matches_brute_force(spark):
    texts = ["the cat sat on the mat", "The dog sat on a log", "", "a cat and a dog", "rare birds sat", "the end the end"]
    new = ["the cat sat", "a rare fish", "fish fish on the log", None]
    docs = [(i, t) for i, t in enumerate(texts + new)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") >= len(texts)).collect()}

    count = Counter(w for t in texts for w in words_of(t))
    common = sorted((w for w in count if count[w] > 1), key=lambda w: (-count[w], w))
    rare = [w for w in count if count[w] == 1]
    number = {w: i for i, w in enumerate(common)}
    ending = lambda w: lm.BEFORE + zlib.crc32(w[-2:]) % lm.ENDINGS

    def rows(t):
        words = words_of(t)
        hub = max(range(len(common)), key=lambda i: (sum(w == common[i] for w in words), -i)) if any(w in number for w in words) else lm.HUBS
        before = lm.BEFORE + lm.ENDINGS
        out = []
        for w in [*words, None]:
            out.append((len(common) + 1 if w is None else number.get(w, len(common)), (hub, before, before * (lm.HUBS + 1) + hub)))
            before = None if w is None else number.get(w, ending(w))
        return hub, out

    tokens = sum(count.values()) + len(texts)
    bits = max(tokens.bit_length(), lm.LEAST_BITS)
    model = Plain([count[w] for w in common] + [len(rare), len(texts)], [lambda c, n: (c, n), lambda c, n: hashed(c, n, bits), lambda c, n: hashed(c, n, bits)])
    hubs, all_rows = Counter(), []
    for t in texts:
        hub, r = rows(t)
        hubs[hub] += 1
        all_rows += r
        for symbol, contexts in r:
            model.learn(symbol, contexts)
    model.learn_even(all_rows)

    bytes_seen = Counter(b"\n" * len(common) + b"".join(common))
    letters = Plain([1 + bytes_seen[b] for b in range(256)], [lambda c, n, k=k: hashed(c, n, k) for k in lm.SPELLING_BITS])

    def spelled(w):
        past = b"\n" * 5 + w
        return [(b, tuple(int.from_bytes(past[i + 5 - o : i + 5], "little") for o in lm.ORDERS)) for i, b in enumerate(w + b"\n")]

    letter_rows = [x for w in count for x in spelled(w)]
    for symbol, contexts in letter_rows:
        letters.learn(symbol, contexts)
    letters.learn_even(letter_rows)

    share = (len(rare) + 1) / (len(rare) + 2)
    for i, t in docs:
        hub, r = rows(t)
        want = math.log10((hubs[hub] + 1) / (len(texts) + lm.HUBS + 1)) + sum(model.log10(s, c) for s, c in r)
        for w in words_of(t):
            if w not in number:
                p = share * 10 ** sum(letters.log10(s, c) for s, c in spelled(w))
                want += math.log10(p + (1 - share) * count[w] / len(rare))
        assert got[i]["score"] == pytest.approx(want, rel=2e-3), t


def test_scores_do_not_depend_on_partitions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 100_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = ({r["doc_id"]: r["score"] for r in lm.score(docs.repartition(n), F.col("doc_id") % 7 == 2).collect()} for n in (1, 8))
    assert a.keys() == b.keys()
    assert all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a)


def trained(shape, symbols, contexts):
    learner = Learner(shape)
    key = symbols
    for c in contexts:
        key = key * (c.max() + 1) + c
    learner.add(symbols, contexts, key)
    return learner, Model(shape, {k: finish_part(k, add_part(None, k, x)) for k, x in learner.parts()})


def test_probabilities_sum_to_one_and_blocks_move_the_weights():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 4, 40_000) * 2 + (np.arange(40_000) % 2)  # odd and even in turn
    before = np.concatenate([[8], symbols[:-1]])
    shape = Shape(Code([1] * 8), [Predictor(contexts=1), Predictor(bits=12)])
    learner, model = trained(shape, symbols, [symbols * 0, before])
    assert learner.mixed > 0 and not np.allclose(learner.weights, 0.6)
    every = np.arange(8)
    logs = model.logs(every, [every * 0, every * 0 + 4], every)
    assert (10**logs).sum() == pytest.approx(1, abs=1e-4)
    assert (10 ** logs[1::2]).sum() > 0.98  # behind an even one


def test_every_block_counts_and_is_mixed():
    shape = Shape(Code([3, 2, 1]), [Predictor(bits=12)])
    for n in (1, 5, bitmodel.FIRST_BLOCK + 1, 3 * bitmodel.FIRST_BLOCK):
        symbols = np.arange(n) % 3
        learner, _ = trained(shape, symbols, [np.zeros(n, dtype=np.int64)])
        seen = learner.counts.view(np.uint32).sum()
        assert seen == shape.code.size[symbols].sum()
        assert learner.mixed >= shape.code.size[np.unique(symbols)].sum()


def test_known_words_score_above_the_base(spark):
    """Held-out texts of known words, each in one of two vocabularies."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'ab'[i % 2]}{n}" for n in rng.zipf(1.3, 60) if n < 200) for i in range(1500)]
    rows = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") % 7 == 2).where("held_out")
    score, base, tokens = rows.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (score - base) / tokens > 0.15


def test_odd_rows(spark):
    schema = "doc_id long, text string, score string, word string"
    none = F.col("doc_id") < 0
    assert lm.score(spark.createDataFrame([], schema), none).count() == 0
    rows = lm.score(spark.createDataFrame([(None, None, "x", "y"), (1, "", "x", "y"), (1, "", "x", "y"), (2, "w " * 50000, "x", "y"), (3, "v" * 100_000, "x", "y")], schema), none).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 1, 2, 50001]
    assert all(r["train_tokens"] == 50006 and r["n_known"] == r["n_tokens"] and math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    nothing = lm.score(spark.createDataFrame([(1, "a b", "", "")], schema), F.lit(True)).first()
    assert (nothing["n_known"], nothing["train_tokens"], nothing["base_score"]) == (0, 0, 0.0)
    assert math.isfinite(nothing["score"])


def test_quick_lookups_equal_plain_ones():
    rng = np.random.default_rng(6)
    table, index = rng.random(500), rng.integers(0, 500, 4000).astype(np.int32)
    assert (bitmodel._at(table, index) == table[index]).all()
    for seen in (np.arange(900, dtype=np.uint32), np.array([0, 200, 1 << 31, (1 << 32) - 1], dtype=np.uint32), np.array([7, 1 << 40])):
        assert (bitmodel._level(seen) == np.searchsorted(bitmodel.LEVELS, seen, side="right")).all()
    some = np.sort(rng.choice(bitmodel.SLICE, 9000, replace=False))
    counts = np.minimum(rng.zipf(1.5, (9000, 2)), 1 << 30).astype(np.uint32)
    at, got = bitmodel._unpacked(bitmodel._packed(some, counts))
    assert (at == some).all() and (got == counts).all()
    # The map counts each bit where its log odds put it, zeros and ones apart.
    learner = Learner(Shape(Code([3, 2, 1]), [Predictor(contexts=1)]))
    learner.add(rng.integers(0, 3, 5000), [np.zeros(5000, dtype=np.int64)], np.arange(5000))
    learner.flush()
    assert learner.map.shape == (2, bitmodel.GATES * bitmodel.STEPS) and learner.map.flags.writeable
    assert (learner.map >= 0).all() and learner.map.sum() == learner.mixed
    assert lm._ENDINGS[b"ab"] == lm._ending(b"crab") == lm.BEFORE + zlib.crc32(b"ab") % lm.ENDINGS


def test_words_of_arrays_equal_those_of_texts():
    odd = ["", None, " ", "a", " A  b\tC\x0b\x0cd\r\n", "b", "Ä\x85Z \x1c\x1dx", " é É x", "[@`{AZaz", "end ", "\x08\x0e \x00", "\U0001f600"]
    for texts in (pa.array(odd), pa.array(odd, pa.large_string()), pa.array(["X y", *odd, "z"]).slice(1, len(odd)), pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        each, words = bitmodel.words_in(texts)
        want = [words_of(t) for t in texts.to_pylist()]
        assert each.tolist() == [len(w) for w in want]
        assert words.to_pylist() == [w for t in want for w in t]
        assert lm._endings(words).tolist() == [lm._ending(w) for t in want for w in t]
        letters, own = lm.Reader.spelled(words)
        assert bytes(letters[0].tolist()) == b"".join(w + lm.MARK for t in want for w in t)
        assert np.bincount(own, minlength=len(words)).tolist() == [len(w) + 1 for t in want for w in t]


def test_word_counts_and_chunks_are_whole(monkeypatch):
    monkeypatch.setattr(lm, "GATHERED_WORDS", 20)
    monkeypatch.setattr(lm, "TOGETHER", 30)
    rng = np.random.default_rng(7)
    texts = [None if i % 9 == 0 else " ".join(f"W{n}" for n in rng.zipf(1.4, i % 13)) for i in range(300)]
    rows = pa.record_batch({"text": pa.array(texts, pa.string()), "held_out": pa.array([i % 7 == 2 for i in range(300)])})
    assert [t for some in lm._chunks(rows) for t in some["text"].to_pylist()] == texts
    assert all(sum(len(t or "") + 1 for t in some["text"].to_pylist()[:-1]) < 30 for some in lm._chunks(rows))
    got, want = Counter(), Counter()
    for b in lm._word_counts(iter([rows.slice(0, 120), rows.slice(120, 0), rows.slice(120)])):
        for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist()):
            got[w] += n
    for i, t in enumerate(texts):
        for w in words_of(t):
            want[w] += i % 7 != 2
    assert got == want and set(got) == set(want)
