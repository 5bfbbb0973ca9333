import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from octetloom.llm import packing
from octetloom.llm.queries import op2_pack
from octetloom.llm.word_bpe import Encoder

PATH = packing.default_tokenizer()


def test_encoder_equals_the_library():
    slow, fast = Tokenizer.from_file(PATH), Encoder(PATH)
    random.seed(2)
    parts = ["the", "ing", "'s", "'re", "St", "ß", "'LL", "İ", "́", "　", "中", "😀", "<|endoftext|>", "\x1c", "\xa0", "Σ", " ", "\n", "12", "!?", "é"]
    texts = ["", " ", "Hello, WORLD!", "x'll don't 3rd"] + ["".join(random.choice(parts) for _ in range(random.randint(1, 9))) for _ in range(3000)]
    texts += ["".join(chr(random.randint(0x21, 0x12F)) for _ in range(8)) for _ in range(3000)]
    for t, e in zip(texts, slow.encode_batch(texts, add_special_tokens=False)):
        assert fast.encode(t) == np.array(e.ids, dtype="<u4").tobytes(), t


def test_fullest_combination_is_found():
    random.seed(1)
    for _ in range(200):
        counts = dict(Counter(random.randint(1, 30) for _ in range(random.randint(1, 9))))
        room = random.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
        combo = packing._fullest(sorted(counts, reverse=True), counts, room)
        assert sum(k * c for k, c in combo) == max(sums)
        assert all(c <= counts[k] for k, c in combo)


def test_bins_hold_everything_once():
    random.seed(3)
    counts = Counter(random.randint(1, 100) for _ in range(5000))
    bins = packing.minimum_bin_slack(dict(counts), 100)
    used = Counter()
    for times, combo in bins:
        assert sum(k * c for k, c in combo) <= 100
        for k, c in combo:
            used[k] += c * times
    assert used == counts
    # No packing needs fewer than the tokens fill, or than there are pieces over half a bin.
    least = max(-(-sum(k * v for k, v in counts.items()) // 100), sum(v for k, v in counts.items() if k > 50))
    assert sum(t for t, _ in bins) <= least * 1.005


def check(rows, texts, capacity):
    slow = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    for i, t in texts.items():
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        parts = sorted(got[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in parts] == [
            (k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))
        ]
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_pack(spark, sf_dir).collect()
    n = check(rows, texts, 4096)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_odd_rows(spark):
    schema = "doc_id long, text string, piece int, length string, _rank long"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, None, 1, "x", 2), (1, "", 1, "x", 2), (2, "ab " * 30000, 1, "x", 2)], schema), capacity=64).collect()
    check(rows, {None: None, 1: "", 2: "ab " * 30000}, 64)
    same = packing.pack(spark.createDataFrame([(1, "a b", 0, "", 0)] * 3, schema)).collect()
    assert sorted(r["offset"] for r in same) == [0, 3, 6]


@pytest.mark.parametrize("capacity", [1, 7])
def test_layout_places_ranks(capacity):
    counts = {1: 20, 3: 5, 7: 2} if capacity == 7 else {1: 5}
    runs = packing.layout(packing.minimum_bin_slack(counts, capacity))
    for length, n in counts.items():
        run = runs[length]
        assert run["rank"][0] == 0 and all(np.diff(run["rank"]) > 0) and run["rank"][-1] < n
