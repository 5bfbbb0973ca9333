import hashlib

import pytest

from octetloom.llm import chunking as C
from octetloom.llm.queries import op4_fingerprint


def brute(text, nxt):
    n = len(text)
    k = n // 4
    edited = (text[: n - k] + nxt[:k]).encode()
    own, other, following = (C.chunk_weights(d, C.chunk_ends(d)) for d in (text.encode(), edited, nxt.encode()))
    return n, hashlib.sha256(edited).hexdigest(), C.encode(own), C.encode(other), C.containment(own, other), C.containment(own, following)


def fields(r):
    return r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]


def test_chunks_cover_the_text_within_bounds():
    for text in ("", "a", "x" * 5000, "some words and more words é " * 300):
        data = text.encode()
        ends = C.chunk_ends(data)
        assert (ends[-1] if ends else 0) == len(data)
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert all(0 < s <= C.MOST for s in sizes) and all(s >= C.LEAST for s in sizes[:-1])
        assert sum(C.chunk_weights(data, ends).values()) == len(data)


def test_rolling_hash_is_the_sum_it_claims():
    data = bytes(range(256)) + b"hello" * 20
    gear, h = C._gear(), C._rolled(data)
    for i in (0, 5, 31, 32, 100, 300):
        want = sum(int(gear[data[i - k]]) << k for k in range(min(32, i + 1))) % 2**32
        assert int(h[i]) == want


def test_shifted_text_keeps_its_chunks():
    text = " ".join(f"word{i * 7919 % 1000} and" for i in range(800)).encode()
    a = C.chunk_weights(text, C.chunk_ends(text))
    b = C.chunk_weights(b"new head " + text, C.chunk_ends(b"new head " + text))
    assert C.containment(a, b) > 0.97


def test_query(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in op4_fingerprint(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, text), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        assert fields(got[i]) == brute(text, nxt), i


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE_ROWS", 3)
    docs = [(i * i, f"text number {i} " * (i + 1)) for i in range(100)]
    got = {r["doc_id"]: r for r in C.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for (i, text), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        assert fields(got[i]) == brute(text, nxt)


def test_odd_rows(spark):
    schema = "doc_id long, text string, n_chars string, fingerprint int"
    assert C.fingerprints(spark.createDataFrame([], schema)).count() == 0
    alone = C.fingerprints(spark.createDataFrame([(1, "abcdefgh", "x", 1)], schema)).first()
    assert fields(alone) == brute("abcdefgh", "abcdefgh")
    rows = [(None, None, "x", 1), (1, "b", "x", 1), (1, "a", "x", 1), (1, "a", "x", 1), (2, "", "x", 1), (3, "é" * 100000, "x", 1)]
    out = C.fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 6
    by = {(r["doc_id"], r["n_chars"]): r for r in out}
    assert by[None, 0]["fingerprint"] == "" and by[3, 100000]["near_next"] == 0
    assert by[2, 0]["near_edited"] == pytest.approx(1.0)
