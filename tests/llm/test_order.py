"""Sharding and mixing."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from octetloom.llm import mixing, sharding
from octetloom.llm.queries import MIX_WEIGHTS, op3_mix, op7_shard


def key(seed, i):
    return hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()


def ranks(docs, seed):
    by = {}
    for i, s in docs:
        by.setdefault(s, []).append(i)
    return {(i, s): (n, len(ids)) for s, ids in by.items() for n, i in enumerate(sorted(ids, key=lambda i: (key(seed, i), i)))}


def test_shards_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    r = ranks([(d["doc_id"], d["source"]) for d in docs], 7)
    order = sorted(r, key=lambda k: (Fraction(2 * r[k][0] + 1, 2 * r[k][1]), "s" + k[1]))
    n = len(order)
    want, slots = {}, Counter()
    for pos, (i, _) in enumerate(order):
        s = pos * 8 // n
        want[i] = (s, slots[s])
        slots[s] += 1
    got = {d["doc_id"]: d for d in op7_shard(spark, sf_dir).collect()}
    assert len(got) == n
    for d in docs:
        g, data = got[d["doc_id"]], (d["text"] or "").encode()
        assert (g["shard"], g["slot"]) == want[d["doc_id"]]
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert max(slots.values()) - min(slots.values()) <= 1


def test_pfair_deviates_less_than_a_block():
    for weights in ({"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 3, "c": 2, "d": 1}, {f"s{i}": i for i in range(1, 30)}):
        plan, total = mixing.pfair_period(weights), sum(weights.values())
        seen = Counter()
        for slot, (s, j) in enumerate(plan, 1):
            assert j == seen[s]
            seen[s] += 1
            for name, w in weights.items():
                assert abs(seen[name] - Fraction(slot * w, total)) < 1
        assert seen == Counter(weights)
    with pytest.raises(ValueError):
        mixing.pfair_period({"a": mixing.MAX_PERIOD + 1})


def brute_mix(docs, weights, seed, block):
    r = ranks(docs, seed)
    used = {s: weights.get(s, 1) for _, s in docs}
    plan = mixing.pfair_period({"s" + s: w for s, w in used.items()})
    slot_of = {(s[1:], j): k for k, (s, j) in enumerate(plan)}
    out = {}
    for (i, s), (n, _) in r.items():
        b = n // block
        out[i] = b // used[s] * len(plan) + slot_of[s, b % used[s]], n
    order = sorted(out, key=lambda i: out[i])
    return {i: (out[i][0], pos) for pos, i in enumerate(order)}


def test_mix_matches_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_mix(docs, MIX_WEIGHTS, 3, 16)
    got = {r["doc_id"]: (r["mix_slot"], r["mix_position"]) for r in op3_mix(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("f,names", [(lambda d: sharding.shard(d, 3), ("shard", "slot")), (mixing.mix, ("mix_slot", "mix_position"))])
def test_odd_rows(spark, f, names):
    schema = "doc_id long, source string, text string, shard string, mix_slot string, _bucket2 int"
    assert f(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, "x", "y", 1)] * 2 + [(1, "a", "", "x", "y", 1)] * 3 + [(i, "b", "t" * i, "x", "y", 1) for i in range(40)]
    out = f(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    if names[0] == "shard":
        by = Counter(r["shard"] for r in out)
        assert sorted(by) == [0, 1, 2] and max(by.values()) - min(by.values()) <= 1
        assert sorted((r["shard"], r["slot"]) for r in out) == sorted((s, k) for s, n in by.items() for k in range(n))
    else:
        assert sorted(r["mix_position"] for r in out) == list(range(len(rows)))


CLASHING = ["_w", "_slot", "_source", "_bucket", "_all", "_key", "_row", "row", "rank", "source2", "key", "block", "bucket", "before", "nth", "place", "pos", "j", "w", "slot2", "stratum", "all"]


def test_any_column_names_stay(spark):
    names = ["doc_id", "source", *CLASHING]
    rows = [(i, "ab"[i % 2], *[f"{c}{i}" for c in CLASHING]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for out, more in ((mixing.mix(docs), ["mix_slot", "mix_position"]), (sharding.shard(docs), ["shard", "slot"])):
        assert out.columns == names + more
        assert sorted(tuple(r)[: len(names)] for r in out.collect()) == rows


def test_rows_before_a_range_of_slots(monkeypatch):
    rng = random.Random(4)
    for _ in range(30):
        weights = {f"s{i}": rng.randint(1, 6) for i in range(rng.randint(1, 5))}
        sizes = {s: rng.randint(1, 300) for s in weights}
        monkeypatch.setattr(mixing, "LOOKUPS", rng.choice([10, 50, 5000]))
        plan = mixing.pfair_period(weights)
        span, before = mixing._before(plan, sizes, weights, 4)
        at = []
        for s, n in sizes.items():
            slots = [slot for slot, (x, _) in enumerate(plan) if x == s]
            at += [(r // 4 // weights[s]) * len(plan) + slots[r // 4 % weights[s]] for r in range(n)]
        assert before == [sum(x < b * span for x in at) for b in range(len(before))]
        assert len(before) * span > max(at)
