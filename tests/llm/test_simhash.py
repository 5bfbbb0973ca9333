import random
from collections import Counter

import numpy as np
import xxhash

from octetloom.llm import components, simhash
from octetloom.llm.common import materialize
from octetloom.llm.components import smallest_reachable
from octetloom.llm.queries import op9_simhash


def brute_print(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    bits = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def brute_components(prints):
    """prints: [(doc_id, fingerprint)] -> {row: smallest id}."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        r = find(f)
        least[r] = min(least.get(r, d), d)
    return [least[find(f)] for _, f in prints]


def test_golay_words_two_apart_share_a_codeword():
    leader, weight, sevens = simhash.golay_tables()
    assert len(sevens) == 253 and Counter(weight.tolist()) == {0: 1, 1: 23, 2: 253, 3: 1771}
    rng = np.random.default_rng(1)
    for _ in range(3000):
        u = int(rng.integers(1 << 23))
        v = u
        for b in rng.choice(23, size=int(rng.integers(3)), replace=False):
            v ^= 1 << int(b)
        a, b = simhash.codeword_indices(np.array([u, v]))
        assert set(a) & set(b)


def test_fingerprints_two_apart_share_a_key():
    rng = random.Random(1)
    for _ in range(3000):
        u = rng.getrandbits(64)
        v = u
        for b in rng.sample(range(64), rng.randint(0, 2)):
            v ^= 1 << b
        a, b = simhash.golay_keys(np.array([u, v], dtype=np.uint64))
        assert set(a) & set(b)


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = [(i, brute_print(t)) for i, t in docs]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op9_simhash(spark, sf_dir).collect()}
    assert got == want


def test_large_groups_of_neighbours_link_as_small_ones_do(spark):
    rng = random.Random(4)
    base, values = rng.getrandbits(64), set()
    for _ in range(300):  # a crowd around one value, many of them on one key
        v = base
        for b in rng.sample(range(64), rng.randint(0, 4)):
            v ^= 1 << b
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    root = {r["node"]: r["root"] for r in smallest_reachable(edges).collect()}
    want = brute_components([(i, v) for i, v in enumerate(values)])
    groups, mine = {}, {}
    for i, v in enumerate(signed):
        groups.setdefault(want[i], set()).add(v)
        mine.setdefault(root.get(v, v), set()).add(v)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}
    assert max(map(len, groups.values())) > 100


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_edges_take_stars_and_few_none(spark, monkeypatch):
    rng = random.Random(4)
    edges = list({tuple(sorted(rng.sample(range(400), 2))) for _ in range(230)})
    root = {i: i for e in edges for i in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {k: low if r == high else r for k, r in root.items()}
    made = []
    monkeypatch.setattr(components, "materialize", lambda df, name, *a: made.append(name) or materialize(df, name, *a))
    for few in (0, len(edges)):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        frame = spark.createDataFrame(edges, "a long, b long")
        assert {r["node"]: r["root"] for r in smallest_reachable(frame).collect()} == root
        assert bool(made) == (few == 0)
        made.clear()


def test_odd_rows(spark):
    schema = "doc_id long, text string, fp long, component_id string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, 1, "x"), (5, "", 1, "x"), (4, " \n", 1, "x"), (7, "One two", 1, "x"), (6, "one  TWO", 1, "x"), (6, "one  TWO", 1, "x"), (9, "é" * 200000, 1, "x")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 4), (5, 4), (4, 4), (7, 6), (6, 6), (6, 6), (9, 9)], key=str)
