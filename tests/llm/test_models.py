"""Quality and toxicity classifiers: held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from octetloom.llm import quality, toxicity
from octetloom.llm.queries import op1_quality, op8_toxicity

BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query,label,modulus,rest,least", [(op1_quality, "quality", 3, 1, 0.97), (op8_toxicity, "toxic", 5, 0, 0.95)])
def test_held_out_accuracy(spark, query, label, modulus, rest, least):
    rows = {r["doc_id"]: r for r in query(spark, BIG).collect()}
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in spark.read.parquet(f"{BIG}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([rows[r["doc_id"]]["predicted"] == r[label] for r in held]) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    docs_schema, labels_schema = "doc_id long, text string, score string, label int", "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0), (None, 1, 1), (3, None, None)], labels_schema)
    docs = spark.createDataFrame([(None, None, "x", 1), (1, "", "x", 1), (1, "", "x", 1), (2, "w " * 100000, "x", 1), (3, "a b", "x", 1)], docs_schema)
    assert module.score(docs.limit(0), labels, F.lit(True)).count() == 0
    out = module.score(docs, labels, F.lit(True)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not r["text"]}) == 1
    none = module.score(docs, labels, F.lit(False)).collect()
    assert {round(r["score"], 9) for r in none} == {0.5}
    one_class = module.score(docs, labels.where("doc_id = 2"), F.lit(True)).collect()
    assert all(r["score"] < 0.5 for r in one_class)


def test_scores_do_not_depend_on_neighbours():
    texts = [b"good words here", b"", "übel &&& %%%".encode(), b"good words here"]
    model = quality.train([b"good words here", b"bad &&& %%% words"] * 20, [1, 0] * 20)
    together = model.log_odds(texts)
    assert list(together) == [model.log_odds([t])[0] for t in texts]
    ratios = toxicity.fit([b"you are a moron " * 3 + bytes([97 + i]) for i in range(20)] + [b"kind words for all " + bytes([97 + i]) for i in range(20)], np.array([1] * 20 + [0] * 20))
    assert list(ratios.means(texts)) == [ratios.means([t])[0] for t in texts]
    assert ratios.means([b"what a moron"])[0] > ratios.means([b"what a day"])[0]


def test_toxicity_matches_brute_force():
    """The models by loops and dicts of words, as the docstring of ``fit`` has them."""
    rng = np.random.default_rng(3)
    common, rude = [f"w{i}" for i in range(30)], ["vile", "awful thing"]
    texts, labels = [], []
    for i in range(120):
        words = [common[j] for j in rng.zipf(1.5, 12) if j < 30]
        labels.append(int(i % 4 == 0))
        if labels[-1]:
            words[len(words) // 2 : len(words) // 2] = [rude[i % 8 // 4]]
        texts.append(" ".join([*words, f"t{i}"]))
    split = [t.split() for t in texts]
    pairs = [list(zip([None, *w[:-1]], w)) for w in split]

    def by_class(things):
        out = {}
        for y, some in zip(labels, things):
            for x in set(some):
                out.setdefault(x, [0, 0])[y] += 1
        return out

    def discounted(counts, expected):
        z = np.sqrt(2 * np.log(len(counts)))
        out = {}
        for x, c in counts.items():
            n, p = sum(c), expected(x)
            out[x] = [max(c[k] - n * p[k] - z * np.sqrt(n * p[k] * (1 - p[k])), 0) for k in (0, 1)]
        return out

    word, pair = by_class(split), by_class(pairs)
    sums = [sum(c[k] for c in word.values()) for k in (0, 1)]
    kept = discounted(word, lambda w: [s / sum(sums) for s in sums])
    shared = {w: sum(b == w for _, b in pair) for w in word}
    rest = [1 - sum(c[k] for c in kept.values()) / sums[k] for k in (0, 1)]
    low = {w: [kept[w][k] / sums[k] + rest[k] * shared[w] / (len(pair) + 1) for k in (0, 1)] for w in word}
    rate = {w: [low[w][k] * sums[k] for k in (0, 1)] for w in word}
    taken = discounted(pair, lambda x: [r / sum(rate[x[1]]) for r in rate[x[1]]])
    total = {}
    for (a, _), c in pair.items():
        total[a] = [total.get(a, [0, 0])[k] + c[k] for k in (0, 1)]
    share = {x: [taken[x][k] / max(total[x[0]][k], 1) for k in (0, 1)] for x in pair}
    back = {a: [1 - sum(s[k] for x, s in share.items() if x[0] == a) for k in (0, 1)] for a in total}

    def mean(text):
        words, sum_ = text.split(), 0
        for a, b in zip([None, *words[:-1]], words):
            p = [share.get((a, b), (0, 0))[k] + back.get(a, (1, 1))[k] * (low[b][k] if b in low else rest[k]) for k in (0, 1)]
            sum_ += np.log(p[1] / p[0])
        return sum_ / max(len(words), 1)

    model = toxicity.fit([t.encode() for t in texts], np.array(labels))
    tried = [*texts, "vile", "awful new thing", "w1 w2 unseen", "an awful thing", ""]
    assert list(model.means([t.encode() for t in tried])) == pytest.approx([mean(t) for t in tried], abs=1e-9)
    assert mean("awful") > 0.5 and mean("w1") < 0.5


def test_quality_features_do_not_span_texts():
    for t in ["Good words, here", "bad &&& %%% words", "ünï code", "a", "", "  "]:
        own = quality.features([t.encode()])
        beside = quality.features([t.encode(), b"other text"])
        for (a, n), (b, m) in zip(own, beside):
            assert n[0] == m[0] and (a == b[: n[0]]).all()
