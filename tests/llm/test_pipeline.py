from pyspark.sql import functions as F

import corpus_pipeline as P
from octetloom.llm.common import table
from octetloom.llm.secrets import find


def test_stages_and_whole_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out = P.materialize(out, "test")
        assert out.columns == P.COLUMNS
        n = out.count()
        assert 0 < n <= before
        if name == "near-dedup":
            assert out.select("doc_id").distinct().count() == n
            assert out.select("text").distinct().count() == n
        if name == "secret scan":
            assert n == before
            assert find(out).where(F.size("spans") > 0).count() == 0
        docs, before = out, n
    packed = P.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before
    assert P.run(spark, sf_dir).count() == packed.count()


def test_stages_take_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 30000, "en", "a", 150000), (3, "x", None, None, 1)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for _, stage in P.STAGES[1:]:
            docs = P.materialize(stage(spark, docs, sf_dir), "test")
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids == ({1, 2, 3} if data else set())


def test_packing_follows_the_mixture(spark, sf_dir, monkeypatch):
    rows = [(i, f"text of document {i} " + "word " * (i % 7 * 300), "en", "ab"[i % 2], 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def places(weights):
        monkeypatch.setattr(P, "MIX_WEIGHTS", weights)
        out = docs
        for _, stage in P.STAGES[-2:]:
            out = P.materialize(stage(spark, out, sf_dir), "test")
        return {(r["doc_id"], r["piece"]): (r["sequence_id"], r["offset"], r["length"]) for r in out.collect()}

    some, other = places({"a": 9, "b": 1}), places({"a": 1, "b": 9})
    assert some.keys() == other.keys() and some != other
    for got, ahead in ((some, 0), (other, 1)):
        sequences = {s for s, _, _ in got.values()}
        assert sequences == set(range(len(sequences)))
        # The heavier source comes first.
        mean = [sum(s for (i, _), (s, _, _) in got.items() if i % 2 == k) for k in (0, 1)]
        assert mean[ahead] < mean[1 - ahead]
        taken = {}
        for s, offset, length in got.values():
            taken.setdefault(s, []).append((offset, length))
        for spans in taken.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 4096


def test_near_dedup_keeps_every_group_whatever_its_ids(spark, sf_dir):
    texts = {(1, "one unlike text of some words"), (1, "another text that has the same id"), (None, "a text without an id"), (None, "and one more of these"), (2, "the last one")}
    rows = [(i, t, "en", "a", len(t)) for i, t in texts] + [(9, "A  text without an id", "en", "a", 0), (1, "the last one", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs, sf_dir).collect()), key=str)
    want = texts - {(None, "a text without an id"), (2, "the last one")} | {(9, "A  text without an id"), (1, "the last one")}
    assert got == sorted(want, key=str)
