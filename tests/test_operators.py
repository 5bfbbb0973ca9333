import math

import pytest
from pyspark.sql import functions as F

from octetloom.functions import bytes as B
from octetloom.functions import windows as W
from octetloom.operators import compare, graph, raster, scans, tables
from octetloom.operators.layout import Layout, LayoutError, decode


def sources(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "source_id long, content binary")


def sample():
    data = bytearray(b"SOME EXAMPLE SOURCE\0SYNTHETIC DATA\0LOADER V2.1\0")
    data += bytes(48 - len(data))
    for w in (0x000, 0xEEF, 0xABC, 0x777, 0x123, 0xFFF, 0x666, 0x333, 0x999, 0x222, 0xCCC, 0x444, 0xFAB, 0x111, 0x888, 0xDDD):
        data += w.to_bytes(2, "big")
    state = 0x414D4947
    for _ in range(256):
        state = (1664525 * state + 1013904223) % 2**32
        data.append(state >> 24)
    return bytes(data)


def test_survey_of_known_regions(spark):
    rows = scans.survey(sources(spark, sample(), b"")).orderBy("start").collect()
    assert [(r["start"], r["stop"], r["kind"], r["detail_count"]) for r in rows] == [(0, 46, "strings", 3), (46, 80, "palette", 17), (80, 336, "code-or-bitmap", 0)]
    assert rows[2]["entropy"] == pytest.approx(7.262371, abs=1e-6)


def test_entropy(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 100),), (bytearray([0, 1]),), (bytearray(range(256)),), (bytearray(b""),)], "b binary")
    assert [r[0] for r in df.select(B.entropy(B.byte_array(F.col("b")))).collect()] == pytest.approx([0, 1, 8, 0], abs=1e-9)


def test_strings_filter_before_cap(spark):
    rows = scans.strings_scan(sources(spark, b"\x00abcd\xffxyzw\x80abce\x00", b"", b"abc"), 4, "abc", 1).collect()
    assert [(r["source_id"], r["start"], r["stop"], r["text"], r["string_total"], r["string_truncated"]) for r in rows] == [(0, 1, 5, "abcd", 2, True)]


def test_merge_gap(spark):
    data = b"\0HELLO\0\0WORLD\0\xff\xfe" + b"\0" * 9 + b"AGAIN!"
    rows = scans.merged_strings(sources(spark, data), 4).collect()
    assert [(r["start"], r["stop"], r["strings"]) for r in rows] == [(1, 13, 2), (25, 31, 1)]


def test_display_lists(spark):
    lst = bytes.fromhex("01001200 01800000 01820111 01840222 fffffffe")
    rows = scans.copper_lists(sources(spark, b"\0\2\0\0" + lst + lst[:8] + lst[16:], b"")).collect()
    assert [(r["start"], r["stop"], r["instructions"], r["moves"]) for r in rows] == [(4, 24, 5, 4)]
    assert [(r["start"], r["stop"], r["kind"]) for r in scans.survey(sources(spark, lst)).collect()] == [(0, 20, "copper")]


def test_pcm(spark):
    data = bytes(1024) + bytes(int(100 * math.sin(2 * math.pi * i / 32)) & 255 for i in range(2048)) + bytes(512)
    rows = scans.pcm_regions(sources(spark, data), 256, 512).collect()
    assert [(r["start"], r["stop"]) for r in rows] == [(1024, 3072)]
    assert rows[0]["smoothness"] < 0.5


def test_layout():
    layout = Layout.parse(" u16, ,pad[2],char[3],ptr")
    assert layout.size == 11 and [f.offset for f in layout.fields] == [0, 4, 7]
    for bad in ("", "pad[4]", "u64", "char[x]", ","):
        with pytest.raises(LayoutError):
            Layout.parse(bad)


def records():
    return b"".join(i.to_bytes(2, "big") + (10 * i).to_bytes(2, "big") + (0x20000 + i).to_bytes(4, "big") for i in range(4)) + b"\xff" * 4


def test_decode(spark):
    got = decode(sources(spark, records()), Layout.parse("u16,u16,ptr"), 6).orderBy("row").collect()
    assert len(got) == 4 and got[0]["row_total"] == 4
    assert (got[2]["offset"], got[2]["f0"], got[2]["f1"], got[2]["f2"]) == (16, 2, 20, 0x20002)
    assert decode(sources(spark, records()), Layout.parse("u16"), 6, offset=36).count() == 0
    with pytest.raises(Exception, match="past the end"):
        decode(sources(spark, records()), Layout.parse("u16"), 6, offset=37).collect()
    signed = decode(sources(spark, b"\xff\xfe\x80\x7f"), Layout.parse("i16,i8,u8"), 1).first()
    assert (signed["f0"], signed["f1"], signed["f2"]) == (-2, -128, 127)


def test_summarize_and_compare(spark):
    a = spark.createDataFrame([(0, 1, 7), (1, 2, 7), (2, 1, 7), (3, 5, 7)], "row long, x long, y long")
    got = tables.summarize(a, ["x", "y"], 1).orderBy("column").collect()
    assert [(r["column"], r["count"], r["distinct_total"], r["lowest"], r["highest"], r["truncated"]) for r in got] == [(0, 2, 3, 1, 5, True), (1, 4, 1, 7, 7, False)]
    b = a.withColumn("x", F.when(F.col("row") == 1, 9).otherwise(F.col("x")))
    assert [(r["column"], r["row"], r["values"]) for r in tables.compare([a, b], "row", ["x", "y"]).collect()] == [(0, 1, ["2", "9"])]
    assert tables.compare([a, b.where("row < 1")], "row", ["x"]).count() == 0
    assert tables.summarize(a.limit(0), ["x"]).count() == 0


def test_changed_ranges_reach_the_longer_end(spark):
    pairs = spark.createDataFrame([(1, bytearray(b"abXd"), bytearray(b"abYdef")), (2, bytearray(b"abc"), bytearray(b"abcde"))], "pair_id long, a binary, b binary")
    assert sorted(map(tuple, compare.changed_ranges(pairs).collect())) == [(1, 2, 1), (1, 4, 2), (2, 3, 2)]


def test_overlap_sweep_clips_and_drops(spark):
    found = spark.createDataFrame([(1, 0, 10, 1), (1, 5, 20, 4), (1, 6, 9, 4), (1, 0, 4, 3)], "source_id long, start long, stop long, priority int")
    assert sorted((r["start"], r["stop"]) for r in W.overlap_sweep(found).collect()) == [(0, 4), (4, 10), (10, 20)]


def test_asof_strict(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("j", 5)], "k string, t long")
    right = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b")], "k string, at long, v string")
    loose = {(r["k"], r["t"]): r["v"] for r in W.asof(left, right, ["k"], "t", "at", ["v"]).collect()}
    strict = {(r["k"], r["t"]): r["v"] for r in W.asof(left, right, ["k"], "t", "at", ["v"], strict=True).collect()}
    assert loose == {("k", 5): "b", ("k", 1): "a", ("j", 5): None}
    assert strict == {("k", 5): "a", ("k", 1): None, ("j", 5): None}


def test_backward_slice(spark):
    uses = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "used_by long, defined_by long")
    assert {r["node"]: r["depth"] for r in graph.backward_slice(uses, [1], 2).collect()} == {1: 0, 2: 1, 3: 2}


def test_regions_and_planes(spark):
    points = spark.createDataFrame([(0, 0), (1, 0), (3, 0), (1, 1), (5, 5), (6, 6)], "x long, y long")
    got = sorted((r["pixels"], r["left"], r["top"], r["right"], r["bottom"]) for r in raster.connected_regions(points).collect())
    assert got == [(1, 3, 0, 3, 0), (1, 5, 5, 5, 5), (1, 6, 6, 6, 6), (3, 0, 0, 1, 1)]
    pixels = raster.decode_planar(sources(spark, bytes([0b10100000, 0b11000000])), 3, 1, 2).first()["pixels"]
    assert bytes(pixels) == bytes([3, 2, 1])


def test_first_divergence_of_missing_trace(spark):
    trace = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x")], "record string, step long, address string")
    got = compare.first_divergence(trace, "record", "step", "address", "a", "b").first()
    assert (got["step"], got["a"], got["b"], got["occurrence_a"]) == (0, "x", None, 1)


def test_regions_of_any_shape(spark):
    line = [(3, y) for y in range(40)]  # a column of forty runs
    comb = [(10 + x, 0) for x in range(20)] + [(10 + 2 * x, y) for x in range(10) for y in range(1, 6)]
    points = spark.createDataFrame([*line, *comb, (50, 50)], "x long, y long")
    got = sorted((r["pixels"], r["left"], r["top"], r["right"], r["bottom"]) for r in raster.connected_regions(points).collect())
    assert got == [(1, 50, 50, 50, 50), (40, 3, 0, 3, 39), (70, 10, 0, 29, 5)]
    assert raster.connected_regions(points.limit(0)).count() == 0
