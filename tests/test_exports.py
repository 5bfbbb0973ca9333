import json

import pytest
from pyspark.sql import functions as F

from octetloom.operators import compare, exports, state
from octetloom.plans import write_plan
from octetloom.streaming import strings_stream, windowed_counts

TYPES = {
    "u16": {"kind": "integer", "size": 2}, "i16": {"kind": "integer", "size": 2, "signed": True}, "u32le": {"kind": "integer", "size": 4, "little": True},
    "flags": {"kind": "enum", "of": "u16", "members": {"None": 0, "Boss": 2}},
    "head": {"kind": "struct", "size": 4, "fields": {"id": (0, "u16"), "flags": (2, "flags")}},
    "heads": {"kind": "array", "of": "head", "count": 2},
}


def test_state_snapshot(spark):
    memory = bytes.fromhex("00010002 00020009 fffe 78563412".replace(" ", ""))
    regions = spark.createDataFrame([("a", 100, bytearray(memory)), ("b", 100, bytearray(memory[:9] + b"\x01" + memory[10:]))], "snapshot string, origin long, content binary")
    got = state.snapshot(regions, TYPES, {"table": (100, "heads"), "lives": (108, "i16"), "seed": (110, "u32le")})
    rows = {(r["snapshot"], r["path"]): (int(r["value"]), r["member"]) for r in got.collect()}
    assert rows["a", "table[0].flags"] == (2, "Boss") and rows["a", "table[1].flags"] == (9, None)
    assert rows["a", "lives"] == (-2, None) and rows["b", "lives"] == (-255, None) and rows["a", "seed"] == (0x12345678, None)
    assert len(rows) == 12
    assert [r["path"] for r in compare.state_differences(got, 2).collect()] == ["lives"]
    with pytest.raises(Exception, match="does not hold"):
        state.snapshot(regions, TYPES, {"x": (113, "u16")}).collect()
    with pytest.raises(state.StateError):
        state.snapshot(regions, TYPES, {"x": (100, "u16"), "y": (101, "u16")})
    with pytest.raises(state.StateError):
        state.size_of({"a": {"kind": "alias", "of": "a"}}, "a")


def test_windows_and_carving(spark, tmp_path):
    src = spark.createDataFrame([("s", bytearray(range(40)))], "source_id string, content binary")
    r = exports.read_window(src, 32, 64).first()
    assert bytes(r["bytes"]) == bytes(range(32, 40)) and r["listing"] == "00000020  20 21 22 23 24 25 26 27"
    assert exports.read_window(src, 40, 4).first()["listing"] == ""
    files = exports.carve(src, F.lit("part.bin"), 3, 5)
    write_plan.commit(files, str(tmp_path / "out"), write_plan.prepare(files)[1])
    assert (tmp_path / "out/part.bin").read_bytes() == bytes(range(3, 8))
    with pytest.raises(Exception, match="leaves source"):
        exports.carve(src, F.lit("x"), 38, 5).collect()


def test_media_files(spark):
    pal = spark.createDataFrame([("p.png", [0x000, 0xFFF, 0x08F])], "path string, words array<int>")
    assert bytes(exports.swatch_files(pal, 2, 2).first()["content"])[:4] == b"\x89PNG"
    spots = spark.createDataFrame([(0, 0), (2, 1), (9, 9)], "x long, y long")
    assert bytes(exports.heatmap_files(spots, F.lit("h.png"), 3, 2).first()["content"])[:4] == b"\x89PNG"
    wav = spark.createDataFrame([("a.wav", bytearray(b"\0\1"), 8000)], "path string, pcm binary, sample_rate int")
    assert bytes(exports.wav_files(wav).first()["content"])[:4] == b"RIFF"
    src = spark.createDataFrame([("b", bytearray(b"x")), ("a", bytearray(b""))], "source_id string, content binary")
    assert [e["source_id"] for e in json.loads(bytes(exports.manifest_file(src).first()["content"]))] == ["a", "b"]
    lines = bytes(exports.json_file(src.select("source_id"), "x.jsonl", ["source_id"]).first()["content"]).decode().split("\n")
    assert [json.loads(x)["source_id"] for x in lines] == ["a", "b"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"\0hello\0\0world!")
    q = strings_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r["text"] for r in spark.table("found").collect()) == ["hello", "world!"]
    (tmp_path / "ev").mkdir()
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, event_type string").selectExpr("cast(t as timestamp) ts", "event_type").write.parquet(str(tmp_path / "ev/x"))
    stream = windowed_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev/x")))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert sorted((r["event_type"], r["events"]) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]
