"""Sources come from tasks by size, in pieces, with what the plain code gave."""

import random

import pyarrow as pa
import pytest

from octetloom.operators import scans
from octetloom.plans import format_queries  # noqa: F401
from octetloom.plans.queries import QUERIES
from octetloom.sources import builders, codecs, media, table, volumes
from octetloom.sources.table import FormatError

SCHEMA = pa.schema([("source_id", pa.int64()), ("content", pa.binary())])


def batch(contents):
    return pa.RecordBatch.from_arrays([pa.array(range(len(contents)), pa.int64()), pa.array(contents, pa.binary())], schema=SCHEMA)


def test_pieces_are_bounded():
    """Tasks handed on a whole batch of 10,000 sources at once."""
    got = list(table.pieces([batch([b"a", None] * 500)], lambda c: [((c or b"-") * 100_000,)], SCHEMA))
    assert max(b.nbytes for b in got) <= table.PIECE_BYTES + 200_000
    rows = [(k, v.as_py()[:1], len(v.as_py())) for b in got for k, v in zip(b.column(0).to_pylist(), b.column(1))]
    assert rows == [(i, b"-" if i % 2 else b"a", 100_000) for i in range(1000)]
    assert [b.num_rows for b in table.pieces([batch([b""])], lambda c: [(b"",)] * 5000, SCHEMA)] == [4096, 904]
    assert list(table.pieces([batch([])], lambda c: [(c,)], SCHEMA)) == []


def test_written_in_the_same_task(spark):
    src = table.from_bytes(spark, {"a": b"x", "b": b"yy"})
    made = table.parse(src, lambda c: [(len(c), c)], "n int, c binary", lambda c: c * 3)
    assert sorted(map(tuple, made.collect())) == [("a", 3, bytearray(b"xxx"), None), ("b", 6, bytearray(b"yyyyyy"), None)]

    def refuse(c):
        raise FormatError("no")

    assert {r["error"] for r in table.parse(src, refuse, "n int").collect()} == {"no"}
    with pytest.raises(Exception, match="no"):
        table.parse(src, lambda c: [(1,)], "n int", refuse).collect()
    assert table.rewritten(src, bytes.upper).count() == 2
    plan = media.samples(src, lambda c: builders.sample("t", 1, c))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan


def test_byte_run1_by_windows():
    random.seed(5)
    data = b"".join(bytes([random.randrange(256)]) * random.choice([1, 1, 2, 3, 127, 128, 129, 300]) for _ in range(9000))
    packed = codecs.pack_byte_run1(data)
    assert codecs.byte_run1(packed) == data and len(packed) < len(data) // 8
    for cut, limit, says in ((packed[:-1], 1 << 30, "cut short"), (packed, len(data) - 1, "larger"), (packed[:-1], 100, "larger")):
        with pytest.raises(FormatError, match=says):
            codecs.byte_run1(cut, limit)


def test_pictures_by_blocks(monkeypatch):
    monkeypatch.setattr(media, "PIXELS", 64)
    monkeypatch.setattr(builders, "PIXELS", 64)
    random.seed(6)
    for width, height, planes in ((1, 1, 1), (16, 30, 8), (17, 9, 3), (40, 5, 8)):
        pixels = bytes(random.randrange(1 << planes) for _ in range(width * height))
        assert media.read_picture(builders.picture(width, height, planes, pixels, b""))[-1] == pixels
    with pytest.raises(FormatError):
        builders.picture(16, 2, 8, bytes(31), b"")


@pytest.mark.parametrize("name", ["adf_list", "boot_info", "hunk_list"])
def test_one_task_writes_and_reads(spark, sf_dir, name):
    """Two Python processes a task each held up to 10,000 whole volumes or files."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan


def test_boot_checksum():
    """Words are summed at once; a carry is added back as often as it comes."""
    assert volumes.boot_checksum(b"\xff" * 1024) == 0xFFFFFFFF and volumes.boot_checksum(bytes(1024)) == 0
    assert volumes.boot_checksum(b"\xff\xff\xff\xff\x00\x00\x00\x02") == 2 and volumes.boot_checksum(b"\0\0\0\1\5") == 6
    volume = builders.volume([("a", b"x" * 5000), ("empty", b"")])
    assert volumes.read_boot(volume)[2] and [e[:2] + e[3:] for e in volumes.Volume(volume).entries()] == [("a", "file", 5000, None), ("empty", "file", 0, None)]


def test_survey_stays_in_the_row(spark):
    """Contents were shuffled to their gaps, and a module was tried at every other byte."""
    head = bytearray(1084)
    head[:4], head[950], head[1080:] = b"song", 1, b"16CH"
    song = bytes(head) + bytes(64 * 16 * 4)
    data = b"\x81\x82\x83\x84" * 3 + song
    mapped = scans.survey(table.from_bytes(spark, {"a": data, "none": b""}))
    assert "Exchange" not in mapped._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r)[1:5] for r in mapped.orderBy("start").collect()]
    assert got == [(0, 12, "sparse", 0), (12, len(data), "module", 16)]  # exactly 2 bits, as in the SQL


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 100, 70_001])
def test_power_packed_at_once(size):
    """Literals are read by the run; bits were read one by one."""
    data = random.Random(size).randbytes(size)
    packed = builders.power_pack(data)
    assert not hasattr(codecs._Backward(packed[:-4]), "have")
    assert codecs.power_packed(packed, (9, 10, 11, 12)) == data
    for broken in (packed[4:], bytes(4) + packed[:-4] + (size + 1).to_bytes(3, "big") + packed[-1:]):
        with pytest.raises(FormatError):
            codecs.power_packed(broken, (9, 10, 11, 12))


def test_power_packed_matches():
    """A near match repeats itself, a far one is copied."""
    bits = "0" + "01" + f"{ord('b'):08b}{ord('a'):08b}" + "10" + f"{1:011b}" + "1" + "01" + f"{1:010b}"  # ba, then 4 and 3 from 2 behind
    bits = "0" * (-len(bits) % 32) + bits
    stream = b"".join(int(bits[i : i + 32][::-1], 2).to_bytes(4, "big") for i in range(0, len(bits), 32)[::-1])
    skip = -(1 + 2 + 16 + 2 + 11 + 1 + 2 + 10) % 32
    assert codecs.power_packed(stream + (9).to_bytes(3, "big") + bytes([skip]), (9, 10, 11, 12)) == b"babababab"[-9:]


def test_rle_xor_by_windows():
    """Runs of 1 to 700 of the marker and of others, over several windows, as the byte by byte writer had them."""
    rng = random.Random(8)
    data = b"".join(bytes([rng.choice(b"eexyz\x00")]) * rng.choice([1, 1, 2, 3, 4, 255, 256, 257, 259, 260, 700]) for _ in range(2000))
    want, at = bytearray(b"e") + (len(data) + 4).to_bytes(4, "big"), 0
    while at < len(data):
        n = 1
        while n < 256 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        want += bytes([101, n - 1, data[at]]) if n > 3 or data[at] == 101 else data[at : at + n]
        at += n
    packed = builders.pack_rle_xor(data, 101, xor=False)
    assert packed == want and builders.pack_rle_xor(data, 101) == bytes(b ^ (i & 255) for i, b in enumerate(want)) == codecs.xored(packed)
    plain = rng.randbytes(3 * codecs.WINDOW).replace(b"e", b"x") + data
    assert codecs.rle_xor(builders.pack_rle_xor(plain, 101), 101, inline_marker=True, size_bytes=4, size_includes_field=True) == (plain, len(plain))
    with pytest.raises(FormatError, match="cut short"):
        codecs.rle_xor(b"x" * 40_000 + b"e\x01", 101, xor=False)
    with pytest.raises(FormatError, match="larger"):
        codecs.rle_xor(packed[5:], 101, xor=False, limit=len(data) - 1)
