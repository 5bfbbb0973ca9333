import struct
import zlib

import pytest

from octetloom.plans import write_plan
from octetloom.sources import archives, codecs, executables, media, table, volumes
from octetloom.sources.table import FormatError


def load_file():
    w = lambda *n: struct.pack(f">{len(n)}I", *n)
    code = w(0x3E9, 2) + b"\x4e\x71\x4e\x75" + w(0)
    return w(0x3F3, 0, 2, 0, 1, 2, 1) + code + w(0x3EC, 1, 1, 4, 0, 0x3F2) + w(0x3EA, 1) + b"DATA" + w(0x3F2)


def test_load_file(spark):
    src = table.from_bytes(spark, {"a": load_file(), "b": load_file() + b"\0\0\0\0", "c": b"no"})
    rows = {(r["source_id"], r["hunk"]): r for r in executables.segments(src).collect()}
    assert (rows["a", 0]["kind"], rows["a", 1]["kind"], bytes(rows["a", 1]["content"])) == ("code", "data", b"DATA")
    assert rows["b", None]["error"] and rows["c", None]["error"]
    rel = [tuple(r)[:5] for r in executables.relocations(src).where("error IS NULL").collect()]
    assert rel == [("a", 0, 4, 1, 0)]


def old_volume():
    data = bytearray(20 * 512)

    def put(block, fields, name=None, payload=b""):
        raw = bytearray(512)
        for i, v in fields.items():
            struct.pack_into(">I", raw, 4 * i, v & 0xFFFFFFFF)
        if name:
            raw[432 : 433 + len(name)] = bytes([len(name)]) + name.encode()
        raw[24 : 24 + len(payload)] = payload or raw[24:24]
        struct.pack_into(">I", raw, 20, -sum(struct.unpack(">128I", raw)) & 0xFFFFFFFF)
        data[block * 512 : block * 512 + 512] = raw

    put(10, {0: 2, 6: 2, 7: 5, 127: 1}, "Disk")
    put(2, {0: 2, 1: 2, 6: 3, 9: 7, 127: 2}, "S")
    for head, block, name, text in ((3, 4, "startup", b"echo hello\n"), (5, 6, "readme", b"some text\n")):
        put(head, {0: 2, 1: head, 4: block, 81: len(text), 127: -3}, name)
        put(block, {0: 8, 1: head, 2: 1, 3: len(text)}, payload=text)
    put(7, {0: 2, 1: 7, 4: 4, 127: -3}, "empty")
    return bytes(data)


def test_old_volume(spark):
    src = table.from_bytes(spark, {"v": old_volume(), "bad": b"x" * 512})
    rows = volumes.listing(src).where("error IS NULL").orderBy("path").collect()
    assert [(r["path"], r["kind"], r["block"], r["size"]) for r in rows] == [("S", "directory", 2, 0), ("S/empty", "file", 7, 0), ("S/startup", "file", 3, 11), ("readme", "file", 5, 10)]
    assert rows[1]["warning"] == "stale data pointer"
    got = {r["path"]: bytes(r["content"]) for r in volumes.contents(src).where("error IS NULL").collect()}
    assert got == {"S/empty": b"", "S/startup": b"echo hello\n", "readme": b"some text\n"}
    assert volumes.listing(src).where("error IS NOT NULL").count() == 1


def stored_archive(data=b"hello archive", name=b"dir\\a.txt"):
    body = b"-lh0-" + struct.pack("<II", len(data), len(data)) + b"\0" * 4 + b"\x20\0" + bytes([len(name)]) + name + struct.pack("<H", codecs.crc16(data))
    return bytes([len(body), sum(body) & 255]) + body + data + b"\0"


def test_archive(spark):
    src = table.from_bytes(spark, {"a": stored_archive()})
    r = archives.contents(src).first()
    assert (r["path"], r["method"], bytes(r["content"]), r["error"]) == ("dir/a.txt", "-lh0-", b"hello archive", None)
    broken = bytearray(stored_archive())
    broken[-3] ^= 1
    with pytest.raises(FormatError):
        archives.extract(bytes(broken))
    assert archives.members(b"\0") == []
    with pytest.raises(FormatError):
        archives.members(b"\0\0\0")


def lh5(text):
    """A writer for tests: one block of literals under a flat 8-bit code."""
    bits = f"{len(text):016b}" + "00000" + "01010"  # code lengths: symbol 10 alone, i.e. length 8
    bits += f"{256:09b}" + "0000" + "0000"  # 256 literals of that length; one place code
    bits += "".join(f"{b:08b}" for b in text)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_unpack_literals():
    text = bytes(range(256)) * 3
    assert archives.unpack(lh5(text), "-lh5-", len(text)) == text


def test_codecs():
    assert codecs.crc16(b"123456789") == 0xBB3D
    assert codecs.byte_run1(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])
    for data in (b"", b"aaaaabcdddd", bytes(range(256)) * 2, b"x" * 1000):
        assert codecs.byte_run1(codecs.pack_byte_run1(data)) == data
    with pytest.raises(FormatError):
        codecs.byte_run1(b"\x05ab")
    with pytest.raises(FormatError):
        codecs.byte_run1(b"\x81x" * 10, limit=100)
    plain = b"\x00\x0aab\xfe\x03c"  # a size of 10 that counts itself, then ab and four c
    packed = bytes(b ^ i for i, b in enumerate(b"\xfe" + plain))
    assert codecs.rle_xor(packed, 0xFE, inline_marker=True, size_bytes=2, size_includes_field=True) == (b"abcccc", 8)
    with pytest.raises(FormatError):
        codecs.rle_xor(packed, 0xFD, inline_marker=True)
    with pytest.raises(FormatError):
        codecs.power_packed(bytes(8), (9, 10, 11, 12))


def packed_literals(text, modes=(9, 10, 11, 12)):
    """A writer for tests: the stream's bits in the order they are read."""
    bits, left = "0", len(text) - 1
    while True:
        take = min(left, 3)
        bits += f"{take:02b}"
        left -= take
        if take < 3:
            break
    bits += "".join(f"{b:08b}" for b in reversed(text))
    skip = -len(bits) % 32
    bits = "0" * skip + bits
    words = [int(bits[i : i + 32][::-1], 2) for i in range(0, len(bits), 32)]
    return b"".join(w.to_bytes(4, "big") for w in reversed(words)) + len(text).to_bytes(3, "big") + bytes([skip])


def test_power_packed_literals():
    for text in (b"a", b"hello world", bytes(range(200))):
        assert codecs.power_packed(packed_literals(text), (9, 10, 11, 12)) == text


def form(kind, *parts):
    body = kind + b"".join(k + struct.pack(">I", len(d)) + d + b"\0" * (len(d) & 1) for k, d in parts)
    return b"FORM" + struct.pack(">I", len(body)) + body


def test_sample_and_wav(spark):
    head = struct.pack(">IIIHBBI", 3, 1, 0, 8000, 1, 0, 65536)
    src = table.from_bytes(spark, {"s": form(b"8SVX", (b"VHDR", head), (b"NAME", b"beep\0"), (b"BODY", b"\x00\x7f\x80\xff")), "t": form(b"8SVX", (b"VHDR", head), (b"BODY", b"\0"))})
    rows = {r["source_id"]: r for r in media.samples(src).collect()}
    assert (rows["s"]["name"], rows["s"]["sample_rate"], rows["s"]["one_shot"]) == ("beep", 8000, 3)
    assert rows["t"]["error"]
    wav = media.wav(bytes(rows["s"]["pcm"]), 8000)
    assert wav[:4] == b"RIFF" and wav[-4:] == b"\x80\xff\x00\x7f" and struct.unpack("<I", wav[4:8])[0] == len(wav) - 8


def test_picture_and_png():
    head = struct.pack(">HHhhBBBBHBBhh", 3, 2, 0, 0, 2, 0, 1, 0, 0, 1, 1, 3, 2)
    rows = [b"\xa0\x00", b"\xc0\x00", b"\x00\x00", b"\xe0\x00"]
    got = media.read_picture(form(b"ILBM", (b"BMHD", head), (b"CMAP", bytes(12)), (b"BODY", codecs.pack_byte_run1(b"".join(rows)))))
    assert got[:3] == (3, 2, 2) and got[-1] == bytes([3, 2, 1, 2, 2, 2])
    png = media.png(3, 2, got[-1], got[-2])
    at = png.index(b"IDAT")
    size = struct.unpack(">I", png[at - 4 : at])[0]
    assert zlib.decompress(png[at + 4 : at + 4 + size]) == b"\0" + got[-1][:3] + b"\0" + got[-1][3:]


def module():
    head = bytearray(1084)
    head[:4], head[950], head[1080:] = b"song", 1, b"M.K."
    head[20 + 22 : 20 + 24] = (3).to_bytes(2, "big")
    return bytes(head) + bytes(1024) + b"\1" * 6


def test_modules_are_skipped_over():
    data = b"\0\0" + module() + module() + b"xx"
    found = media.find_modules(data)
    assert [(m[0], m[3], m[5], m[7]) for m in found] == [(2, 4, 1, 2114), (2116, 4, 1, 2114)]
    assert [media.channel_count(s) for s in (b"M.K.", b"6CHN", b"16CH", b"0CHN")] == [4, 6, 16, None]


def test_write_plan(spark, tmp_path):
    files = spark.createDataFrame([("a/b.txt", bytearray(b"x")), ("c.txt", bytearray(b"yy"))], "path string, content binary")
    plan, digest = write_plan.prepare(files)
    assert plan.count() == 2 and write_plan.prepare(files)[1] == digest
    target = str(tmp_path / "out")
    with pytest.raises(write_plan.PlanError):
        write_plan.commit(files, target, "0" * 64)
    write_plan.commit(files, target, digest)
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"x" and (tmp_path / "out/c.txt").read_bytes() == b"yy"
    with pytest.raises(write_plan.PlanError):
        write_plan.commit(files, target, digest)
    for bad in ("../x", "/x", "a//b", "", "a/./b"):
        with pytest.raises(write_plan.PlanError):
            write_plan.prepare(spark.createDataFrame([(bad, bytearray(b""))], "path string, content binary"))
    clash = spark.createDataFrame([("a", bytearray(b"")), ("a/b", bytearray(b""))], "path string, content binary")
    with pytest.raises(write_plan.PlanError):
        write_plan.prepare(clash)
    read = {r["path"].rsplit("/", 1)[1]: r["size"] for r in table.read_files(spark, target).collect()}
    assert read == {"b.txt": 1, "c.txt": 2}
