"""IFF pictures and samples, tracker modules, and PNG and WAV to write."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .codecs import byte_run1
from .table import FormatError, Write, parse


#: Pixels that are taken apart or put together at once.
PIXELS = 1 << 18


def latin1_text(data: bytes) -> str:
    return data.split(b"\0", 1)[0].decode("latin-1")


def chunks(data: bytes) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """(form type, [(id, data)]) of a FORM; chunks of odd length are padded."""
    if len(data) < 12 or data[:4] != b"FORM":
        raise FormatError("no FORM")
    end = 8 + int.from_bytes(data[4:8], "big")
    if end > len(data) or end < 12:
        raise FormatError("FORM is cut short")
    at, out = 12, []
    while at < end:
        if at + 8 > end:
            raise FormatError(f"chunk header cut short at {at}")
        size = int.from_bytes(data[at + 4 : at + 8], "big")
        if at + 8 + size > end:
            raise FormatError(f"chunk cut short at {at}")
        out.append((data[at : at + 4], data[at + 8 : at + 8 + size]))
        at += 8 + size + (size & 1)
    return data[8:12], out


def _once(parts: list[tuple[bytes, bytes]], name: bytes, needed: bool = True) -> bytes | None:
    found = [d for k, d in parts if k == name]
    if len(found) > 1:
        raise FormatError(f"more than one {name.decode()}")
    if not found and needed:
        raise FormatError(f"no {name.decode()}")
    return found[0] if found else None


def read_sample(data: bytes) -> tuple:
    """(name, sample_rate, one_shot, repeat, volume, pcm) of an 8SVX form."""
    form, parts = chunks(data)
    if form != b"8SVX":
        raise FormatError("no 8SVX form")
    head, body, name = _once(parts, b"VHDR"), _once(parts, b"BODY"), _once(parts, b"NAME", False)
    if len(head) < 20:
        raise FormatError("VHDR is cut short")
    one_shot, repeat, _, rate, _, compression, volume = struct.unpack(">IIIHBBI", head[:20])
    if not rate or compression:
        raise FormatError("a sample rate of 0, or a compressed body")
    if one_shot + repeat != len(body):
        raise FormatError("the body is not as long as declared")
    return latin1_text(name or b""), rate, one_shot, repeat, volume, body


def read_picture(data: bytes) -> tuple:
    """(width, height, planes, masking, mode, palette, pixels) of an ILBM form:
    palette as RGB triples, pixels an index byte each. Rows are word aligned;
    a mask plane is read over; HAM and half-brite modes are refused."""
    form, parts = chunks(data)
    if form != b"ILBM":
        raise FormatError("no ILBM form")
    head = _once(parts, b"BMHD")
    if len(head) < 20:
        raise FormatError("BMHD is cut short")
    width, height, _, _, planes, masking, packing = struct.unpack(">HHhhBBB", head[:11])
    if not width or not height or not 1 <= planes <= 8 or packing > 1:
        raise FormatError("a geometry or packing that is not read")
    mode_chunk = _once(parts, b"CAMG", False)
    mode = int.from_bytes(mode_chunk[:4], "big") if mode_chunk else 0
    if mode & 0x880:
        raise FormatError("hold-and-modify and half-brite are not read")
    row, all_planes = (width + 15) // 16 * 2, planes + (masking == 1)
    need = row * all_planes * height
    body = _once(parts, b"BODY")
    raw = byte_run1(body, need) if packing else body
    if len(raw) < need:
        raise FormatError("the body is too short")
    lines = np.frombuffer(raw, np.uint8, need).reshape(height, all_planes, row)
    pixels, rows = bytearray(), max(1, PIXELS // width)
    for y in range(0, height, rows):
        some = np.zeros((min(rows, height - y), width), np.uint8)
        for p in range(planes):
            some |= np.unpackbits(lines[y : y + rows, p], axis=1, count=width) << p
        pixels += some.tobytes()
    return width, height, planes, masking, mode, _once(parts, b"CMAP", False) or b"", bytes(pixels)


_MODULE_HEADER = 1084


#: Where a signature may begin; each is told by channel_count.
_SIGNATURES = re.compile(rb"[MFCO0-9](?:(?<=M)(?=[.!&]K[.!])|(?<=F)(?=LT[48])|(?<=C)(?=D81)|(?<=O)(?=KTA)|(?<=[0-9])(?=CHN|[0-9]CH))")


def channel_count(signature: bytes) -> int | None:
    if signature in (b"M.K.", b"M!K!", b"M&K!", b"FLT4", b"4CHN"):
        return 4
    if signature in (b"FLT8", b"CD81", b"OKTA"):
        return 8
    m = re.fullmatch(rb"([0-9])CHN|([0-9]{2})CH", signature)
    n = int(m[1] or m[2]) if m else 0
    return n if 1 <= n <= 32 else None


def read_module(data: bytes, start: int = 0) -> tuple | None:
    """(offset, title, signature, channels, song_length, patterns, sample_bytes,
    total) of a tracker module at ``start``; none if it is not plausible."""
    head = data[start : start + _MODULE_HEADER]
    if len(head) < _MODULE_HEADER or (channels := channel_count(head[1080:1084])) is None:
        return None
    entries = [head[20 + 30 * i : 50 + 30 * i] for i in range(31)]
    if any(e[25] > 64 for e in entries) or not 1 <= head[950] <= 128:
        return None
    samples = sum(2 * int.from_bytes(e[22:24], "big") for e in entries)
    patterns = max(head[952:1080]) + 1
    total = _MODULE_HEADER + patterns * 64 * channels * 4 + samples
    if start + total > len(data):
        return None
    return start, latin1_text(head[:20]), head[1080:1084].decode("latin-1"), channels, head[950], patterns, samples, total


def find_modules(data: bytes) -> list[tuple]:
    """Modules at even offsets; the search goes on behind each one found."""
    out, at = [], 0
    for m in _SIGNATURES.finditer(data, _MODULE_HEADER - 4):
        start = m.start() - _MODULE_HEADER + 4
        if start >= at and start % 2 == 0 and (found := read_module(data, start)):
            out.append(found)
            at = start + found[-1]
    return out


def samples(sources: DataFrame, write: Write = None) -> DataFrame:
    return parse(sources, lambda c: [read_sample(c)], "name string, sample_rate int, one_shot long, repeat long, volume long, pcm binary", write)


def pictures(sources: DataFrame, write: Write = None) -> DataFrame:
    return parse(sources, lambda c: [read_picture(c)], "width int, height int, planes int, masking int, mode long, palette binary, pixels binary", write)


def modules(sources: DataFrame, write: Write = None) -> DataFrame:
    return parse(sources, find_modules, "offset long, title string, signature string, channels int, song_length int, patterns int, sample_bytes long, total_bytes long", write)


def png(width: int, height: int, pixels: bytes, palette: bytes) -> bytes:
    """An indexed PNG of one byte a pixel."""
    if len(pixels) != width * height or not palette or len(palette) % 3 or len(palette) > 768:
        raise FormatError("pixels or palette do not fit")
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[y * width : (y + 1) * width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 3, 0, 0, 0)) + part(b"PLTE", palette) + part(b"IDAT", zlib.compress(rows, 9)) + part(b"IEND", b"")


def wav(pcm: bytes, rate: int) -> bytes:
    """An 8-bit mono WAV of signed samples (which the format keeps unsigned)."""
    body = bytes(b ^ 0x80 for b in pcm)
    form = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    data = b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(data)) + data
