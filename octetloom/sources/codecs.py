"""Byte codecs. Each refuses a stream that does not fit, and an output past its limit."""

from __future__ import annotations

import re
from functools import cache

import numpy as np

from .table import FormatError

MAXIMUM_OUTPUT_BYTES = 64 << 20


@cache
def _crc16_table() -> tuple[int, ...]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xA001 if n & 1 else 0)
        out.append(n)
    return tuple(out)


def crc16(data: bytes) -> int:
    """CRC-16/ARC: reflected 0xA001, from 0."""
    table, crc = _crc16_table(), 0
    for b in data:
        crc = (crc >> 8) ^ table[(crc ^ b) & 255]
    return crc


#: Runs, and bytes between markers, that are expanded at once.
RUNS, WINDOW = 4096, 1 << 15
_STEPS = [n + 2 for n in range(128)] + [1] + [2] * 127
_REPEATS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray, copied: np.ndarray) -> bytes:
    """Pieces of ``data`` in turn: ``size`` bytes from ``start`` on if ``copied``,
    else so many times the byte there."""
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return data[np.repeat(start, size) + within * np.repeat(copied, size)].tobytes()


def byte_run1(data: bytes, limit: int = MAXIMUM_OUTPUT_BYTES) -> bytes:
    """PackBits: n >= 0 copies n + 1 bytes, -127 to -1 repeats one 1 - n times,
    -128 does nothing."""
    plain, out, at = np.frombuffer(data, np.uint8), bytearray(), 0
    while at < len(data):
        heads = []
        for _ in range(RUNS):
            heads.append(at)
            at += _STEPS[data[at]]
            if at >= len(data):
                break
        head = np.array(heads)
        n = plain[head].astype(np.int64)
        copied = n < 128
        size = np.where(copied, n + 1, np.where(n > 128, 257 - n, 0))
        cut = at > len(data)
        if len(out) + size[: len(size) - cut].sum() > limit:
            raise FormatError(f"output is larger than {limit}")
        if cut:
            raise FormatError(f"run cut short at {heads[-1] + 1}")
        some = size > 0
        out += _gathered(plain, head[some] + 1, size[some], copied[some])
    return bytes(out)


def pack_byte_run1(data: bytes) -> bytes:
    """Runs of three or more as repeats, the bytes between as copies."""
    out, at = bytearray(), 0
    for m in _REPEATS.finditer(data):
        _copies(out, data, at, m.start())
        at = m.end()
        out += bytes([257 - at + m.start(), data[m.start()]])
    _copies(out, data, at, len(data))
    return bytes(out)


def _copies(out: bytearray, data: bytes, at: int, end: int) -> None:
    for a in range(at, end, 128):
        out += bytes([min(end - a, 128) - 1]) + data[a : min(end, a + 128)]


def rle_xor(
    data: bytes, marker: int, xor: bool = True, inline_marker: bool = False, size_bytes: int = 0,
    size_includes_field: bool = False, limit: int = MAXIMUM_OUTPUT_BYTES,
) -> tuple[bytes, int | None]:
    """(decoded, declared size). Every byte is first XORed with its place; then
    an optional marker byte and big-endian size lead, and in what follows
    (marker, n, value) stands for n + 1 values."""
    if size_bytes not in (0, 2, 4) or size_includes_field and not size_bytes:
        raise FormatError("the size field is of 0, 2 or 4 bytes, and must be there to be counted")
    stream = xored(data) if xor else data
    at = 0
    if inline_marker:
        if not stream or stream[0] != marker:
            raise FormatError("the stream does not begin with its marker")
        at = 1
    declared = None
    if size_bytes:
        field = stream[at : at + size_bytes]
        if len(field) < size_bytes:
            raise FormatError("size field cut short")
        at += size_bytes
        declared = int.from_bytes(field, "big") - (size_bytes if size_includes_field else 0)
        if declared < 0:
            raise FormatError("the size is less than its own field")
    plain, out = np.frombuffer(stream, np.uint8), bytearray()
    while at < len(stream):
        end, marks, free = min(at + WINDOW, len(stream)), [], at
        for hit in (np.flatnonzero(plain[at:end] == marker) + at).tolist():
            if hit >= free:
                marks.append(hit)
                free = hit + 3
        cut = free > len(stream)
        mark = np.array(marks[: len(marks) - cut], np.int64)
        times = plain[mark + 1].astype(np.int64) + 1
        begin, after = np.concatenate([[at], mark + 3]), max(end, free)
        literal = np.concatenate([mark, [marks[-1] if cut else after]]) - begin
        start, size = np.empty(2 * len(mark) + 1, np.int64), np.empty(2 * len(mark) + 1, np.int64)
        start[::2], start[1::2], size[::2], size[1::2] = begin, mark + 2, literal, times
        total = len(out) + int(size.sum())
        if total - (int(literal[-1]) if cut else 0) > limit:
            raise FormatError(f"output is larger than {limit}")
        if cut:
            raise FormatError(f"run cut short at {marks[-1]}")
        out += _gathered(plain, start, size, np.arange(len(size)) % 2 == 0)
        at = after
    return bytes(out), declared


def xored(data: bytes) -> bytes:
    """Every byte XORed with the low eight bits of its place."""
    return (np.frombuffer(data, np.uint8) ^ np.resize(np.arange(256, dtype=np.uint8), len(data))).tobytes()


def power_packed(data: bytes, modes: tuple[int, int, int, int], limit: int = MAXIMUM_OUTPUT_BYTES) -> bytes:
    """A headerless stream read from its end: a last word of size (24 bits) and
    bits to skip (8), then literals and matches that fill the output backwards."""
    if any(not 1 <= m <= 31 for m in modes):
        raise FormatError("mode bits are from 1 to 31")
    if len(data) < 8 or len(data) % 4:
        raise FormatError("a stream is whole words, two at least")
    size, skip = int.from_bytes(data[-4:-1], "big"), data[-1]
    if not 0 < size <= min(limit, MAXIMUM_OUTPUT_BYTES):
        raise FormatError(f"declared output of {size} bytes is refused")
    if skip >= 32:
        raise FormatError("32 bits or more to skip")
    bits, out, left = _Backward(data[:-4]), bytearray(size), size
    bits.read(skip)
    while left:
        if not bits.read(1):
            count = 1 + 3 * bits.pairs()
            if count > left or (count := count + bits.read(2)) > left:
                raise FormatError("literals pass the output's start")
            out[left - count : left] = bits.read_bytes(count)[::-1]
            left -= count
            if not left:
                break
        mode = bits.read(2)
        if mode < 3:
            count, far = mode + 2, bits.read(modes[mode]) + 1
        else:
            far = bits.read(modes[3] if bits.read(1) else 7) + 1
            count = 5
            while True:
                more = bits.read(3)
                count += more
                if count > left or more != 7:
                    break
        if count > left or left + far > size:
            raise FormatError("a match leaves the output")
        if far >= count:
            out[left - count : left] = out[left - count + far : left + far]
            left -= count
            continue
        for _ in range(count):
            left -= 1
            out[left] = out[left + far]
    return bytes(out)


#: Bytes with their bits in reverse.
REVERSED = bytes(int(f"{n:08b}"[::-1], 2) for n in range(256))
_ONES = re.compile(rb"\xff*")


class _Backward:
    """Bits of 32-bit words from the last to the first, lowest bit first, which
    are those of the whole stream from its last to its first; the first bit read
    is the highest of the number returned."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data[::-1].translate(REVERSED), 0, 8 * len(data)

    def read(self, n: int) -> int:
        begin, stop = self.at, self.at + n
        if stop > self.end:
            raise FormatError("bit stream cut short")
        self.at = stop
        last = (stop + 7) >> 3
        return (int.from_bytes(self.data[begin >> 3 : last], "big") >> (8 * last - stop)) & ((1 << n) - 1)

    def read_bytes(self, n: int) -> bytes:
        return self.read(8 * n).to_bytes(n, "big")

    def pairs(self) -> int:
        """How many times two set bits come next; they are read."""
        ones = 0
        while self.at + ones < self.end:
            at = self.at + ones
            if at % 8 == 0 and (whole := _ONES.match(self.data, at // 8).end() - at // 8):
                ones += 8 * whole
            elif self.data[at >> 3] >> (7 - at % 8) & 1:
                ones += 1
            else:
                break
        self.at += ones // 2 * 2
        return ones // 2
