"""LHA archives: headers of levels 0 to 2, members stored or of methods lh4 to lh7."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .codecs import crc16
from .table import FormatError, Write, parse

#: Bits of the dictionary of each method that is unpacked.
WINDOWS = {"-lh4-": 12, "-lh5-": 13, "-lh6-": 15, "-lh7-": 16}
STORED = ("-lh0-", "-lz4-")
LITERALS, CODES, THRESHOLD = 256, 510, 3


def members(data: bytes) -> list[tuple]:
    """(path, method, packed, size, crc, level, data_offset) of each member."""
    out, at = [], 0
    while at < len(data):
        first = data[at]
        level = data[at + 20] if at + 20 < len(data) else None
        if level is None or (level < 2 and first == 0) or (level == 2 and data[at : at + 2] == b"\0\0"):
            if first == 0 and (at or len(data) == 1):
                break  # the end mark
            raise FormatError(f"no member header at {at}")
        if level > 2:
            raise FormatError(f"headers of level {level} are not read")
        method = data[at + 2 : at + 7].decode("latin-1")
        packed = int.from_bytes(data[at + 7 : at + 11], "little")
        size = int.from_bytes(data[at + 11 : at + 15], "little")
        if method[:1] != "-" or method[-1:] != "-":
            raise FormatError(f"no method at {at}")
        name, folder = "", ""
        if level < 2:
            n = data[at + 21]
            name = data[at + 22 : at + 22 + n].decode("latin-1")
            crc = int.from_bytes(data[at + 22 + n : at + 24 + n], "little")
            if sum(data[at + 2 : at + 2 + first]) & 255 != data[at + 1]:
                raise FormatError(f"header checksum at {at}")
            body = at + 2 + first
            following = int.from_bytes(data[body - 2 : body], "little") if level == 1 else 0
        else:
            crc = int.from_bytes(data[at + 21 : at + 23], "little")
            following, body = int.from_bytes(data[at + 24 : at + 26], "little"), at + 26
        extra = 0
        while following:
            part = data[body : body + following]
            if len(part) < following or following < 3:
                raise FormatError(f"extended header cut short at {body}")
            kind, text = part[0], part[1:-2]
            if kind == 1:
                name = text.decode("latin-1")
            elif kind == 2:
                folder = text.replace(b"\xff", b"/").decode("latin-1")
            body, extra = body + following, extra + following
            following = int.from_bytes(part[-2:], "little")
        if level == 1:
            packed -= extra
        elif level == 2:
            body = at + int.from_bytes(data[at : at + 2], "little")
        if packed < 0 or body + packed > len(data):
            raise FormatError(f"member cut short at {body}")
        path = (folder.rstrip("/") + "/" if folder else "") + name.replace("\\", "/")
        out.append((path, method, packed, size, crc, level, body))
        at = body + packed
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.have = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.have < n:
            self.value = (self.value << 8) | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.have += 8
            if self.at > len(self.data) + 8:
                raise FormatError("packed data cut short")
        return (self.value >> (self.have - n)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.peek(n)
        self.have -= n
        self.value &= (1 << self.have) - 1

    def read(self, n: int) -> int:
        value = self.peek(n) if n else 0
        if n:
            self.skip(n)
        return value


class _Code:
    """A canonical prefix code from lengths; a single symbol needs no bits."""

    def __init__(self, lengths: list[int], only: int | None = None):
        self.only, self.symbols = only, {}
        code = 0
        for n in range(1, 17):
            for s, length in enumerate(lengths):
                if length == n:
                    if code >> n:
                        raise FormatError("a prefix code with too many symbols")
                    self.symbols[n, code] = s
                    code += 1
            code <<= 1

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        for n in range(1, 17):
            if (s := self.symbols.get((n, bits.peek(n)))) is not None:
                bits.skip(n)
                return s
        raise FormatError("a code that stands for nothing")


def _length(bits: _Bits) -> int:
    n = bits.read(3)
    if n == 7:
        while bits.read(1):
            n += 1
            if n > 16:
                raise FormatError("a code length over 16")
    return n


def _small_code(bits: _Bits, width: int, gap_after: int | None) -> _Code:
    n = bits.read(width)
    if not n:
        return _Code([], bits.read(width))
    lengths: list[int] = []
    while len(lengths) < n:
        lengths.append(_length(bits))
        if len(lengths) == gap_after:
            lengths += [0] * bits.read(2)
    return _Code(lengths)


def _main_code(bits: _Bits, small: _Code) -> _Code:
    n = bits.read(9)
    if not n:
        return _Code([], bits.read(9))
    lengths: list[int] = []
    while len(lengths) < n:
        s = small.read(bits)
        lengths += [0] * (1 if s == 0 else bits.read(4) + 3 if s == 1 else bits.read(9) + 20) if s < 3 else [s - 2]
    return _Code(lengths)


def unpack(data: bytes, method: str, size: int) -> bytes:
    """Blocks of prefix-coded literals and matches within a sliding window."""
    if method in STORED:
        return data[:size]
    if method not in WINDOWS:
        raise FormatError(f"method {method} is not unpacked")
    window = WINDOWS[method]
    width = 4 if window <= 13 else 5
    bits, out = _Bits(data), bytearray()
    while len(out) < size:
        count = bits.read(16)
        small = _small_code(bits, 5, 3)
        main = _main_code(bits, small)
        places = _small_code(bits, width, None)
        for _ in range(count):
            if len(out) >= size:
                break
            c = main.read(bits)
            if c < LITERALS:
                out.append(c)
                continue
            n, p = c - LITERALS + THRESHOLD, places.read(bits)
            far = (1 << (p - 1)) + bits.read(p - 1) + 1 if p > 1 else p + 1
            for _ in range(n):
                out.append(out[-far] if far <= len(out) else 0x20)
    return bytes(out[:size])


def extract(data: bytes) -> list[tuple]:
    """(path, method, size, content) of members that can be unpacked; each is
    checked against its size and CRC. Others keep null content."""
    out = []
    for path, method, packed, size, crc, _, at in members(data):
        if method == "-lhd-":
            continue
        content = None
        if method in STORED or method in WINDOWS:
            content = unpack(data[at : at + packed], method, size)
            if len(content) != size or crc16(content) != crc:
                raise FormatError(f"{path} is damaged")
        out.append((path, method, size, content))
    return out


def listing(sources: DataFrame, write: Write = None) -> DataFrame:
    return parse(sources, members, "path string, method string, packed long, size long, crc int, level int, data_offset long", write)


def contents(sources: DataFrame, write: Write = None) -> DataFrame:
    return parse(sources, extract, "path string, method string, size long, content binary", write)
