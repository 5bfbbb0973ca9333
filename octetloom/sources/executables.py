"""Load files made of hunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .table import FormatError, Write, parse

HEADER, CODE, DATA, BSS, RELOC32, SYMBOL, DEBUG, END, UNIT, NAME = 0x3F3, 0x3E9, 0x3EA, 0x3EB, 0x3EC, 0x3F0, 0x3F1, 0x3F2, 0x3E7, 0x3E8
KINDS = {CODE: "code", DATA: "data", BSS: "bss"}
_TAG = 0x3FFFFFFF


class _Words:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self) -> int:
        if self.at + 4 > len(self.data):
            raise FormatError(f"file cut short at {self.at}")
        return int.from_bytes(self.data[self.at : self.at + 4], "big")

    def next(self) -> int:
        value = self.peek()
        self.at += 4
        return value

    def take(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise FormatError(f"file cut short at {self.at}")
        self.at += size
        return self.data[self.at - size : self.at]


def read_hunks(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(segments, relocations): (hunk, kind, allocation, file_offset, bytes) and
    (source_hunk, source_offset, target_hunk, stored_offset)."""
    words = _Words(data)
    if words.next() != HEADER:
        raise FormatError("no load file")
    while n := words.next():  # names of resident libraries
        words.take(4 * n)
    count, first, last = words.next(), words.next(), words.next()
    if last < first or count != last - first + 1:
        raise FormatError("the hunk table's size does not fit its range")
    if 4 * count > len(data):
        raise FormatError("file cut short in its table")
    sizes = [4 * (words.next() & _TAG) for _ in range(count)]
    segments, relocations = [], []
    for hunk, allocation in enumerate(sizes, first):
        while words.peek() & _TAG in (NAME, UNIT):
            words.next()
            words.take(4 * words.next())
        tag = words.next() & _TAG
        if tag not in KINDS:
            raise FormatError(f"hunk {hunk} begins with {tag:#x}")
        size = 4 * words.next()
        if size > allocation:
            raise FormatError(f"hunk {hunk} is larger than its memory")
        offset = words.at
        body = b"" if tag == BSS else words.take(size)
        segments.append((hunk, KINDS[tag], allocation, offset, body))
        while words.at < len(data):
            tag = words.peek() & _TAG
            if tag in KINDS or tag in (NAME, UNIT):
                break
            words.next()
            if tag == END:
                break
            if tag == RELOC32:
                while n := words.next():
                    target = words.next()
                    if not first <= target <= last:
                        raise FormatError(f"relocation to hunk {target}, which is not there")
                    for _ in range(n):
                        at = words.next()
                        if at + 4 > allocation:
                            raise FormatError(f"relocation past hunk {hunk}'s end")
                        stored = int.from_bytes(body[at : at + 4], "big") if at + 4 <= len(body) else None
                        relocations.append((hunk, at, target, stored))
            elif tag == SYMBOL:
                while n := words.next():
                    words.take(4 * (n & 0xFFFFFF) + 4)
            elif tag == DEBUG:
                words.take(4 * words.next())
            else:
                raise FormatError(f"unknown record {tag:#x} in hunk {hunk}")
    if words.at != len(data):
        raise FormatError("bytes behind the last hunk")
    return segments, relocations


def segments(sources: DataFrame, write: Write = None) -> DataFrame:
    return parse(sources, lambda c: read_hunks(c)[0], "hunk long, kind string, allocation long, file_offset long, content binary", write)


def relocations(sources: DataFrame, write: Write = None) -> DataFrame:
    return parse(sources, lambda c: read_hunks(c)[1], "source_hunk long, source_offset long, target_hunk long, stored_offset long", write)
