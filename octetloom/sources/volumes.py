"""Floppy volumes of 512-byte blocks, with old or fast file data."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from .table import FormatError, Write, parse

BLOCK = 512
HASH_SLOTS = 72
FILE, DIRECTORY = -3, 2


class Volume:
    """Header blocks are 128 big-endian words: type 2, own number, ..., and
    from the end: name at 432, next in hash chain 124, parent 125, extension
    126, secondary type 127."""

    def __init__(self, data: bytes):
        if not data or len(data) % BLOCK:
            raise FormatError("a volume is whole blocks")
        self.data, self.count = data, len(data) // BLOCK
        if data[:3] != b"DOS" and any(data[:4]):
            raise FormatError("no boot block")
        self.fast = bool(data[3] & 1) if data[:3] == b"DOS" else False
        self.root = self.count // 2
        if self.word(self.root, 0) != 2 or self.signed(self.root, 127) != 1:
            raise FormatError("no root block")
        self.warnings: list[str] = []
        if boot_checksum(data[:1024]) != 0xFFFFFFFF:
            self.warnings.append("boot block checksum")

    def word(self, block: int, at: int) -> int:
        if not 0 <= block < self.count:
            raise FormatError(f"block {block} is outside the volume")
        start = block * BLOCK + 4 * at
        return int.from_bytes(self.data[start : start + 4], "big")

    def words(self, block: int) -> tuple[int, ...]:
        self.word(block, 0)
        return struct.unpack_from(">128I", self.data, block * BLOCK)

    def signed(self, block: int, at: int) -> int:
        value = self.word(block, at)
        return value - (1 << 32) if value >> 31 else value

    def name(self, block: int) -> str:
        at = block * BLOCK + 432
        return self.data[at + 1 : at + 1 + min(self.data[at], 30)].decode("latin-1")

    def entries(self) -> list[tuple]:
        """(path, kind, block, size, warning) of everything, in order of path."""
        out, seen = [], set()

        def walk(block: int, prefix: str) -> None:
            for child in self.words(block)[6 : 6 + HASH_SLOTS]:
                while child:
                    if child in seen:
                        raise FormatError(f"block {child} is reached twice")
                    seen.add(child)
                    if self.word(child, 0) != 2 or sum(self.words(child)) & 0xFFFFFFFF:
                        raise FormatError(f"block {child} is no sound header")
                    kind, path = self.signed(child, 127), prefix + self.name(child)
                    if kind == FILE:
                        size, first = self.word(child, 81), self.word(child, 4)
                        out.append((path, "file", child, size, "stale data pointer" if not size and first else None))
                    elif kind == DIRECTORY:
                        out.append((path, "directory", child, 0, None))
                        walk(child, path + "/")
                    else:
                        raise FormatError(f"block {child} is of an unknown kind")
                    child = self.word(child, 124)

        walk(self.root, "")
        return sorted(out)

    def read(self, header: int) -> bytes:
        size = self.word(header, 81)
        if not size:
            return b""
        return self._fast(header, size) if self.fast else self._old(header, size)

    def _old(self, header: int, size: int) -> bytes:
        out, block, sequence, seen = bytearray(), self.word(header, 4), 1, set()
        while len(out) < size:
            if block in seen or self.word(block, 0) != 8 or self.word(block, 1) != header or self.word(block, 2) != sequence:
                raise FormatError(f"data block {block} is not part {sequence} of its file")
            seen.add(block)
            n = self.word(block, 3)
            if not 0 < n <= BLOCK - 24 or len(out) + n > size:
                raise FormatError(f"data block {block} does not fit its file")
            out += self.data[block * BLOCK + 24 : block * BLOCK + 24 + n]
            block, sequence = self.word(block, 4), sequence + 1
        return bytes(out)

    def _fast(self, header: int, size: int) -> bytes:
        out, table, seen = bytearray(), header, set()
        while len(out) < size:
            if table in seen:
                raise FormatError("extension blocks form a ring")
            seen.add(table)
            for k in range(min(self.word(table, 2), HASH_SLOTS)):  # the table is read from its end
                block = self.word(table, 77 - k)
                if not 0 < block < self.count:
                    raise FormatError(f"data block {block} is outside the volume")
                out += self.data[block * BLOCK : (block + 1) * BLOCK]
            if len(out) < size:
                table = self.word(table, 126)
                if not table:
                    raise FormatError("the file's blocks end too soon")
        return bytes(out[:size])


def boot_checksum(boot: bytes) -> int:
    """Sum of words with the carry added back; all ones when sound."""
    whole = len(boot) // 4 * 4
    total = sum(struct.unpack(f">{whole // 4}I", boot[:whole])) + int.from_bytes(boot[whole:], "big")
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


def read_boot(data: bytes) -> tuple:
    """(magic, flags, checksum_ok, root, code_sha256) of a boot block."""
    import hashlib

    if len(data) < 1024:
        raise FormatError("a boot block is 1,024 bytes")
    return (
        data[:3].decode("latin-1"), data[3], boot_checksum(data[:1024]) == 0xFFFFFFFF,
        int.from_bytes(data[8:12], "big"), hashlib.sha256(data[12:1024]).hexdigest(),
    )


def listing(sources: DataFrame, write: Write = None) -> DataFrame:
    return parse(sources, lambda c: Volume(c).entries(), "path string, kind string, block long, size long, warning string", write)


def contents(sources: DataFrame, write: Write = None) -> DataFrame:
    """Every file of the volumes: (path, size, content)."""

    def files(data: bytes):
        volume = Volume(data)
        return [(path, size, volume.read(block)) for path, kind, block, size, _ in volume.entries() if kind == "file"]

    return parse(sources, files, "path string, size long, content binary", write)


def boots(sources: DataFrame, write: Write = None) -> DataFrame:
    return parse(sources, lambda c: [read_boot(c)], "magic string, flags int, checksum_ok boolean, root long, code_sha256 string", write)
