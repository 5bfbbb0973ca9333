"""Writers of the formats that the readers take, for exports and round trips."""

from __future__ import annotations

import struct

import numpy as np

from .codecs import REVERSED, RUNS, crc16, pack_byte_run1, xored
from .media import PIXELS
from .table import FormatError
from .volumes import BLOCK, FILE, HASH_SLOTS, boot_checksum


def _u32(*words: int) -> bytes:
    return struct.pack(f">{len(words)}I", *words)


def load_file(hunks: list[tuple[str, bytes]], relocations: dict[int, list[tuple[int, list[int]]]] | None = None) -> bytes:
    """A load file of (code | data, bytes) hunks; ``relocations`` maps a hunk to
    (target hunk, offsets). Bytes are padded to whole words."""
    bodies = [(kind, data + bytes(-len(data) % 4)) for kind, data in hunks]
    out = [_u32(0x3F3, 0, len(bodies), 0, len(bodies) - 1, *[len(d) // 4 for _, d in bodies])]
    for i, (kind, data) in enumerate(bodies):
        out.append(_u32({"code": 0x3E9, "data": 0x3EA}[kind], len(data) // 4) + data)
        if entries := (relocations or {}).get(i):
            out.append(_u32(0x3EC) + b"".join(_u32(len(at), target, *at) for target, at in entries) + _u32(0))
        out.append(_u32(0x3F2))
    return b"".join(out)


def stored_member(path: str, data: bytes) -> bytes:
    """One archive member, stored, with a header of level 0."""
    name = path.replace("/", "\\").encode("latin-1")
    if len(name) > 230:
        raise FormatError("the name is too long for its header")
    body = b"-lh0-" + struct.pack("<II", len(data), len(data)) + bytes(4) + b"\x20\0" + bytes([len(name)]) + name + struct.pack("<H", crc16(data))
    return bytes([len(body), sum(body) & 255]) + body + data


def archive(members: list[tuple[str, bytes]]) -> bytes:
    return b"".join(stored_member(p, d) for p, d in members) + b"\0"


def volume(files: list[tuple[str, bytes]], blocks: int | None = None) -> bytes:
    """An old-style volume with ``files`` (names without folders) in its root."""
    if len(files) > HASH_SLOTS:
        raise FormatError("more files than the root's table has places")
    room = BLOCK - 24
    parts = [[d[i : i + room] for i in range(0, len(d), room)] for _, d in files]
    need = sum(1 + len(p) for p in parts)
    count = blocks or 2 * (need + 3)
    root = count // 2
    free = (b for b in range(2, count) if b != root)
    data = bytearray(count * BLOCK)
    data[:4] = b"DOS\0"

    def put(block: int, words: dict[int, int], name: str = "", payload: bytes = b"") -> None:
        raw = bytearray(BLOCK)
        for i, v in words.items():
            struct.pack_into(">I", raw, 4 * i, v & 0xFFFFFFFF)
        if name:
            text = name.encode("latin-1")[:30]
            raw[432 : 433 + len(text)] = bytes([len(text)]) + text
        raw[24 : 24 + len(payload)] = payload or raw[24:24]
        struct.pack_into(">I", raw, 20, -sum(struct.unpack(">128I", raw)) & 0xFFFFFFFF)
        data[block * BLOCK : (block + 1) * BLOCK] = raw

    table = {}
    for slot, ((name, body), pieces) in enumerate(zip(files, parts)):
        head = next(free)
        own = [next(free) for _ in pieces]
        table[6 + slot] = head
        put(head, {0: 2, 1: head, 4: own[0] if own else 0, 81: len(body), 127: FILE}, name)
        for i, (block, piece) in enumerate(zip(own, pieces)):
            put(block, {0: 8, 1: head, 2: i + 1, 3: len(piece), 4: own[i + 1] if i + 1 < len(own) else 0}, payload=piece)
    put(root, {0: 2, 3: HASH_SLOTS, 127: 1} | table, "Volume")
    struct.pack_into(">I", data, 4, 0xFFFFFFFF - boot_checksum(bytes(data[:1024])))
    return bytes(data)


def form(kind: bytes, parts: list[tuple[bytes, bytes]]) -> bytes:
    body = kind + b"".join(k + struct.pack(">I", len(d)) + d + bytes(len(d) & 1) for k, d in parts)
    return b"FORM" + struct.pack(">I", len(body)) + body


def sample(name: str, rate: int, pcm: bytes) -> bytes:
    """An 8SVX form that is played once."""
    head = struct.pack(">IIIHBBI", len(pcm), 0, 0, rate, 1, 0, 65536)
    return form(b"8SVX", [(b"VHDR", head), (b"NAME", name.encode("latin-1")), (b"BODY", pcm)])


def picture(width: int, height: int, planes: int, pixels: bytes, palette: bytes) -> bytes:
    """An ILBM form of index pixels, packed by ByteRun1."""
    if len(pixels) < width * height:
        raise FormatError("the pixels are too few")
    row = (width + 15) // 16 * 2
    lines, step = np.frombuffer(pixels, np.uint8, width * height).reshape(height, width), max(1, PIXELS // max(width, 1))
    rows = []
    for y in range(0, height, step):
        some = lines[y : y + step]
        packed = np.zeros((len(some), planes, row), np.uint8)
        for p in range(planes):
            packed[:, p, : (width + 7) // 8] = np.packbits(some >> p & 1, axis=1)
        if 0 < row <= 2:  # too short for a repeat
            packed = np.insert(packed, 0, row - 1, axis=2)
            rows.append(packed.tobytes())
        else:
            rows += [pack_byte_run1(r.tobytes()) for r in packed.reshape(-1, row)]
    head = struct.pack(">HHhhBBBBHBBhh", width, height, 0, 0, planes, 0, 1, 0, 0, 1, 1, width, height)
    return form(b"ILBM", [(b"BMHD", head), (b"CMAP", palette), (b"BODY", b"".join(rows))])


def pack_rle_xor(data: bytes, marker: int, xor: bool = True) -> bytes:
    """The marker first, then a 4-byte size that counts itself, then the runs."""
    out, at = bytearray([marker]) + (len(data) + 4).to_bytes(4, "big"), 0
    first, size = _marked(np.frombuffer(data, np.uint8), marker) if data else ([], [])
    for lo in range(0, len(first), RUNS):
        for begin, n in zip(first[lo : lo + RUNS].tolist(), size[lo : lo + RUNS].tolist()):
            out += data[at:begin]
            out += bytes((marker, n - 1, data[begin]))
            at = begin + n
    out += data[at:]
    return xored(bytes(out)) if xor else bytes(out)


def _marked(plain: np.ndarray, marker: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of what is written as runs: those of more than three
    equal bytes, and the marker always, 256 at most."""
    held, equal = plain == marker, plain[1:] == plain[:-1]
    four = equal[:-2] & equal[1:-1] & equal[2:]
    for k in range(4):
        held[k : k + len(four)] |= four
    begin = np.flatnonzero(held & np.concatenate([[True], ~equal]))
    end = np.flatnonzero(held & np.concatenate([~equal, [True]])) + 1
    parts = (end - begin + 255) // 256
    first = np.repeat(begin - 256 * (np.cumsum(parts) - parts), parts) + 256 * np.arange(parts.sum())
    size = np.minimum(np.repeat(end, parts) - first, 256)
    kept = (size > 3) | (plain[first] == marker)
    return first[kept], size[kept]


def power_pack(data: bytes) -> bytes:
    """A headerless stream of literals only, in runs that need no matches: the
    whole output is one literal run."""
    if not 0 < len(data) < 1 << 24:
        raise FormatError("a stream holds 1 byte to 16 MB")
    threes, rest = divmod(len(data) - 1, 3)
    # The bits in reverse: the bytes from first to last, then what comes before them.
    tail = int(f"{rest:02b}"[::-1], 2) << 2 * threes | (1 << 2 * threes) - 1
    skip = -(8 * len(data) + 2 * threes + 3) % 32
    size = 2 * threes + 3 + skip
    return data.translate(REVERSED) + (tail << 1 + skip).to_bytes(size // 8, "big") + len(data).to_bytes(3, "big") + bytes([skip])
