"""A bitwise language model: online logistic mixing of hashed contexts.

Symbols (words, or the bytes of a word) are spelled in the bits of a Huffman
code. Several predictors give each bit's log odds from the counts that their
context saw at this place of the code; weights gated by the place's depth and
the last predictor's experience add them up, and an adaptive map refines the
probability.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: How often the last predictor saw its context, in levels by these bounds.
LEVELS = (1, 2, 4, 8, 20, 60, 200)
#: Depths in the code that have weights of their own; deeper ones share the last.
DEPTHS = 12
GATES = DEPTHS * (len(LEVELS) + 1)
#: Steps of the adaptive probability map along the mixer's log odds.
STEPS = 33
#: Slots of the counts that travel together.
SLICE = 1 << 16
#: Symbols of a learner's first block and of its largest one; each is twice the one before.
FIRST_BLOCK, LARGEST_BLOCK = 1 << 11, 1 << 19
#: Bits that are looked up together.
STRIDE = 1 << 15
PRIOR = np.float32(0.4)
#: Memory of the mixer's curvature from block to block, and its damping.
KEEP, DAMP = 0.98, 50.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_32 = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))
SPACE = b" "
#: Packs the parts of counts.
_CODEC = "zstd"


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased; bytes know ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of an array of strings or binaries without nulls, where each begins and the last ends)."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, ends, data = values.buffers()
    if not len(values) or not ends:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(values) + 1, dtype=np.int64)
    at = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(how many words each text has, the words of all texts in order): those of ``words_of``."""
    data, at = bytes_of(texts.fill_null(""))
    data = np.where(data - np.uint8(ord("A")) < 26, data + np.uint8(32), data)
    solid = (data != ord(" ")) & (data - np.uint8(ord("\t")) > 4)
    before = np.zeros_like(solid)
    before[1:] = solid[:-1]
    before[at[:-1][at[:-1] < at[-1]]] = False  # words end with their text
    starts = np.flatnonzero(solid > before)
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    if len(starts):
        np.cumsum(np.add.reduceat(solid, starts, dtype=np.int32), out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    return np.diff(np.searchsorted(starts, at)), words


class Code:
    """The Huffman code of symbols 0.. with these weights (ties by number):
    for each symbol a run of places, each with the bit in bit 0, its depth in
    bits 1 to 4, and the node of the tree above."""

    def __init__(self, weights: list[int]):
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side = np.zeros(max(2 * n - 1, 1), dtype=np.int64), np.zeros(max(2 * n - 1, 1), dtype=bool)
        new = n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[[i, j]], side[j] = new, True
            heapq.heappush(heap, (a + b, new))
            new += 1
        self.nodes = max(n - 1, 1)
        paths = []
        at, depth = np.arange(n), np.zeros(n, dtype=np.int64)
        while True:
            some = at < new - 1
            if not some.any():
                break
            paths.append((np.where(some, parent[at] - n, -1), side[at]))
            depth += some
            at = np.where(some, parent[at], at)
        self.size = depth.astype(np.int32)
        self.start = (depth.cumsum() - depth).astype(np.int32)
        total = int(depth.sum())
        self.places = np.zeros(total, dtype=np.int32)
        for up, (node, bit) in enumerate(paths):  # leaf first
            some = np.flatnonzero(node >= 0)
            level = depth[some] - 1 - up
            place = self.start[some] + level
            self.places[place] = (node[some] << 5) | (np.minimum(level, DEPTHS - 1) << 1) | bit[some]


@dataclass(frozen=True)
class Predictor:
    """Slots of a predictor: ``contexts`` times the code's nodes, or 2**bits hashed ones."""

    contexts: int = 0
    bits: int = 0


class Shape:
    """A code and its predictors, whose slots lie behind each other."""

    def __init__(self, code: Code, predictors: list[Predictor]):
        self.code, self.predictors = code, predictors
        sizes = [p.contexts * code.nodes if p.contexts else 1 << p.bits for p in predictors]
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.slots = int(self.base[-1])

    def bits(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Pieces of (symbols, each one's number of bits, the bits, their depth, slots by predictor)."""
        code, heads = self.code, []
        for p, base, c in zip(self.predictors, self.base, contexts):
            if p.contexts:
                heads.append((c * code.nodes + base).astype(np.int32))
            else:
                h = (c.astype(np.uint64) + np.uint64(1)) * _ODD
                heads.append((h >> np.uint64(32)).astype(np.uint32))
        many = max(1, int(STRIDE / max(1, code.size[symbols].mean()))) if len(symbols) else 1
        for i in range(0, len(symbols), many):
            piece = slice(i, i + many)
            some = symbols[piece]
            size = code.size[some]
            ends = size.cumsum(dtype=np.int32)
            place = np.repeat(code.start[some] - ends + size, size)
            place += np.arange(len(place), dtype=np.int32)
            packed = _at(code.places, place)
            node, slots = packed >> 5, []
            key = node.view(np.uint32) * _ODD_32[1]
            for p, base, head in zip(self.predictors, self.base, heads):
                h = np.repeat(head[piece], size)
                if not p.contexts:
                    h ^= key
                    h ^= h >> np.uint32(15)
                    h *= _ODD_32[0]
                    h >>= np.uint32(32 - p.bits)
                # Look-ups turn other kinds of index into this one, each time.
                slots.append(np.add(h, node if p.contexts else base, dtype=np.intp))
            yield piece, size, (packed & 1).astype(np.float32), (packed >> 1) & 15, slots


def _at(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """``table[index]`` of an index that is in range; faster, as it isn't checked."""
    return table.take(index, mode="clip")


def _dot(inputs: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = _at(weights[0], gate) * inputs[0]
    for w, x in zip(weights[1:], inputs[1:]):
        out += _at(w, gate) * x
    return np.clip(out, -14, 14, out=out)


def _squash(dot: np.ndarray) -> np.ndarray:
    p = np.exp(-dot)
    p += 1
    return np.divide(1, p, out=p)


def _gate(depth: np.ndarray, level: np.ndarray) -> np.ndarray:
    return level * DEPTHS + depth.astype(np.intp)


def _map_index(gate: np.ndarray, dot: np.ndarray) -> np.ndarray:
    return gate * STEPS + (dot * np.float32(1.5) + np.float32(STEPS // 2 + 0.5)).clip(0, STEPS - 1).astype(np.intp)


_LEVEL_OF = np.searchsorted(LEVELS, np.arange(LEVELS[-1] + 1), side="right")


def _level(seen: np.ndarray) -> np.ndarray:
    return _LEVEL_OF.take(seen, mode="clip")  # beyond the last bound: the last level


class Learner:
    """Learns a shape's model from symbols block by block. Each block is
    predicted from the counts of what comes before, and so moves the mixing
    weights and the probability map; then it is counted. Equal symbols in equal
    contexts are handled once a block, with their number."""

    def __init__(self, shape: Shape):
        self.shape, inputs = shape, len(shape.predictors)
        # A slot's two counts in one number: zeros in the low half, ones in the high.
        self.counts = np.zeros(shape.slots, dtype=np.uint64)
        self.weights = np.full((inputs, GATES), 1.2 / inputs)
        self.bend = np.zeros((GATES, inputs, inputs))
        self.map = np.zeros((2, GATES * STEPS), dtype=np.int64)
        self.mixed = 0
        self.waiting: list[list[np.ndarray]] = []
        self.size, self.block = 0, FIRST_BLOCK

    def add(self, symbols: np.ndarray, contexts: list[np.ndarray], key: np.ndarray) -> None:
        """Take symbols and, for each predictor, their contexts (from 0);
        ``key`` is one number for each combination of these."""
        rows = [key, symbols, *contexts]
        while len(rows[0]):
            n = self.block - self.size
            self.waiting.append([x[:n] for x in rows])
            self.size += len(self.waiting[-1][0])
            rows = [x[n:] for x in rows]
            if self.size == self.block:
                self.flush()
                self.block = min(2 * self.block, LARGEST_BLOCK)

    def flush(self) -> None:
        if self.size:
            key, symbols, *contexts = (np.concatenate(x) for x in zip(*self.waiting))
            self.waiting, self.size = [], 0
            at, ends, _ = distinct(key)
            self._see(symbols[at], [c[at] for c in contexts], np.diff(ends, prepend=0))

    def _see(self, symbols: np.ndarray, contexts: list[np.ndarray], times: np.ndarray) -> None:
        for piece, size, bit, depth, slots in self.shape.bits(symbols, contexts):
            often = np.repeat(times[piece], size)
            self._mix(bit, depth, slots, often)
            add = often.astype(np.uint64) << (bit.astype(np.uint64) << np.uint64(5))
            for s in slots:
                np.add.at(self.counts, s, add)

    def _mix(self, bit: np.ndarray, depth: np.ndarray, slots: list[np.ndarray], often: np.ndarray) -> None:
        inputs = []
        for s in slots:
            seen = _at(self.counts, s).view(np.uint32)
            odds = seen[1::2].astype(np.float32)
            odds += PRIOR
            odds /= seen[::2].astype(np.float32) + PRIOR
            inputs.append(np.log(odds, out=odds))
        before = seen[1::2] + seen[::2]
        gate = _gate(depth, _level(before))
        dot = _dot(inputs, gate, self.weights.astype(np.float32))
        p = _squash(dot)
        # Of a new context's repeats only the first meets these counts.
        each = np.minimum(often, 1 + before).astype(np.float32)
        error, spread = (bit - p) * each, p * (1 - p) * each
        # An online Newton step for each weight set, by a fading memory of curvature.
        slope = np.stack([np.bincount(gate, error * x, minlength=GATES) for x in inputs], axis=1)
        bend = np.zeros_like(self.bend)
        for i, x in enumerate(inputs):
            scaled = spread * x
            for j, y in enumerate(inputs[: i + 1]):
                bend[:, i, j] = bend[:, j, i] = np.bincount(gate, scaled * y, minlength=GATES)
        self.bend = KEEP * self.bend + bend
        step = np.linalg.solve(self.bend + DAMP * np.eye(len(inputs)), slope[:, :, None])[:, :, 0]
        self.weights = np.clip(self.weights + step.T, -1.0, 2.0)
        index = _map_index(gate, dot)
        both = np.bincount(2 * index + bit.astype(np.intp), each, minlength=self.map.size)
        self.map += both.reshape(-1, 2).T.astype(np.int64)
        self.mixed += len(bit)

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """What was learnt, as (number, packed) parts that ``add_part`` adds up."""
        self.flush()
        for k in range(0, self.shape.slots, SLICE):
            part = self.counts[k : k + SLICE]
            some = np.flatnonzero(part)
            if len(some):
                yield k // SLICE, _packed(some, part[some].view(np.uint32).reshape(-1, 2))
        if self.mixed:
            yield -1, np.concatenate([[self.mixed], (self.weights * self.mixed).ravel()]).tobytes()
            yield -2, self.map.tobytes()


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct key, in order; where it ends in the order; the
    order). Near keys come together, and so do many of their slots."""
    order = np.argsort(key)
    ends = np.flatnonzero(np.diff(key[order], append=key[order[-1:]] + 1)) + 1
    return order[ends - 1], ends, order


def _packed(some: np.ndarray, counts: np.ndarray) -> bytes:
    """Slots as gaps, their counts as two half bytes; larger counts behind."""
    gap = np.diff(some, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2)
    large = (counts >= 15).any(axis=1)
    code = np.where(large, 255, (np.minimum(counts[:, 0], 15) << 4) | np.minimum(counts[:, 1], 15)).astype(np.uint8)
    head = np.array([len(some)], dtype="<u4")
    raw = b"".join(x.tobytes() for x in (head, gap[:, 0], gap[:, 1], code, counts[large].astype("<u4")))
    return len(raw).to_bytes(4, "little") + pa.compress(raw, _CODEC, asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), _CODEC, asbytes=True)
    n = int(np.frombuffer(raw[:4], dtype="<u4")[0])
    low, high, code = np.frombuffer(raw[4 : 4 + 3 * n], dtype=np.uint8).reshape(3, n).astype(np.int64)
    counts = np.stack([code >> 4, code & 15], axis=1)
    counts[code == 255] = np.frombuffer(raw[4 + 3 * n :], dtype="<u4").reshape(-1, 2)
    return (low + (high << 8)).cumsum(), counts


def add_part(total: np.ndarray | None, number: int, data: bytes) -> np.ndarray:
    if number < 0:
        part = np.frombuffer(data, dtype=np.float64 if number == -1 else np.int64)
        return part.copy() if total is None else total + part
    some, counts = _unpacked(data)
    if total is None:
        total = np.zeros((SLICE, 2), dtype=np.int64)
    total[some] += counts
    return total


def finish_part(number: int, total: np.ndarray) -> bytes:
    """A part as the finished model keeps it: log odds, and levels of experience."""
    if number < 0:
        return total.tobytes()
    odds = np.log(total[:, 1] + float(PRIOR)) - np.log(total[:, 0] + float(PRIOR))
    # The lowest bits of a number's fraction hold the level.
    return ((odds.astype(np.float32).view(np.int32) & ~7) | _level(total.sum(axis=1))).astype(np.int32).tobytes()


class Model:
    """A finished model, from its parts (missing ones were never seen). A slot's
    number is its log odds, with the level of experience in the lowest bits."""

    def __init__(self, shape: Shape, parts: dict[int, bytes]):
        self.shape, inputs = shape, len(shape.predictors)
        odds = np.zeros((-(-shape.slots // SLICE), SLICE), dtype=np.float32)
        for k in range(len(odds)):
            if k in parts:
                odds[k] = np.frombuffer(parts[k], dtype=np.float32)
        self.odds = odds.reshape(-1)
        self.weights = np.full((inputs, GATES), 1.2 / inputs, dtype=np.float32)
        if -1 in parts:
            sums = np.frombuffer(parts[-1], dtype=np.float64)
            self.weights = (sums[1:] / sums[0]).reshape(inputs, GATES).astype(np.float32)
        seen = np.zeros((2, GATES * STEPS), dtype=np.int64)
        if -2 in parts:
            seen = np.frombuffer(parts[-2], dtype=np.int64).reshape(seen.shape)
        start = 1 / (1 + np.exp(-np.tile((np.arange(STEPS) - STEPS // 2) / 1.5, GATES)))
        self.map = ((seen[1] + 8 * start) / (seen.sum(axis=0) + 8)).astype(np.float32)

    def logs(self, symbols: np.ndarray, contexts: list[np.ndarray], key: np.ndarray) -> np.ndarray:
        """Log10 probability of each symbol in its contexts (``key`` as for a learner)."""
        at, ends, order = distinct(key)
        out = np.zeros(len(at))
        for piece, size, bit, depth, slots in self.shape.bits(symbols[at], [c[at] for c in contexts]):
            inputs = [_at(self.odds, s) for s in slots]
            gate = _gate(depth, inputs[-1].view(np.int32) & 7)
            dot = _dot(inputs, gate, self.weights)
            p = _squash(dot)
            p += _at(self.map, _map_index(gate, dot))
            p /= 2
            bit -= 1
            p += bit  # p where the bit is 1, p - 1 where it is 0
            logs = np.log10(np.abs(p, out=p), out=p)
            some = np.flatnonzero(size)
            if len(some):
                out[piece][some] = np.add.reduceat(logs, (size.cumsum() - size)[some], dtype=np.float64)
        each = np.empty(len(key))
        each[order] = np.repeat(out, np.diff(ends, prepend=0))
        return each
