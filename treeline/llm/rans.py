"""Static range asymmetric numeral system over many interleaved lanes.

A block holds whole documents and is coded on its own: its ids are dealt to the lanes in turn,
each lane is one 64-bit state, and all states of a step are advanced together. Coding runs
backwards, so decoding runs forwards. Every `stride` steps the states and the place in the word
stream are kept as a checkpoint, with a checksum of the ids up to the next one, so that each
stretch can be decoded alone.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
LANES = 1024
STRIDE = 256
LOW = np.uint64(1 << 32)
HALF = np.uint64(32)
HEAD = "<8sIIIIII"
HEAD_BYTES = struct.calcsize(HEAD)
MARK = b"TLRANS01"


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2**BITS, their running sums, and the symbol of each slot."""

    freq: np.ndarray
    base: np.ndarray
    crc: int

    @staticmethod
    def fit(counts: np.ndarray, bits: int = BITS) -> Table:
        """Scale counts; every seen symbol keeps a slot, and one slot stays free, so no
        frequency reaches the total."""
        counts = np.asarray(counts, np.float64)
        room, seen = (1 << bits) - 1, counts > 0
        if seen.sum() > room:
            raise ValueError("more symbols than slots")
        freq = np.zeros(len(counts), np.int64)
        if seen.any():
            share = counts[seen] / counts[seen].sum() * (room - seen.sum())
            part = np.floor(share).astype(np.int64)
            order = np.lexsort((np.arange(len(part)), part - share))
            part[order[: room - seen.sum() - part.sum()]] += 1
            freq[seen] = part + 1
        return Table.of(freq)

    @staticmethod
    def of(freq: np.ndarray) -> Table:
        freq = np.asarray(freq, np.uint32)
        base = np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)[:-1]]).astype(np.uint64)
        return Table(freq.astype(np.uint64), base, zlib.crc32(freq.astype("<u4").tobytes()))

    def symbols(self, bits: int = BITS) -> np.ndarray:
        out = np.zeros(1 << bits, np.uint16 if len(self.freq) <= 1 << 16 else np.uint32)
        filled = np.repeat(np.arange(len(self.freq), dtype=out.dtype), self.freq.astype(np.int64))
        out[: len(filled)] = filled
        return out


def encode(ids: np.ndarray, table: Table, bits: int = BITS, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """One block: head, checkpoints (words before, checksum, states), word stream."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    freq, base = table.freq[ids], table.base[ids]
    if n and not freq.all():
        raise ValueError("an id has no frequency")
    limit, shift = freq << np.uint64(64 - bits), np.uint64(bits)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    states, ahead = [], []
    total = 0
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        spill = np.flatnonzero(x >= limit[a:b])
        if len(spill):
            over = x[spill]
            words.append(over.astype(np.uint32))
            total += len(over)
            x[spill] = over >> HALF
        whole = x // f
        x += (whole << shift) - whole * f + base[a:b]
        if step % stride == 0:
            states.append(state.copy())
            ahead.append(total)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    out = [struct.pack(HEAD, MARK, table.crc, bits, lanes, stride, n, total)]
    for k, (kept, left) in enumerate(zip(reversed(states), reversed(ahead))):
        piece = ids[k * stride * lanes : (k + 1) * stride * lanes]
        out.append(struct.pack("<II", total - left, zlib.crc32(piece.astype("<u4").tobytes())))
        out.append(kept.astype("<u8").tobytes())
    out.append(stream.astype("<u4").tobytes())
    return b"".join(out)


class Block:
    """A block's parts; `stretch(k)` decodes what lies between checkpoints k and k + 1."""

    def __init__(self, data: bytes, table: Table, symbols: np.ndarray) -> None:
        mark, crc, self.bits, self.lanes, self.stride, self.n, self.words = struct.unpack_from(HEAD, data)
        if mark != MARK or crc != table.crc:
            raise ValueError("not a block of this table")
        self.table, self.symbols = table, symbols
        self.checkpoints = -(-self.n // (self.lanes * self.stride))
        self.each = 8 + 8 * self.lanes
        start = HEAD_BYTES + self.checkpoints * self.each
        if len(data) != start + 4 * self.words:
            raise ValueError("a block of the wrong length")
        self.data = data
        self.stream = np.frombuffer(data, "<u4", self.words, start)

    def stretch(self, k: int) -> np.ndarray:
        at = HEAD_BYTES + k * self.each
        word, crc = struct.unpack_from("<II", self.data, at)
        state = np.frombuffer(self.data, "<u8", self.lanes, at + 8).astype(np.uint64)
        first = k * self.stride * self.lanes
        last = min(self.n, first + self.stride * self.lanes)
        out = np.empty(last - first, self.symbols.dtype)
        mask, shift = np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        for a in range(0, last - first, self.lanes):
            b = min(last - first, a + self.lanes)
            x = state[: b - a]
            slot = x & mask
            symbol = self.symbols[slot]
            out[a:b] = symbol
            x >>= shift
            x *= self.table.freq[symbol]
            x += slot - self.table.base[symbol]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << HALF) | self.stream[word : word + len(low)]
                word += len(low)
        then, goal = self.words, np.full(self.lanes, LOW, np.uint64)
        if k + 1 < self.checkpoints:
            (then,) = struct.unpack_from("<I", self.data, at + self.each)
            goal = np.frombuffer(self.data, "<u8", self.lanes, at + self.each + 8)
        ended = word == then and np.array_equal(state, goal)
        if not ended or zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("a stretch of ids fails its checksum")
        return out

    def ids(self) -> np.ndarray:
        parts = [self.stretch(k) for k in range(self.checkpoints)]
        return np.concatenate(parts) if parts else np.zeros(0, self.symbols.dtype)
