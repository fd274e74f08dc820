"""Static range asymmetric numeral system over token ids.

One frequency table of 2**20 slots serves all blocks. A block is coded by many
interleaved lanes, token i by lane i mod lanes, in numpy steps of one token a
lane; lanes share one stream of 32-bit words. Blocks do not depend on each other.

A segment is: magic, lanes, number of tokens, number of blocks, crc32 of the
table; for each block a checkpoint (tokens before it, byte offset of its data,
words, crc32 of its tokens as unsigned 32-bit integers); a crc32 of all that;
then the blocks' data, each the final lane states and the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"PLRANS01"
BITS = 20
LOW = np.uint64(1 << 31)
HEAD, CHECKPOINT = struct.Struct("<8sIQII"), struct.Struct("<QQII")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Slots of each id: at least 1 where it occurs, 2**20 in all (or all zero)."""
    total, size = int(counts.sum()), 1 << BITS
    if not total:
        return np.zeros(len(counts), dtype=np.uint32)
    slots = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) / total * size).astype(np.int64)), 0)
    order = np.argsort(-slots, kind="stable")
    rest = size - int(slots.sum())
    for i in order if rest < 0 else order[:1]:
        change = rest if rest > 0 else -min(-rest, int(slots[i]) - 1)
        slots[i] += change
        rest -= change
        if not rest:
            break
    return slots.astype(np.uint32)


class Coder:
    def __init__(self, slots: np.ndarray, lanes: int = 4096, block: int = 1 << 19) -> None:
        self.lanes, self.block = lanes, block
        self.freq = slots.astype(np.uint64)
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(slots), dtype=np.uint32), slots.astype(np.int64))
        self.table_crc = zlib.crc32(slots.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray) -> bytes:
        """A segment of any number of ids."""
        table, data, at = [], [], 0
        for first in range(0, len(ids), self.block):
            part = ids[first : first + self.block]
            states, words = self._encode(part)
            body = states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
            table.append(CHECKPOINT.pack(first, at, len(words), zlib.crc32(np.ascontiguousarray(part, "<u4"))))
            data.append(body)
            at += len(body)
        head = HEAD.pack(MAGIC, self.lanes, len(ids), len(table), self.table_crc) + b"".join(table)
        return head + struct.pack("<I", zlib.crc32(head)) + b"".join(data)

    def _encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.full(self.lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        last = (len(ids) - 1) // self.lanes * self.lanes
        freq, cum = self.freq[ids], self.cum[ids]
        for first in range(last, -1, -self.lanes):
            f, c = freq[first : first + self.lanes], cum[first : first + self.lanes]
            state = x[: len(f)]
            over = state >= f << np.uint64(43)
            words.append((state[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
            state = np.where(over, state >> np.uint64(32), state)
            whole = state // f
            x[: len(f)] = (whole << np.uint64(BITS)) + (state - whole * f) + c
        return x, np.concatenate(words)[::-1]

    def decode(self, segment: bytes, only: int | None = None) -> np.ndarray:
        """The ids of a segment, or of its block ``only``; raises on a bad checksum."""
        magic, lanes, count, blocks, table_crc = HEAD.unpack_from(segment)
        end = HEAD.size + blocks * CHECKPOINT.size
        if magic != MAGIC or table_crc != self.table_crc or struct.unpack_from("<I", segment, end)[0] != zlib.crc32(segment[:end]):
            raise ValueError("segment header or frequency table is damaged")
        points = [CHECKPOINT.unpack_from(segment, HEAD.size + b * CHECKPOINT.size) for b in range(blocks)]
        out = []
        for b in range(blocks) if only is None else [only]:
            first, at, words, crc = points[b]
            size = (points[b + 1][0] if b + 1 < blocks else count) - first
            states = np.frombuffer(segment, "<u8", lanes, end + 4 + at)
            ids = self._decode(states, np.frombuffer(segment, "<u4", words, end + 4 + at + 8 * lanes), size)
            if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != crc:
                raise ValueError(f"block {b} is damaged")
            out.append(ids)
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def _decode(self, states: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
        x, out, at = states.astype(np.uint64), np.empty(size, dtype=np.uint32), 0
        for first in range(0, size, len(x)):
            state = x[: min(len(x), size - first)]
            slot = state & np.uint64((1 << BITS) - 1)
            ids = self.symbol[slot]
            out[first : first + len(state)] = ids
            state = self.freq[ids] * (state >> np.uint64(BITS)) + slot - self.cum[ids]
            low = np.flatnonzero(state < LOW)
            state[low] = (state[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
            x[: len(state)] = state
        if at != len(words) or (x != LOW).any():
            raise ValueError("block does not end where it should")
        return out
