"""Cuts texts where a byte-level BPE certainly starts a new pre-token, and numbers distinct chunks.

A blank that is followed by a character that is no white space always starts a
pre-token: it joins what follows, and no pre-token has a blank inside before a
visible character. Texts are cut before such blanks (where the next byte may
begin an unusual white space they are not; fewer cuts are always right). What
a chunk gives then depends on the chunk alone, so it is computed once for each
distinct chunk and looked up for the others, in numpy for a whole batch.

A hash only proposes which chunk a new one may equal: the bytes of both are
compared every time. Chunks that a hash confuses are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import mix64

#: Bytes that may follow the blank of a cut: none that is or begins white space.
SOLID = np.ones(256, bool)
SOLID[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Odd multiplier of the hash.
FACTOR = 0x9E3779B97F4A7C15
#: Bytes of distinct chunks that are remembered.
POOL_BYTES = 16 << 20
BLANK = 0x20


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the bounds of its texts in them."""
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def cut(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks start; every text that isn't empty starts one."""
    starts = np.zeros(len(data), bool)
    starts[:-1] = (data[:-1] == BLANK) & SOLID[data[1:]]
    own = bounds[1:] > bounds[:-1]
    starts[bounds[1:][own] - 1] = False  # what follows is another text's
    starts[bounds[:-1][own]] = True
    return np.flatnonzero(starts)


class ChunkTable:
    """Numbers of distinct chunks in an open-addressed table of numpy arrays.

    ``learn(chunks)`` is told the chunks (bytes) that get the next numbers.
    When the table is half full, or its chunks' bytes are too many, it starts
    afresh: ``forget()`` is told so.
    """

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], bits: int = 20):
        self.learn, self.forget, self.bits = learn, forget, bits
        self.powers = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        self._empty()
        self.pool, self.filled = np.zeros(1 << 16, np.uint8), 0
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.strays: dict[bytes, int] = {}  # chunks that the hash confuses with others

    def _empty(self) -> None:
        self.number = np.full(1 << self.bits, -1, np.int32)
        self.hash = np.zeros(1 << self.bits, np.uint64)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
        longest = int(left.max())
        if longest > len(self.powers):
            self.powers = np.cumprod(np.full(1 << longest.bit_length(), FACTOR, np.uint64))
        place = np.arange(len(data)) - np.repeat(starts, left)
        total = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * self.powers[place], starts)
        return mix64(total + mix64(left.astype(np.uint64)))

    def _seek(self, found: np.ndarray) -> np.ndarray:
        """The number of the chunk with each hash, -1 where none has it."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (found & np.uint64(mask)).astype(np.int64)
        out = np.full(len(found), -1, np.int64)
        todo = np.arange(len(found))
        while len(todo):
            at = slot[todo]
            got = self.number[at]
            same = (self.hash[at] == found[todo]) & (got >= 0)
            out[todo[same]] = got[same]
            todo = todo[~same & (got >= 0)]
            slot[todo] = (slot[todo] + 1) & mask
        return out

    def _insert(self, found: np.ndarray, number: np.ndarray) -> None:
        """Distinct hashes that aren't in the table, with their chunks' numbers."""
        mask = np.int64((1 << self.bits) - 1)
        number = number.astype(np.int32)
        slot = (found & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(found))
        while len(todo):
            at = slot[todo]
            free = self.number[at] < 0
            self.number[at[free]] = number[todo[free]]  # of several for one slot the last wins
            won = self.number[at] == number[todo]
            self.hash[at[won]] = found[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask

    def _add(self, chunks: list[bytes]) -> np.ndarray:
        """Keeps the bytes of new chunks and has them learned; their numbers."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        if self.filled + len(raw) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(max(len(raw), len(self.pool)), np.uint8)])
        self.pool[self.filled : self.filled + len(raw)] = raw
        self.begin, self.size = np.concatenate([self.begin, self.filled + np.cumsum(size) - size]), np.concatenate([self.size, size])
        self.filled += len(raw)
        self.learn(chunks)
        self.count += len(chunks)
        return np.arange(self.count - len(chunks), self.count)

    def _confused(self, data: np.ndarray, starts: np.ndarray, left: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Places of chunks whose bytes differ from those of the chunk with their number."""
        other = self.size[number] != left
        shift = np.where(other, 0, self.begin[number] - starts)
        at = np.arange(len(data)) + np.repeat(shift, left)
        if other.any():
            at[np.repeat(other, left)] = 0
        differs = self.pool[at] != data
        return np.flatnonzero(other | np.logical_or.reduceat(differs, starts)) if other.any() or differs.any() else np.zeros(0, np.int64)

    def find(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of every chunk."""
        if not len(starts):
            return np.zeros(0, np.int64)
        if self.count > 1 << (self.bits - 1) or self.filled > POOL_BYTES:
            self._clear()
            self.forget()
        left = np.diff(starts, append=len(data))
        hashes = self._hashes(data, starts, left)
        out = self._seek(hashes)
        new = np.flatnonzero(out < 0)
        raw = None
        if len(new):
            shown, which = np.unique(hashes[new], return_index=True)
            while self.count + len(shown) > 3 << (self.bits - 2):  # more distinct chunks in one batch than fit
                self._grow()
            raw = data.tobytes()
            lead = new[which]
            number = self._add([raw[a : a + n] for a, n in zip(starts[lead].tolist(), left[lead].tolist(), strict=True)])
            self._insert(shown, number)
            out[new] = number[np.searchsorted(shown, hashes[new])]
        confused = self._confused(data, starts, left, out)
        if len(confused):
            raw = raw or data.tobytes()
            chunks = [raw[a : a + n] for a, n in zip(starts[confused].tolist(), left[confused].tolist(), strict=True)]
            unknown = list(dict.fromkeys(c for c in chunks if c not in self.strays))
            if unknown:
                self.strays.update(zip(unknown, self._add(unknown).tolist(), strict=True))
            out[confused] = [self.strays[c] for c in chunks]
        return out

    def _grow(self) -> None:
        kept = np.flatnonzero(self.number >= 0)
        found, number = self.hash[kept], self.number[kept]
        self.bits += 1
        self._empty()
        self._insert(found, number)


def shared_blank(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks are a blank, a character that is no white space, and no further blank: joined, they can be computed in one go. The places of these and of the others."""
    plain = np.fromiter((c[0] == BLANK and len(c) > 1 and bool(SOLID[c[1]]) and c.count(b" ") == 1 for c in chunks), bool, len(chunks))
    return np.flatnonzero(plain), np.flatnonzero(~plain)
