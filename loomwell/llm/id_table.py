"""A table of distinct short chunks of bytes and their token ids, looked up for many chunks at once.

A chunk of at most `LONGEST` bytes is its own key: its bytes in two words, its size in the last byte. Keys lie in slots by their hash,
the next free slot where that one is taken, and ids in one array. When the table might get over half full, the chunks that were met again since
it was last cleared stay, so many of them as fill a quarter at most. Ids do not depend on that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LONGEST = 15
#: Bytes after the last chunk that may be read.
PADDING = 16
#: The first k bytes of a word.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
ODD_1, ODD_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs one after another."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


def keys_of(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both words of chunks of 1 to LONGEST bytes; the second one is never 0. data goes on for PADDING bytes."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    high = words[starts + 8] & FIRST[np.maximum(sizes - 8, 0)]
    return words[starts] & FIRST[np.minimum(sizes, 8)], high | sizes.astype(np.uint64) << np.uint64(56)


class IdTable:
    def __init__(self, slots: int = 1 << 22):
        """slots: a power of two."""
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.place = np.zeros(slots, np.int32)  # where the ids begin, and in the low 4 bits how many
        self.again = np.zeros(slots, bool)
        self.ids, self.filled, self.held = np.zeros(1 << 16, "<u4"), 0, 0
        self.last, self.shift = slots - 1, np.uint64(65 - slots.bit_length())
        #: Chunks in one call of places().
        self.most = slots // 8

    def _spots(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every key, and the places of those that are new, each once; these have got their slots."""
        spot = low ^ high * ODD_1
        spot ^= spot >> np.uint64(32)
        spot *= ODD_2
        spot = (spot >> self.shift).astype(np.int64)
        left = np.flatnonzero((self.low[spot] != low) | (self.high[spot] != high))
        new = [left[:0]]
        while len(left):
            at = spot[left]
            free = self.high[at] == 0
            some, want = left[free], at[free]
            self.place[want] = some  # of several that want a slot one gets it
            got = self.place[want] == some
            some, want = some[got], want[got]
            self.low[want], self.high[want] = low[some], high[some]
            new.append(some)
            left = left[(self.low[at] != low[left]) | (self.high[at] != high[left])]
            spot[left] = spot[left] + 1 & self.last
        return spot, np.concatenate(new)

    def _clear(self) -> None:
        kept = np.flatnonzero(self.again)[: len(self.low) // 4]
        low, high, at, sizes = self.low[kept], self.high[kept], self.place[kept] >> 4, self.place[kept] & 15
        ids = self.ids[ragged(at.astype(np.int64), sizes)]
        for x in (self.low, self.high, self.again):
            x[:] = 0
        self.ids[: len(ids)] = ids
        self.filled, self.held = len(ids), len(kept)
        spot, _ = self._spots(low, high)
        self.place[spot] = np.cumsum(sizes) - sizes << 4 | sizes

    def add(self, ids: np.ndarray, keep: bool = True) -> int:
        """Where ids lie from now on, or until the next call."""
        begin, end = self.filled, self.filled + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:begin], np.zeros(max(begin, len(ids)), "<u4")])
        self.ids[begin:end] = ids
        self.filled = end if keep else begin
        return begin

    def places(self, low: np.ndarray, high: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key begin, and how many there are, until the next call. At most `most` keys.

        encode gives the ids of those at some places, one after another, and how many each has; at most as many as its chunk has bytes.
        """
        if self.held + len(low) > len(self.low) // 2:
            self._clear()
        spot, new = self._spots(low, high)
        self.again[spot] = True
        if len(new):
            ids, sizes = encode(new)
            self.place[spot[new]] = self.add(ids) + np.cumsum(sizes) - sizes << 4 | sizes
            self.again[spot[new]] = False
            self.held += len(new)
        found = self.place[spot]
        return (found >> 4).astype(np.int64), (found & 15).astype(np.int64)
