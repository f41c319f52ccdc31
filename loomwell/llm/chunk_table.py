"""A table of distinct chunks, each encoded once, that gives results back by position.

A text is cut where no token can cross. Every worker keeps a table of the chunks met so far; the new ones of a slice
are encoded in one call. The table has two halves: when the newer one is full it becomes the older one, whose chunks
move back as they are met again. So the chunks in use stay, and at most `most` are held besides those of one slice. Chunks over
`longest` characters are not kept. Results do not depend on either bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any


class ChunkTable:
    def __init__(self, encode_all: Callable[[list[Any]], Iterable[Any]], most: int = 800_000, longest: int = 64):
        self.encode_all, self.half, self.longest, self.held, self.older = encode_all, most // 2, longest, {}, {}

    def values(self, wanted: list[Any]) -> list[Any]:
        """What encode_all gives for each of some distinct chunks, in their order."""
        if len(self.held) > self.half:
            self.held, self.older = {}, self.held
        held, older = self.held, self.older
        new = []
        for c in wanted:
            if c not in held:
                if c in older:
                    held[c] = older[c]
                else:
                    new.append(c)
        if new:
            held.update(zip(new, self.encode_all(new)))
        out = list(map(held.__getitem__, wanted))
        for c in new:
            if len(c) > self.longest:
                del held[c]
        return out

    def lookup(self, texts_chunks: list[list[str]]) -> list[list[Any]]:
        """What encode_all gives for each chunk, text by text."""
        wanted = list(set().union(*texts_chunks))
        get = dict(zip(wanted, self.values(wanted))).__getitem__
        return [list(map(get, chunks)) for chunks in texts_chunks]
