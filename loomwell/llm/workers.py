"""What a Python worker holds between tasks.

Spark gives a worker tasks of many stages, one after another, and a stage's tables would stay in it while other stages run. So
functions that run on batches give back at their end what nothing uses, and, unless they use them, at their start the tables that
workers keep for later tasks of a stage.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from typing import Any

import pyarrow as pa

#: Forgets what a function under `kept` holds, for each of them that this worker has imported.
FORGET: list[Callable[[], None]] = []


def kept(make: Callable) -> Callable:
    """make, whose last two results stay in a worker until a function runs there that uses no such results."""
    held = lru_cache(2)(make)
    FORGET.append(held.cache_clear)
    return held


def forget_kept() -> None:
    for forget in FORGET:
        forget()


@lru_cache(1)
def _trim() -> Callable[[int], Any]:
    """The C library's own call for that, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)


def give_back() -> None:
    """Memory that is free in this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable[[Iterator], Iterator], uses_kept: bool = False) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow or mapInPandas, with little left in the worker at its end."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        if not uses_kept:
            forget_kept()
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
