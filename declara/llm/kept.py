"""What a Python worker keeps between tasks: one operator's caches at a time, each of bounded size.

Workers serve many tasks of many operators. An operator that begins in a worker
drops what another one has left there, so an executor never holds the sum.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

_held: dict = {}


class Cache(dict):
    """What ``make`` gives for a key, looked up as in a dictionary. Of two generations the older one goes when the newer is full."""

    def __init__(self, most: int, make: Callable):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def held(owner, make: Callable):
    """The owner's object, made at its first call; all others go."""
    if owner not in _held:
        if _held:
            _held.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries return memory by themselves
                ctypes.CDLL("libc.so.6").malloc_trim(0)
        _held[owner] = make()
    return _held[owner]
