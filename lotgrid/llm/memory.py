"""What a worker process remembers between tasks, one operator's at a time.

Spark keeps Python workers; what an operator has remembered would stay while others run in the same process.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """At the start of a task: forget what others than `name` hold, and give freed memory back to the system."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    _held[name] = clear
    if others:
        gc.collect()
        release()


def release() -> None:
    """At the end of a task: give memory that is free inside the process back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
