"""What a Python worker holds from task to task. Workers outlive a stage, so what one stage holds would stand beside the next one's."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict = {}


def held(name, make: Callable):
    """What tasks of this name share in a worker; all else that it holds goes."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """For tasks that share nothing: what tasks of other stages held goes back to the system."""
    if not _held:
        return
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # not every C library gives memory back on demand
        pass
